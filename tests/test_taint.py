"""Taint: golden rows in five languages, files that call one another, and random programs against a plain propagator."""

import random

import pytest

from weftline.functions import brackets
from weftline.operators.rules import taint
from weftline.plans.catalog import registry

GOLDEN = [
    # name, language, text, {(rule, line)}
    ("route", "python", '@app.route("/f/<path:name>")\ndef show(name):\n    return send_file(os.path.join(BASE, name))\ndef other(name):\n    return send_file(name)\n', {("SEC-PATH", 3)}),
    ("built text", "python", 'def a():\n    q = request.args.get("q", "")\n    sql = "SELECT * FROM t WHERE d = \'" + q + "\'"\n    rows = db.execute(sql).fetchall()\n', {("SEC-SQLI", 4)}),
    ("bound values", "python", 'def a():\n    q = request.args.get("q")\n    db.execute("SELECT * FROM t WHERE d = ?", (q,))\n', set()),
    ("made safe", "python", "def a():\n    n = int(request.args['n'])\n    db.execute('SELECT ' + str(n))\n    p = secure_filename(request.args.get('p'))\n    open(p)\n", set()),
    ("assigned again", "python", "def a():\n    q = request.form['q']\n    os.system(q)\n    q = 'fixed'\n    os.system(q)\n", {("SEC-CMD", 3)}),
    ("added to", "python", "def a():\n    q = 'ls '\n    q += request.form['q']\n    q += ' -l'\n    os.system(q)\n", {("SEC-CMD", 5)}),
    ("format string", "python", "def a():\n    q = request.json\n    os.system(f'ls {q}')\n    os.system('ls q')\n", {("SEC-CMD", 3)}),
    ("argument list", "python", "def a(x):\n    q = request.json\n    subprocess.run(['ls', q])\n    subprocess.run(['ls', x])\n", {("SEC-CMD", 3)}),
    ("other function's result", "python", "def a():\n    x = helper(request.args['x'])\n    open(x)\n", set()),
    ("comment", "python", "def a():\n    # open(request.args['x'])\n    y = 1  # request.args\n    open(y)\n", set()),
    ("over lines", "python", "def a():\n    q = ('a' +\n         request.args['x'])\n    db.execute('SELECT ' +\n        q)\n", {("SEC-SQLI", 4)}),
    ("functions part", "python", "def a():\n    q = request.args['x']\ndef b():\n    open(q)\n", set()),
    ("loop", "js", "async function f() {\n  const rows = await res.json();\n  rows.forEach(function (p) {\n    li.innerHTML = '<b>' + p.text + '</b>';\n  });\n}\n", {("SEC-XSS", 4)}),
    ("for of", "js", "function f() {\n  const all = req.query;\n  for (const p of all) {\n    document.write(p);\n  }\n  li.textContent = all;\n  li.innerHTML = '';\n}\n", {("SEC-XSS", 4)}),
    ("arrow", "js", "const f = (a, b) => {\n  const q = req.body.q;\n  db.query('SELECT ' + q);\n  db.query('SELECT ?', q);\n}\n", {("SEC-SQLI", 3)}),
    ("top of a page", "php", '<?php\n$id = $_GET["id"];\n$r = mysqli_query($c, "SELECT * FROM t WHERE id = " . $id);\necho htmlspecialchars("x");\n', {("SEC-SQLI", 3)}),
    ("parameter", "java", 'void f(HttpServletRequest request) {\n  String n = request.getParameter("n");\n  File f = new File("/data/" + n);\n}\n', {("SEC-PATH", 3)}),
    ("query string", "cs", 'void F() {\n  var n = Request.QueryString["n"];\n  var c = new SqlCommand("SELECT \'" + n + "\'", conn);\n}\n', {("SEC-SQLI", 3)}),
    ("not traced", "cobol", "MOVE REQUEST TO OPEN.\n", set()),
    ("generated line", "js", "x = req.query; " + "y" * 2000 + "; eval(x)\n", set()),
]


def traced(spark, files):
    frame = spark.createDataFrame([(n, f, t, "a", 1) for n, f, t in files], "name string, family string, text string, line string, n int").repartition(2)
    facts, summaries = taint.fixpoint(taint.reached(frame, "name"))
    return facts, {tuple(r) for r in summaries.select("fn", "idx", "kind", "rule").collect()}


def test_golden_rows(spark):
    facts, _ = traced(spark, [(n, f, t) for n, f, t, _ in GOLDEN])
    got = {(r.doc, r.rule, r.n) for r in taint.flows(facts).collect()}
    assert got == {(n, rule, line) for n, _, _, rows in GOLDEN for rule, line in rows}


def test_calls_across_files_chains_results_and_cycles(spark):
    files = [
        ("db.py", "python", "def find(kind, term):\n    sql = 'SELECT ' + term\n    return conn.execute(sql)\ndef quiet(x):\n    return conn.execute('SELECT 1', x)\n"),
        ("mid.py", "python", "def look(t):\n    return find('a', t)\ndef same(t):\n    u = t.strip()\n    return u\ndef twice(t):\n    return same(same(t))\ndef ping(a):\n    return pong(a)\ndef pong(b):\n    os.system(b)\n    return ping(b)\n"),
        ("web.py", "python", "def one():\n    q = request.args.get('q')\n    return find(q, 'x')\ndef two():\n    return look(request.args['q'])\ndef three():\n    y = twice(request.args['q'])\n    open(y)\ndef four():\n    find('a', int(request.args['q']))\n    quiet(request.args['q'])\ndef five():\n    ping(request.args['q'])\n"),
    ]
    facts, summaries = traced(spark, files)
    assert summaries == {("find", 1, "sink", "SEC-SQLI"), ("look", 0, "sink", "SEC-SQLI"), ("same", 0, "ret", None), ("twice", 0, "ret", None), ("ping", 0, "sink", "SEC-CMD"), ("pong", 0, "sink", "SEC-CMD")}
    calls = {(r.doc, r.n, r.callee, r.idx, r.rule, r.def_doc) for r in taint.unsafe_calls(facts).collect()}
    assert calls == {("web.py", 5, "look", 0, "SEC-SQLI", "mid.py"), ("web.py", 13, "ping", 0, "SEC-CMD", "mid.py")}
    assert {(r.doc, r.rule, r.n) for r in taint.flows(facts).collect()} == {("web.py", "SEC-PATH", 8)}


def program(rng, k):
    """Function bodies as data: (name, parameters, steps)."""
    functions = []
    for i in range(k):
        steps, params = [], ["a", "b"][: rng.randint(1, 2)]
        names = [*params, "x", "y", "z"]
        for _ in range(rng.randint(1, 7)):
            kind = rng.choice(["source", "copy", "join", "safe", "call", "call", "sink", "use"])
            steps.append((kind, rng.choice(names), rng.choice(names), rng.choice(names), f"f{rng.randrange(k)}"))
        steps.append(("return", "", rng.choice(names), "", ""))
        functions.append((f"f{i}", params, steps))
    return functions


def spelled(functions):
    lines, at = [], {}
    for name, params, steps in functions:
        lines.append(f"def {name}({', '.join(params)}):")
        for i, (kind, v, u, w, f) in enumerate(steps):
            text = {"source": f"{v} = request.args['q']", "copy": f"{v} = {u}.strip()", "join": f"{v} = 'p' + {u} + {w}", "safe": f"{v} = int({u})", "call": f"{v} = {f}({u}, {w})", "use": f"{f}({u}, {w})", "sink": f"os.system({u})", "return": f"return {u}"}[kind]
            lines.append("    " + text)
            at[name, i] = len(lines)
    return "\n".join(lines) + "\n", at


def propagated(functions, at):
    """Naive rounds over whole functions until nothing changes."""
    summary = {name: {"sink": set(), "ret": set()} for name, _, _ in functions}
    flows, calls = set(), set()
    while True:
        before = repr(sorted((n, sorted(s["sink"]), sorted(s["ret"])) for n, s in summary.items())) + repr(sorted(flows)) + repr(sorted(calls))
        for name, params, steps in functions:
            held = {p: {i} for i, p in enumerate(params)}
            for i, (kind, v, u, w, f) in enumerate(steps):
                of_u, of_w = held.get(u, set()), held.get(w, set())
                if kind in ("call", "use"):
                    result = set()
                    for idx, labels in ((0, of_u), (1, of_w)):
                        if idx in summary[f]["sink"]:
                            summary[name]["sink"] |= {x for x in labels if x != "S"}
                            calls |= {(at[name, i], f, idx)} if "S" in labels else set()
                        if idx in summary[f]["ret"]:
                            result |= labels
                    if kind == "call":
                        held[v] = result
                elif kind == "sink":
                    summary[name]["sink"] |= {x for x in of_u if x != "S"}
                    flows |= {at[name, i]} if "S" in of_u else set()
                elif kind == "return":
                    summary[name]["ret"] |= {x for x in of_u if x != "S"}
                else:
                    held[v] = {"source": {"S"}, "copy": of_u, "join": of_u | of_w, "safe": set()}[kind]
        if before == repr(sorted((n, sorted(s["sink"]), sorted(s["ret"])) for n, s in summary.items())) + repr(sorted(flows)) + repr(sorted(calls)):
            return flows, calls, summary


def test_random_programs(spark):
    rng = random.Random(7)
    files, want_flows, want_calls, want = [], set(), set(), set()
    for k in range(12):
        functions = program(rng, 8)
        functions = [(f"p{k}{n}", p, [(a, b, c, d, f"p{k}{f}" if f else "") for a, b, c, d, f in s]) for n, p, s in functions]
        text, at = spelled(functions)
        files.append((f"m{k}", "python", text))
        flows, calls, summary = propagated(functions, at)
        want_flows |= {(f"m{k}", n) for n in flows}
        want_calls |= {(f"m{k}", n, f, i) for n, f, i in calls}
        want |= {(n, i, kind) for n, s in summary.items() for kind in s for i in s[kind]}
    facts, summaries = traced(spark, files)
    assert {(r.doc, r.n) for r in taint.flows(facts).collect()} == want_flows
    assert {(r.doc, r.n, r.callee, r.idx) for r in taint.unsafe_calls(facts).collect()} == want_calls
    assert {s[:3] for s in summaries} == want and len(want) > 40


def test_brackets(spark):
    rows = ["a, b(c, d), 'e, f', [g, {h, i}]", "", "x", "a,,b", "f(a, b), c) rest, more", "'open, quote", "(" * 600 + "," + ")" * 600 + ",z"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = {r.i: (list(r.p), list(r.b)) for r in frame.select("i", brackets.top_level_parts(frame.t).alias("p"), brackets.bracketed_parts(frame.t).alias("b")).collect()}
    assert got[0][0] == ["a", "b(c, d)", "'e, f'", "[g, {h, i}]"] and got[1] == ([""], []) and got[2] == (["x"], ["x"])
    assert got[3][0] == ["a", "", "b"] and got[4][1] == ["f(a, b)", "c"] and got[5][0] == ["'open, quote"] and len(got[6][0]) == 2
    code = frame.select("i", brackets.without_line_comment(frame.t).alias("c")).where("i = 0").first()
    assert code.c == rows[0]
    one = spark.createDataFrame([("x = 'a # b' + \"//\"  # c",)], "t string")
    assert one.select(brackets.without_line_comment(one.t)).first()[0] == "x = 'a # b' + \"//\""


@pytest.mark.parametrize("name", ["r5_taint_flows", "r5_taint_calls"])
def test_queries_have_rows(spark, name):
    assert registry.queries[name](spark, "/root/testdata/sf0.001").count() >= 10


def test_functions_are_sorted_and_not_grouped(spark, monkeypatch):
    """Many short functions go through Python as sorted rows, without a call for each."""
    docs = spark.createDataFrame([(f"f{i}.py", "python", f"def g{i}(a, b):\n    c = a\n    os.system(c)\n    return b\n") for i in range(300)], "doc_id string, family string, text string")
    monkeypatch.setattr(taint, "stage", lambda df, label: df)
    local = taint.reached(docs)
    assert "FlatMapGroups" not in local._jdf.queryExecution().executedPlan().toString()
    found = {(r.doc, r.origin, r.kind) for r in local.collect()}
    assert found >= {(f"f{i}.py", o, k) for i in range(300) for o, k in (("P:0", "sink"), ("P:1", "ret"))}
