"""Vulnerable and safe pairs per rule, masking, extraction and decision functions."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from weftline.functions import decisions, text
from weftline.operators import lines
from weftline.operators.rules import checks, line_rules, packs

PAIRS = [
    ("cs", "SEC-CRED", 'string password = "hunter22";', "string password = Read();"),
    ("cobol", "SEC-CRED", "05 WS-PASSWORD PIC X(8) VALUE 'SECRET1'.", "05 WS-PASSWORD PIC X(8)."),
    ("java", "SEC-XSS", 'out.println(request.getParameter("q"));', "out.println(escape(q));"),
    ("js", "SEC-XSS", "el.innerHTML = '<b>' + name;", "el.textContent = name;"),
    ("cs", "SEC-CMD", 'Process.Start("cmd " + arg);', 'Process.Start("notepad");'),
    ("java", "SEC-DESER", "Object o = new ObjectInputStream(s);", "Object o = parse(s);"),
    ("java", "SEC-CRYPTO", 'MessageDigest.getInstance("MD5")', 'MessageDigest.getInstance("SHA-256")'),
    ("cs", "SEC-TLS", 'var u = "http://example.org/x";', 'var u = "https://example.org/x";'),
    ("config", "SEC-AUTH", '<authentication mode="None"/>', '<authentication mode="Windows"/>'),
    ("config", "SEC-CONF", '<compilation debug="true"/>', '<compilation debug="false"/>'),
    ("cpp", "SEC-MEM", "gets(buffer);", "fgets(buffer, 10, f);"),
    ("vb6", "SEC-SQLI", 'q = "SELECT a FROM t WHERE b = " & name', 'q = "SELECT a FROM t WHERE b = ?"'),
    ("php", "SEC-PATH", "include($_GET['page']);", "include('page.php');"),
    ("python", "SEC-SQLI", "cur.execute(f\"SELECT {x}\")", 'cur.execute("SELECT ?", x)'),
    ("python", "SEC-DESER", "pickle.loads(data)", "json.loads(data)"),
    ("plsql", "SEC-ERR", "EXCEPTION WHEN OTHERS THEN NULL;", "EXCEPTION WHEN OTHERS THEN RAISE;"),
    ("shell", "SEC-CMD", "eval $command", "echo $command"),
    ("rpg", "SEC-SQLDYN", "EXECUTE IMMEDIATE :STMT", "EXECUTE :STMT"),
]


def test_each_rule_fires_on_the_bad_line_only(spark):
    rows = [(2 * i + k, 1, line, family) for i, (family, _, bad, good) in enumerate(PAIRS) for k, line in enumerate((bad, good))]
    found = {(r.doc_id, r.rule) for r in line_rules.scan(spark.createDataFrame(rows, "doc_id long, n int, line string, family string")).collect()}
    for i, (_, rule, bad, good) in enumerate(PAIRS):
        assert (2 * i, rule) in found, bad
        assert (2 * i + 1, rule) not in found, good


def test_long_lines_are_scanned_whole(spark):
    line = "x = 1; " * 800 + "os.system(a)" + " y = 2;" * 800
    got = line_rules.scan(spark.createDataFrame([(1, 1, line, "python"), (2, 1, None, "python")], "doc_id long, n int, line string, family string")).collect()
    assert [(r.doc_id, r.rule) for r in got] == [(1, "SEC-CMD")]


def test_masked_lines_hold_no_secret(spark):
    secrets = ['password = "hunter22"', "token: 'abc123xyz'", "Server=a;Password=p w d;x", "ftp://user:pass1@host/x", "sqlplus scott/tiger@db", "api_key='zzz999'"]
    got = spark.createDataFrame([(s,) for s in secrets], "line string").select(text.masked(F.col("line"), F.lit(True)).alias("m")).collect()
    assert not any(x in r.m for r in got for x in ("hunter22", "abc123xyz", "p w d", "pass1", "tiger", "zzz999"))


def test_personal_data_classes(spark):
    names = {"studentId": "student identifier", "WS-DOB": "date of birth", "cust.homeAddress": "contact details", "x_ssn": "social security number", "total": None, "": None}
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", text.personal_data_class(F.col("name"))["label"].alias("c")).collect()
    assert {r.name: r.c for r in got} == names


@pytest.mark.parametrize(("line", "want"), [("a   b  'c   d'", "a b 'c   d'"), ('x "a\\"  b"   y', 'x "a\\"  b" y'), ("", ""), ("  a ", "a")])
def test_squeeze_outside_quotes(line, want):
    assert text.squeeze_outside_quotes(line) == want


def test_published_cvss_scores(spark):
    for vector, score in (("NLNNUHHH", 9.8), ("NLNRCLLN", 6.1), ("LLLNUHHH", 7.8), ("NLNNCHHH", 10.0), ("NLNNUNNN", 0.0)):
        assert spark.range(1).select(decisions.cvss_base(*[F.lit(x) for x in vector]).alias("s")).first().s == score


def test_contrast_and_grades(spark):
    row = spark.range(1).select(decisions.contrast(F.lit("#000000"), F.lit("#ffffff")).alias("c"), decisions.grade(F.lit(None).cast("int")).alias("g"), decisions.severity_shift(F.lit("critical"), F.lit(1)).alias("s")).first()
    assert (row.c, row.g, row.s) == (21.0, "n/a", "critical")


def test_page_checks(spark):
    bad = '<html><head></head><body><h1>a</h1><h1>b</h1><img src="http://x/y"><a href="/q">here</a><form><input name="password" type="text"></form></body></html>'
    good = '<html lang="en"><head><title>t</title></head><body><h1>a</h1><img alt="x" src="/y"><a href="/q">Prices</a><form method="post"><input name="password" type="password"></form></body></html>'
    got = checks.page_checks(spark.createDataFrame([(1, bad), (2, good), (3, None)], "page_id long, html string")).collect()
    assert {r.rule for r in got if r.page_id == 1} == {"no-language", "no-title", "image-without-text", "vague-link", "password-shown", "form-by-get", "mixed-content", "duplicate-heading"}
    assert not [r for r in got if r.page_id == 2]


def test_sql_references_and_packs(spark):
    sql = "-- from x\nINSERT INTO Orders SELECT * FROM Orders JOIN b.Items i; CREATE TABLE t1 (a int); /* join z */ SELECT 'from q'"
    got = {(r.kind, r.name) for r in checks.sql_references(spark.createDataFrame([(1, sql)], "doc_id long, text string")).collect()}
    assert got == {("writes", "orders"), ("reads", "b.items"), ("defines", "t1")}
    code = "import os\nfrom a import b\n\ndef f():\n    pass\nclass C:\n    pass\n"
    assert packs.chosen(spark.createDataFrame([(1, None, None, code), (2, None, None, "text")], "doc_id long, name string, language string, text string")).orderBy("doc_id").collect()[0].pack == "python"


def test_block_balance_and_stated_counts(spark):
    rows = lines.lines_of(spark.createDataFrame([(1, "a {\n}\n}"), (2, "{\n{")], "doc_id long, text string"))
    got = {r.doc_id: (r.first_bad, r.left_open) for r in checks.block_balance(rows, "doc_id", "[{]", "[}]").collect()}
    assert got == {1: (3, -1), 2: (None, 2)}
    docs = spark.createDataFrame([(1, "It has twelve tables and 1,000 rows."), (2, "Only five tables.")], "doc_id long, text string")
    actual = spark.createDataFrame([("tables", 12), ("rows", 1000)], "noun string, actual int")
    assert [(r.doc_id, r.stated, r.actual) for r in checks.stated_counts(docs, actual).collect()] == [(2, 5, 12)]


def test_fuzzy_lines_meet_all_parts(spark):
    from difflib import SequenceMatcher

    from weftline.plans import matching

    root = "/root/testdata/sf0.01"
    lines = {r.p_partkey: " ".join(f"{r.p_name} {r.p_type.lower()}".split()) for r in spark.read.parquet(f"{root}/part.parquet").collect()}
    digits = {k: re.sub("[^0-9]+", " ", x) for k, x in lines.items()}
    letters = {k: collections.Counter(x) for k, x in lines.items()}

    def alike(x, y):
        most = sum((letters[x] & letters[y]).values())  # no ratio exceeds 2 most / total
        total = len(lines[x]) + len(lines[y])
        return 2 * most >= 0.85 * total and SequenceMatcher(None, lines[x], lines[y], False).ratio() >= 0.85

    want = {(a, b) for a in lines if a % 20 == 0 for b in lines if a != b and digits[a] == digits[b] and alike(a, b)}
    got = [(r.a, r.b) for r in matching.j13(spark, root).collect()]
    assert len(got) == len(set(got)) and set(got) == want and any(b % 20 != 1 for _, b in want)


def test_best_windows_are_exact_with_common_words(spark):
    import random

    from weftline.operators import reports

    rnd = random.Random(3)
    words = [f"rare{i}" for i in range(60)] + ["common", "often", "every"]
    text = lambda: " ".join(rnd.choices(words, k=4) + rnd.choices(words[-3:], k=2))
    items = spark.createDataFrame([(i, text()) for i in range(60)], "item long, text string")
    windows = spark.createDataFrame([(i, text()) for i in range(40)], "win_id long, text string")
    answers = [sorted(map(tuple, reports.assigned(items, windows, "item", "win_id", "text", 2, common).collect())) for common in (1, 5, 10_000)]
    assert answers[0] == answers[1] == answers[2] and len(answers[0]) > 60


def test_alike_pairs_miss_none(spark):
    import difflib
    import random

    from weftline.operators import joins

    rng = random.Random(18)
    words = ["", "a", "ab", "small ring", "big ring"] + ["".join(rng.choice("abcde ") for _ in range(rng.randint(1, 14))) for _ in range(120)]
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "name string")
    for floor in (0.4, 0.6, 0.9):
        got = {(r.a, r.b): r.ratio for r in joins.alike_pairs(frame, "name", floor).collect()}
        want = {(a, b): difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() for a in set(words) for b in set(words) if a < b}
        assert got == {k: v for k, v in want.items() if v >= floor}


def test_comments_hold_no_findings(spark):
    from weftline.operators.rules import line_rules

    texts = [
        ("python", '# password = "abcdef1"\npassword = "abcdef1"'),
        ("java", '/* String password = "abcdef1";\n String password = "abcdef1"; */ int x;\nString password = "abcdef1"; // note'),
        ("sql", "-- GRANT ALL ON t TO PUBLIC\nGRANT ALL ON t TO PUBLIC"),
        ("web", '<!-- x.innerHTML = a + b -->\n<script>x.innerHTML = a + b</script>'),
        ("cobol", "000100*    EXEC SQL EXECUTE IMMEDIATE\n000200     EXEC SQL EXECUTE IMMEDIATE"),
        ("vb", "' Password = \"abcdef1\"\nPassword = \"abcdef1\""),
    ]
    frame = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(texts)], "doc_id long, family string, text string")
    got = {(r.doc_id, r.n, r.rule) for r in line_rules.scan_documents(frame).collect()}
    assert got == {(0, 2, "SEC-CRED"), (1, 3, "SEC-CRED"), (2, 2, "SEC-AUTH"), (3, 2, "SEC-XSS"), (4, 2, "SEC-SQLDYN"), (5, 2, "SEC-CRED")}
