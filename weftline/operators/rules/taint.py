"""Taint (R5): data followed from where it enters a program to where it does harm, through assignments, loops, calls and results.

Statements are parsed by column expressions: what is assigned, looped over, called, returned, and which
dangerous place a statement has. A function is then read once, in order (`_read_scopes`): each variable
carries the origins of its value, which are outside data (S), a parameter (P:i), or the result of a call
(R:n). What comes out is a small table: this origin reaches that place, that call's argument, or the
function's own result.

Everything between functions is a fixpoint of joins over that table. The places that a function's
parameter reaches are its summary; a call that hands an origin to such a parameter reaches them too; and
where a parameter reaches the function's result, the origin goes on as the result of the call. Each
round joins only what the round before found (semi-naive) and is a written table; the rounds end when
nothing is new, after as many as the longest chain of calls, which may be a cycle.

Calls are resolved by name, across files. A line over LONGEST characters is generated code and not
traced; a statement goes on in the next line after an operator, a comma or an opening bracket.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.brackets import bracketed_parts, code_only, without_line_comment
from weftline.operators.lines import carried_down, folded, split_lines_of
from weftline.staging import discard, stage

LONGEST = 1500

# Where outside data enters, by language.
SOURCES = {
    "python": r"request\.(?:args|form|json|values|data|files|cookies|headers|get_json|GET|POST|FILES|COOKIES|META)\b|\binput\s*\(|sys\.argv|self\.request\b",
    "js": r"\breq\.(?:query|body|params|headers|cookies)\b|\blocation\.(?:search|hash|href)\b|document\.(?:cookie|referrer|URL)\b|window\.name\b|\.json\s*\(\s*\)|\.value\b|localStorage\.getItem|\bprompt\s*\(",
    "php": r"\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER)\b",
    "java": r"\.getParameter\s*\(|\.getHeader\s*\(|\.getQueryString\s*\(|\.getCookies\s*\(|@RequestParam|@PathVariable|@RequestBody",
    "cs": r"Request\.(?:QueryString|Form|Params|Cookies|Headers)\b|\[From(?:Body|Query|Route)\]|Request\[",
}
# Calls that make a value safe, and calls that hand their argument's taint to their result.
SANITIZER = (
    r"\b(?:int|float|bool|len|str\.isdigit|parseInt|parseFloat|Number|escape|html\.escape|escapeHtml|encodeURIComponent|encodeURI|quote|secure_filename|basename|os\.path\.basename|Path\(\w+\)\.name"
    r"|htmlspecialchars|htmlentities|intval|floatval|Integer\.parseInt|Long\.parseLong|int\.Parse|Convert\.To\w+|HttpUtility\.\w*Encode|DOMPurify\.sanitize|bleach\.clean)\s*\("
)
PROPAGATORS = (
    "join", "format", "replace", "strip", "lstrip", "rstrip", "lower", "upper", "title", "str", "encode", "decode", "get", "getlist", "pop", "split", "concat", "substring", "slice", "trim",
    "tostring", "cstr", "string", "tolowercase", "touppercase", "append", "add", "json", "text", "read", "load", "loads", "get_json",
)
# Rule, call, whether only its first argument counts. All are of high severity.
SINKS = {
    "python": (
        ("SEC-SQLI", r"\.(?:execute|executemany|executescript|raw)\s*\(", True),
        ("SEC-PATH", r"\b(?:open|send_file|send_from_directory|remove|unlink|rmtree)\s*\(|\.save\s*\(", False),
        ("SEC-CMD", r"\bos\.(?:system|popen)\s*\(|\bsubprocess\.\w+\s*\(|\bexec\s*\(|\beval\s*\(", False),
        ("SEC-XSS", r"\brender_template_string\s*\(|\bMarkup\s*\(|\bHttpResponse\s*\(|\bmark_safe\s*\(", False),
    ),
    "js": (
        ("SEC-SQLI", r"\.(?:query|execute|raw|run|all|get)\s*\(", True),
        ("SEC-PATH", r"\b(?:readFile|readFileSync|createReadStream|writeFile|writeFileSync|sendFile|unlink|unlinkSync)\s*\(", False),
        ("SEC-CMD", r"\b(?:exec|execSync|spawn|eval)\s*\(|new\s+Function\s*\(", False),
        ("SEC-XSS", r"\.(?:innerHTML|outerHTML)\s*\+?=|\bdocument\.write(?:ln)?\s*\(|\.insertAdjacentHTML\s*\(|\.html\s*\(", False),
    ),
    "php": (
        ("SEC-SQLI", r"\b(?:mysql_query|mysqli_query|pg_query)\s*\(|->(?:query|exec)\s*\(", False),
        ("SEC-PATH", r"\b(?:fopen|file_get_contents|include|require|include_once|require_once|unlink|readfile)\b", False),
        ("SEC-CMD", r"\b(?:system|exec|shell_exec|passthru|popen|proc_open|eval)\s*\(", False),
        ("SEC-XSS", r"\b(?:echo|print)\b", False),
    ),
    "java": (
        ("SEC-SQLI", r"\.(?:executeQuery|executeUpdate|execute|createQuery|createNativeQuery)\s*\(", True),
        ("SEC-PATH", r"new\s+(?:File|FileInputStream|FileOutputStream|FileReader|FileWriter)\s*\(|Paths\.get\s*\(", False),
        ("SEC-CMD", r"Runtime\.getRuntime\(\)\.exec\s*\(|new\s+ProcessBuilder\s*\(", False),
        ("SEC-XSS", r"\.(?:print|println|write)\s*\(", False),
    ),
    "cs": (
        ("SEC-SQLI", r"new\s+Sql(?:Command|DataAdapter)\s*\(|\.(?:ExecuteReader|ExecuteNonQuery|ExecuteScalar|FromSqlRaw)\s*\(", True),
        ("SEC-PATH", r"File\.(?:Open|ReadAll\w+|WriteAll\w+|Delete)\s*\(|new\s+FileStream\s*\(|Server\.MapPath\s*\(", False),
        ("SEC-CMD", r"Process\.Start\s*\(", False),
        ("SEC-XSS", r"Response\.Write\s*\(|new\s+HtmlString\s*\(|Html\.Raw\s*\(", False),
    ),
}
DEFINITIONS = {
    "python": r"^\s*(?:async\s+)?def\s+(\w+)\s*\(([^)]*)\)",
    "js": r"(?:function\s+|(?:^|\s)(?:const|let|var)\s+(?=\w+\s*=\s*(?:async\s*)?(?:function\s*)?\([^)]*\)\s*(?:=>)?\s*\{))(\w+)\s*(?:=\s*(?:async\s*)?(?:function\s*)?)?\(([^)]*)\)",
    "brace": r"^\s*(?:public|private|protected|static|final|async|override|virtual)[\w\s<>\[\],.?]*?\b(\w+)\s*\(([^)]*)\)\s*(?:throws[\w\s,.]+)?\{?\s*$",
}
ASSIGN = r"^\s*(?:(?:const|let|var|final|auto)\s+)?(?:[A-Z]\w*(?:<[^>]*>)?(?:\[\])?\s+|string\s+|int\s+|long\s+)?([A-Za-z_$][\w$]*)\s*([+.]?)=(?!=)\s*(.+)$"
LOOPS = ((r"for\s*\(?\s*(?:const|let|var)?\s*(\w+)\s+(?:of|in)\s+(\w+)", 1, 2), (r"(\w+)\.(?:forEach|map|filter|flatMap)\(\s*(?:function\s*)?\(?\s*(\w+)", 2, 1))
ROUTE = r"@\w+(?:\.\w+)*\.(?:route|get|post|put|delete|patch)\(\s*[\"']([^\"']*)[\"']"
KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "function", "def", "with", "elif", "foreach", "sizeof", "new")

USE = "struct<names:array<string>,source:boolean>"
REACHED = "doc string, scope int, fn string, origin string, kind string, rule string, at int, shared boolean, callee string, idx int, result string"


def _per_family(family: Column, values: dict[str, Column]) -> Column:
    found = F.lit(None)
    for name, value in values.items():
        found = F.when(family == name, value).otherwise(found)
    return found


def _use(expression: Column, source: Column) -> Column:
    """The variables an expression names, and whether it holds outside data itself."""
    names = F.array_distinct(F.regexp_extract_all(code_only(expression), F.lit(r"(?<![\w$.])([A-Za-z_$][\w$]*)"), F.lit(1)))
    return F.struct(names.alias("names"), F.coalesce(F.regexp_like(expression, source), F.lit(False)).alias("source")).cast(USE)


def _hands_on(expression: str) -> Column:
    """Whether the taint of what an expression names goes on to its value: not through a call, unless of a source or a function known to keep it."""
    call = r"^\s*(?:await\s+|new\s+)?([\w.$]+)\s*\("
    called = F.regexp_extract(F.col(expression), call, 0)
    name = F.lower(F.regexp_extract(F.regexp_extract(F.col(expression), call, 1), r"([^.]*)$", 1))
    return (called == "") | F.regexp_like(called, F.col("source")) | name.isin(*PROPAGATORS)


def statements(docs: DataFrame, key: str, family: str, text: str) -> DataFrame:
    """doc, family, n, line: statements without comments, folded over lines, of documents in a language that is traced."""
    known = docs.where(F.col(family).isin(*SOURCES)).select(F.col(key).cast("string").alias("doc"), F.col(family).alias("family"), F.col(text).alias("text"))
    rows = split_lines_of(known.withColumn("k", F.struct("doc", "family")), "k").where(F.length("line") <= LONGEST)
    rows = rows.select("k.doc", "k.family", "n", without_line_comment(F.col("line")).alias("line"))
    goes_on = F.col("line").rlike(r"(?:[=+(,&|]|&&|\|\|)\s*$") & ~F.col("line").rlike(r"^\s*(?:def|function)\b")
    whole = folded(rows.withColumn("line", F.when(goes_on, F.rtrim("line")).otherwise(F.col("line"))), ["doc", "family"], "n", "line", goes_on)
    return whole.where(F.trim("text") != "").select("doc", "family", F.col("first").alias("n"), F.col("text").alias("line"))


def parsed(rows: DataFrame) -> DataFrame:
    """One row a statement with its scope (the line of the function's head, 0 above all), the function, its parameters, and what the statement does."""
    family, line = F.col("family"), F.col("line")
    head = _per_family(family, {f: F.lit(DEFINITIONS.get(f, DEFINITIONS["brace"])) for f in SOURCES})
    is_head = F.regexp_like(line, head)
    part = lambda i: F.expr(f"regexp_extract(line, head, {i})")
    rows = rows.withColumn("head", head).withColumn("is_head", is_head)
    plain = lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"[=:].*$", "")), r"^\*+", "")
    params = F.transform(F.filter(F.split(part(2), ","), lambda p: F.trim(p) != ""), plain)
    rows = rows.withColumns({"fn_here": F.when(F.col("is_head"), part(1)), "params_here": F.when(F.col("is_head"), params)})
    rows = carried_down(rows, ["doc"], ["n"], F.when(F.col("is_head"), F.col("n")), "scope")
    rows = carried_down(rows, ["doc"], ["n"], F.col("fn_here"), "fn")
    route = F.when((family == "python") & line.rlike(ROUTE), F.regexp_extract_all(F.regexp_extract(line, ROUTE, 1), F.lit(r"<(?:\w+:)?(\w+)>"), F.lit(1)))
    stated = F.when(F.col("is_head"), F.array().cast("array<string>")).otherwise(route)  # a route counts for the next head only
    before = W.partitionBy("doc").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("stated", stated).withColumn("routed", F.when(F.col("is_head"), F.last("stated", ignorenulls=True).over(before)))
    source = _per_family(family, {f: F.lit(s) for f, s in SOURCES.items()})
    rows = rows.withColumn("source", source).withColumn("skipped", (F.col("is_head") & ~((family == "js") & F.contains(line, F.lit("=>")))) | route.isNotNull())
    group = lambda i: F.regexp_extract(line, ASSIGN, i)
    rows = rows.withColumns({"var": F.nullif(group(1), F.lit("")), "op": group(2), "rhs": group(3)})
    rows = rows.withColumn("back", F.when(line.rlike(r"^\s*return\b"), F.regexp_replace(line, r"^\s*return\b", "")))
    rows = rows.withColumns({"hands_on": _hands_on("rhs"), "safe": F.col("rhs").rlike(SANITIZER)})
    loop_var, loop_of = F.lit(None), F.lit(None)
    for pattern, var, of in reversed(LOOPS):
        loop_var = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, var)).otherwise(loop_var)
        loop_of = F.when(line.rlike(pattern), F.regexp_extract(line, pattern, of)).otherwise(loop_of)
    calls = F.transform(
        F.filter(
            F.arrays_zip(F.regexp_extract_all(line, F.lit(r"(?<![\w.])([A-Za-z_$][\w$]*)\s*\((?=(.*))"), F.lit(1)).alias("name"), F.regexp_extract_all(line, F.lit(r"(?s)(?<![\w.])([A-Za-z_$][\w$]*)\s*\((?=(.*))"), F.lit(2)).alias("rest")),
            lambda c: ~c["name"].isin(*KEYWORDS),
        ),
        lambda c: F.struct(c["name"].alias("callee"), F.transform(bracketed_parts(c["rest"]), lambda a: F.struct(_use(a, F.col("source")).alias("use"), a.rlike(SANITIZER).alias("safe"))).alias("args")),
    )
    nothing = F.struct(F.array().cast("array<string>").alias("names"), F.lit(False).alias("source")).cast(USE)
    returned = F.when(F.col("back").isNotNull(), F.when(_hands_on("back") & ~F.col("back").rlike(SANITIZER), _use(F.col("back"), F.col("source"))).otherwise(nothing))
    return rows.select(
        "doc", F.coalesce("scope", F.lit(0)).alias("scope"), "fn", "n", F.when(F.col("is_head"), F.col("params_here")).alias("params"), "routed", "skipped", "var", "op", "safe", "hands_on",
        F.when(F.col("var").isNotNull(), _use(F.col("rhs"), F.col("source"))).alias("rhs"), loop_var.alias("loop_var"), loop_of.alias("loop_of"),
        F.when(~F.col("skipped"), _sinks(family, line)).alias("sinks"), F.when(~F.col("skipped"), calls).alias("calls"), returned.alias("returned"),
    )


def _sinks(family: Column, line: Column) -> Column:
    """array<struct<rule, use, shared>>: the dangerous places of a statement; `shared` says that a parameter that reaches it counts for callers."""
    found = F.array().cast(f"array<struct<rule:string,use:{USE},shared:boolean>>")
    for name, sinks in SINKS.items():
        hits = []
        for rule, pattern, first in sinks:
            rest = F.regexp_extract(line, f"(?s)(?:{pattern})(.*)$", 1)
            region = F.get(bracketed_parts(rest), 0) if first else F.regexp_extract(line, f"(?s)((?:{pattern}).*)$", 1)
            hit, shared = line.rlike(pattern), F.lit(True)
            if rule == "SEC-XSS" and name == "js":  # clearing an element is not writing data into it
                hit &= ~line.rlike(r"\.(?:innerHTML|outerHTML)\s*\+?=\s*(?:[\"'`][^\"'`$<]*[\"'`]|)\s*;?\s*$")
            if rule == "SEC-CMD" and name == "python":  # a list of arguments without a shell is no injection, unless outside data is seen to go in
                shared = ~line.rlike(r"\bsubprocess\.\w+\s*\(") | F.contains(line, F.lit("shell")) | region.rlike(r"[\"']\s*[+%]|\{|\.format")
            use = _use(F.coalesce(region, F.lit("")), F.lit(SOURCES[name]))
            hits.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), use.alias("use"), shared.alias("shared"))))
        found = F.when(family == name, F.array_compact(F.array(*hits))).otherwise(found)
    return found


def _read_scopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Functions in order, one statement at a time: which origin (S, P:i, R:n) reaches which place, argument or result. A function may go on in the next batch."""
    names = [c.split()[0] for c in REACHED.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    form = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in REACHED.split(", ")])
    scope, held = None, {}

    def origins(use: dict) -> set[str]:
        found = {o for name in use["names"] for o in held.get(name, ())}
        return found | ({"S"} if use["source"] else set())

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            here = (row["doc"], row["scope"])
            if here != scope:
                scope, held = here, {}
            fn, n = row["fn"], row["n"]
            if row["params"] is not None:
                routed = set(row["routed"] or ())
                held = {p: {"S"} if p in routed else {f"P:{i}"} for i, p in enumerate(row["params"]) if p.replace("$", "_").isidentifier()}
            if row["skipped"]:
                continue
            if row["loop_var"] is not None and held.get(row["loop_of"]):
                held[row["loop_var"]] = set(held[row["loop_of"]])
            passed = {(call["callee"], i, o) for call in row["calls"] for i, arg in enumerate(call["args"]) if not arg["safe"] for o in origins(arg["use"])}
            var, returned = row["var"], row["returned"]
            result = f"R:{n}" if passed and (var is not None and not row["safe"] or returned is not None) else None
            if var is not None:
                got = origins(row["rhs"]) if row["hands_on"] and not row["safe"] else set()
                got |= {result} if result else set()
                held[var] = got | (held.get(var, set()) if row["op"] == "+" else set())
            for callee, i, o in passed:
                out.append((*here, fn, o, "arg", None, n, True, callee, i, result))
            for sink in row["sinks"]:
                out += [(*here, fn, o, "sink", sink["rule"], n, sink["shared"], None, None, None) for o in origins(sink["use"])]
            if returned is not None:
                out += [(*here, fn, o, "ret", None, n, True, None, None, None) for o in origins(returned) | ({result} if result else set())]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=form)


def reached(docs: DataFrame, key: str = "doc_id", family: str = "family", text: str = "text") -> DataFrame:
    """Per function and origin, what it reaches inside the function (see REACHED).

    Functions are sorted, not grouped: there are many, and each is short. The number of partitions is a
    stated one, as the work of a row is far above what its bytes tell.
    """
    rows = parsed(statements(docs, key, family, text))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "doc", "scope").sortWithinPartitions("doc", "scope", "n")
    return stage(ordered.mapInArrow(_read_scopes, REACHED).distinct(), "taint_local")


NODE = ["doc", "scope", "origin"]
FACT = ["doc", "scope", "fn", "origin", "kind", "rule", "at", "shared", "callee", "idx"]


def fixpoint(local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, summaries): what each origin reaches, through calls as well, and what each function's parameters reach.

    facts: FACT; `callee` and `idx` name the argument by which a place outside the function is reached, `at` the line inside it.
    summaries: fn, idx, kind, rule, of functions of that name in any file.
    """
    args = stage(local.where("kind = 'arg'").select(*NODE, "fn", "at", "callee", "idx", "result").distinct(), "taint_args")
    facts = delta = stage(local.where("kind <> 'arg'").select(*FACT).distinct(), "taint_facts")
    spark = local.sparkSession
    known = spark.createDataFrame([], "fn string, idx int, kind string, rule string")
    links = spark.createDataFrame([], "doc string, scope int, origin string, result string")
    while True:
        told = delta.where("startswith(origin, 'P:') AND shared AND fn IS NOT NULL").select("fn", F.substring("origin", 3, 9).cast("int").alias("idx"), "kind", "rule").distinct()
        had = (F.col("t.fn") == F.col("k.fn")) & (F.col("t.idx") == F.col("k.idx")) & (F.col("t.kind") == F.col("k.kind")) & F.col("t.rule").eqNullSafe(F.col("k.rule"))
        fresh = stage(told.alias("t").join(known.alias("k"), had, "left_anti"), "taint_fresh")
        met = args.join(fresh.withColumnRenamed("fn", "callee").withColumnRenamed("kind", "reach"), ["callee", "idx"])
        outside = met.where("reach = 'sink'").select("doc", "scope", "fn", "origin", F.lit("sink").alias("kind"), "rule", "at", F.lit(True).alias("shared"), "callee", "idx")
        linked = stage(met.where("reach = 'ret' AND result IS NOT NULL").select(*NODE, "result").distinct(), "taint_links")
        through = lambda of, by: by.join(of.withColumnRenamed("origin", "result"), ["doc", "scope", "result"]).select(*FACT)
        found = outside.unionByName(through(facts, linked)).unionByName(through(delta, links)).distinct()
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"f.{c}")) for c in FACT if c not in NODE]
        keyed = [F.col(f"n.{c}") == F.col(f"f.{c}") for c in NODE]
        new = stage(found.alias("n").join(facts.alias("f"), [*keyed, *same], "left_anti"), "taint_new")
        known = known.unionByName(fresh)
        if new.isEmpty():
            return facts, stage(known.distinct(), "taint_summaries")
        older, delta = facts, new  # the first delta is the first facts, which the next round no longer reads
        facts = stage(facts.unionByName(new), "taint_facts")
        links = links.unionByName(linked)
        discard(older)


def flows(facts: DataFrame) -> DataFrame:
    """(doc, rule, severity, n): outside data reaches a dangerous place in the same function."""
    return facts.where("kind = 'sink' AND origin = 'S' AND callee IS NULL").select("doc", "rule", F.lit("high").alias("severity"), F.col("at").alias("n")).distinct()


def unsafe_calls(facts: DataFrame) -> DataFrame:
    """(doc, n, callee, idx, rule, def_doc): outside data is handed to a function that lets it reach a dangerous place, itself or through others.

    One row for each document that defines such a function of that name; the caller's own may be among them.
    """
    calls = facts.where("kind = 'sink' AND origin = 'S' AND callee IS NOT NULL").select("doc", F.col("at").alias("n"), "callee", "idx", "rule").distinct()
    params = facts.where("kind = 'sink' AND shared AND startswith(origin, 'P:') AND fn IS NOT NULL")
    defined = params.select(F.col("fn").alias("callee"), F.substring("origin", 3, 9).cast("int").alias("idx"), "rule", F.col("doc").alias("def_doc")).distinct()
    return calls.join(defined, ["callee", "idx", "rule"]).select("doc", "n", "callee", "idx", "rule", "def_doc")
