"""Queries of line and piece matching and of the remaining tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import brackets, verdicts as vd
from weftline.operators import lines, matching
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add
LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)"


@add("j13_fuzzy_lines")
def j13(spark: SparkSession, root: str) -> DataFrame:
    """The queries are every twentieth part, a stated set, against all parts but itself."""
    names = table(spark, root, "part").select("p_partkey", F.concat("p_name", F.lit(" "), F.lower("p_type")).alias("line"))
    left, right = names.where("p_partkey % 20 = 0").withColumnRenamed("p_partkey", "a"), names.withColumnRenamed("p_partkey", "b")
    return matching.fuzzy_lines(left, right, "a", "b", "line", 0.85).where("a <> b")


@add(
    "j20_positions",
    f"WITH {LINES} SELECT doc_id AS doc, n::INTEGER AS reading_n, n::INTEGER AS source_n FROM l QUALIFY count(*) OVER (PARTITION BY doc_id, line) = 1",
)
def j20(spark: SparkSession, root: str) -> DataFrame:
    """A document read as it is: every line that is unique by itself is found at its own place."""
    rows = lines.lines_of(table(spark, root, "documents")).withColumnRenamed("doc_id", "doc")
    return _unique_positions(matching.positioned(rows, rows), rows)


def _unique_positions(found: DataFrame, rows: DataFrame) -> DataFrame:
    once = rows.groupBy("doc", "line").agg(F.count("*").alias("k"), F.min("n").alias("reading_n")).where("k = 1").select("doc", "reading_n")
    return found.join(once, ["doc", "reading_n"])


@add(
    "j22_piece_holders",
    f"WITH {LINES}, u AS (SELECT DISTINCT line FROM l), p AS (SELECT DISTINCT substr(line, 3, 20) AS piece FROM l WHERE doc_id % 20 = 0 AND length(line) >= 22) SELECT piece, doc_id * 100000 + n AS line_id FROM p JOIN l ON contains(l.line, piece)",
)
def j22(spark: SparkSession, root: str) -> DataFrame:
    """The queries are pieces of every twentieth document, a stated set, against all lines."""
    rows = lines.lines_of(table(spark, root, "documents")).select("doc_id", (F.col("doc_id") * 100000 + F.col("n")).alias("line_id"), "line")
    pieces = rows.where("doc_id % 20 = 0 AND length(line) >= 22").select(F.substring("line", 3, 20).alias("piece")).distinct()
    return matching.piece_holders(pieces, rows, "piece", "line_id", "line")


@add("t12_collapsed_doubles", f"WITH {LINES}, d AS (SELECT *, coalesce(line = lag(line) OVER (PARTITION BY doc_id ORDER BY n) AND length(line) >= 6, false) AS same FROM l) SELECT doc_id, n::INTEGER AS n, line FROM d WHERE NOT same OR doc_id % 2 = 0")
def t12(spark: SparkSession, root: str) -> DataFrame:
    rows = lines.lines_of(table(spark, root, "documents"))
    return matching.collapsed_doubles(rows, rows.where("doc_id % 2 = 0"))


@add("r2_built_statements")
def r2(spark: SparkSession, root: str) -> DataFrame:
    body = F.format_string('q = "SELECT a FROM t WHERE b = " & _\n  name%d\nx = 1', F.col("p_size"))
    return matching.built_statements(lines.lines_of(table(spark, root, "part").select("p_partkey", body.alias("text")), "p_partkey"), "p_partkey")


@add(
    "r12_rereads",
    "WITH c AS (SELECT user_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS step FROM events) SELECT user_id, event_type, count(DISTINCT step) AS steps FROM c WHERE step IS NOT NULL GROUP BY ALL HAVING count(DISTINCT step) >= 4",
)
def r12(spark: SparkSession, root: str) -> DataFrame:
    return matching.rereads(table(spark, root, "events"), "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "event_type")


@add(
    "r19_checked_facts",
    r"""WITH f AS (SELECT doc_id, doc_id * 10 AS fact_id, CASE WHEN doc_id % 3 = 0 THEN 'no such quote 1234' ELSE split_part(text, chr(10), 1) END AS quote, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS cited FROM documents), l AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS b, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    m AS (SELECT doc_id, fact_id, arg_min(n, abs(n - cited) * 1000000 + n) AS found FROM f JOIN l USING (doc_id) WHERE length(trim(regexp_replace(quote, '\s+', ' ', 'g'))) > 0 AND contains(b, trim(regexp_replace(quote, '\s+', ' ', 'g'))) GROUP BY 1, 2)
    SELECT doc_id, found::INTEGER AS found, CASE WHEN length(trim(quote, ' ')) < 3 THEN 'quote too short' WHEN found IS NULL THEN 'quote not in the file' WHEN found <> cited THEN 'line corrected' ELSE 'holds' END AS reason FROM f LEFT JOIN m USING (doc_id, fact_id)""",
)
def r19(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    quote = F.when(F.col("doc_id") % 3 == 0, "no such quote 1234").otherwise(F.split_part("text", F.lit("\n"), F.lit(1)))
    facts = docs.select("doc_id", (F.col("doc_id") * 10).alias("fact_id"), quote.alias("quote"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("cited"))
    return matching.checked_facts(facts, lines.lines_of(docs)).select("doc_id", "found", "reason")


@add("r7_vulnerable_versions", "SELECT p_partkey, v AS version, true AS confirmed FROM (SELECT p_partkey, (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR AS v, p_size FROM part) WHERE p_size < 25")
def r7(spark: SparkSession, root: str) -> DataFrame:
    version = F.concat_ws(".", F.floor(F.col("p_size") / 10).cast("string"), (F.col("p_size") % 10).cast("string"))
    products = table(spark, root, "part").select("p_partkey", F.lit("lib").alias("product"), version.alias("version"))
    advisories = spark.sql("SELECT 'lib' AS product, '2.5' AS fixed")
    return matching.vulnerable(products, advisories).select("p_partkey", "version", "confirmed")


@add("r15_screen_issues", "SELECT p_partkey AS screen_id, unnest(list_filter([CASE WHEN p_size % 2 = 0 THEN 'no title' END, CASE WHEN p_size % 3 = 0 THEN 'field without label' END, CASE WHEN p_size % 5 = 0 THEN 'no action' END], lambda x: x IS NOT NULL)) AS issue FROM part")
def r15(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size")
    field = F.struct(F.when(size % 3 == 0, "").otherwise(F.col("p_name")).alias("label"), F.lit("text").alias("type"))
    actions = F.when(size % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("save")))
    body = F.to_json(F.struct(F.when(size % 2 == 0, " ").otherwise(F.col("p_brand")).alias("title"), F.array(field).alias("fields"), actions.alias("actions")))
    return matching.screen_issues(table(spark, root, "part").select(F.col("p_partkey").alias("screen_id"), body.alias("body")))


@add("r16_missing_headers", "SELECT page_id, h AS header FROM pages, (VALUES ('content-security-policy'), ('x-frame-options')) v(h) WHERE NOT (page_id % 2 = 0 AND h = 'x-frame-options')")
def r16(spark: SparkSession, root: str) -> DataFrame:
    sent = F.when(F.col("page_id") % 2 == 0, F.create_map(F.lit("X-Frame-Options"), F.lit("DENY"))).otherwise(F.create_map(F.lit("Server"), F.lit("x")))
    return matching.missing_headers(table(spark, root, "pages").select("page_id", sent.alias("headers")), "page_id", "headers", ("Content-Security-Policy", "X-Frame-Options"))


@add("x18_technologies", "SELECT page_id, list_filter([CASE WHEN contains(html, 'charset=\"utf-8\"') THEN 'html5' END, CASE WHEN contains(html, '<script') THEN 'script' END, CASE WHEN contains(html, 'jquery') THEN 'jquery' END], lambda x: x IS NOT NULL) AS technologies FROM pages")
def x18(spark: SparkSession, root: str) -> DataFrame:
    found = matching.technologies(table(spark, root, "pages"), {"html5": 'charset="utf-8"', "jquery": "jquery", "script": "<script"}, "page_id", "html")
    order = F.array(F.lit("html5"), F.lit("script"), F.lit("jquery"))
    return found.select("page_id", F.filter(order, lambda x: F.array_contains("technologies", x)).alias("technologies"))


@add("v10_file_state", "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'paused' WHEN o_orderkey % 3 = 0 THEN 'reading' ELSE 'waiting' END WHEN 'F' THEN 'failed' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'reviewing' WHEN o_orderkey % 7 = 0 THEN 'needs_recapture' ELSE 'done' END END AS state FROM orders")
def v10(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "captured").when(F.col("o_orderstatus") == "F", "failed").otherwise("transcribed")
    return table(spark, root, "orders").select("o_orderkey", vd.file_state(status, key % 2 == 0, key % 3 == 0, key % 5 == 0, key % 7 == 0).alias("state"))


@add("v12_record_owner", "WITH g AS (SELECT l_partkey, count(DISTINCT l_suppkey) AS copies, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS writers, count(DISTINCT l_linestatus) AS platforms FROM lineitem GROUP BY 1) SELECT l_partkey, CASE WHEN copies <= 1 THEN 'only copy' WHEN writers = 1 AND platforms = 1 THEN 'candidate' WHEN writers > 0 THEN 'several writers' ELSE 'no writer' END AS owner FROM g")
def v12(spark: SparkSession, root: str) -> DataFrame:
    writers = F.count_distinct(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey")))
    counts = table(spark, root, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("c"), writers.alias("w"), F.count_distinct("l_linestatus").alias("p"))
    return counts.select("l_partkey", vd.record_owner(F.col("c"), F.col("w"), F.col("p")).alias("owner"))


@add("v13_option_score", "SELECT s_suppkey, ((s_suppkey % 5) * 25 + (s_suppkey % 4) * 20 + (s_suppkey % 3) * 15 + (s_suppkey % 2) * 15 + (s_suppkey % 5) * 10 + (s_suppkey % 4) * 10 + (s_suppkey % 3) * 5) / 100 AS score FROM supplier")
def v13(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "supplier").select("s_suppkey", vd.option_score([F.col("s_suppkey") % k for k in (5, 4, 3, 2, 5, 4, 3)]).alias("score"))


@add("v14_scorecard", "SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN NULL ELSE ((s_suppkey % 5) * 20 + (s_suppkey % 4) * 15)::DOUBLE / 35 END AS rating FROM supplier")
def v14(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("s_suppkey")
    rated = lambda value: F.when(key % 10 != 0, value)
    ratings = {name: F.lit(None).cast("long") for name in vd.SCORECARD} | {"Technology currency": rated(key % 5), "Code quality": rated(key % 4)}
    return table(spark, root, "supplier").select("s_suppkey", vd.scorecard(ratings).alias("rating"))


@add("v15_finding_risk", "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0 THEN 5 WHEN o_orderpriority = '1-URGENT' OR o_orderkey % 3 = 0 THEN 4 WHEN o_orderkey % 5 = 0 THEN 2 ELSE 3 END AS likelihood, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 7 = 0 THEN 5 WHEN o_orderpriority = '1-URGENT' THEN 4 WHEN o_orderpriority = '3-MEDIUM' OR o_orderkey % 7 = 0 THEN 3 ELSE 2 END AS impact FROM orders")
def v15(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("o_orderkey")
    severity = F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "3-MEDIUM", "medium").otherwise("low")
    return table(spark, root, "orders").select("o_orderkey", vd.finding_risk(severity, key % 3 == 0, key % 7 == 0, key % 2 == 0, key % 5 == 0).alias("r")).select("o_orderkey", "r.*")


@add("v16_fix_effort", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 0.2::DOUBLE WHEN 1 THEN 0.5::DOUBLE END AS low, CASE p_size % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE END AS high FROM part")
def v16(spark: SparkSession, root: str) -> DataFrame:
    rule = F.element_at(F.array(F.lit("SEC-SQLI"), F.lit("SEC-DESER"), F.lit("SEC-NONE")), F.col("p_size") % 3 + 1)
    return table(spark, root, "part").select("p_partkey", vd.fix_effort(rule).alias("e")).select("p_partkey", "e.low", "e.high")


@add("f8_without_keys", "SELECT p_partkey, 'error: token=[redacted] in ' || p_name AS line FROM part")
def f8(spark: SparkSession, root: str) -> DataFrame:
    line = F.concat(F.lit("error: token=abc"), F.col("p_partkey").cast("string"), F.lit(" in "), "p_name")
    return table(spark, root, "part").select("p_partkey", vd.without_keys(line).alias("line"))


@add("f10_without_frames", "SELECT doc_id, sha256(replace(text, '```', '~~~')) AS h FROM documents")
def f10(spark: SparkSession, root: str) -> DataFrame:
    """Documents with line numbers and a status bar added come out as they were."""
    docs = table(spark, root, "documents").select("doc_id", F.replace("text", F.lit("```"), F.lit("~~~")).alias("text"))
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit("|"), x)), "\n")
    return docs.select("doc_id", F.sha2(vd.without_frames(F.concat(F.lit("```\n"), numbered, F.lit("\nLn 1, Col 2\n```"))), 256).alias("h"))


@add("f11_top_level_parts", "SELECT p_partkey, ['a', 'f(b, c)', '''d, e''', p_name] AS parts FROM part")
def f11(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", brackets.top_level_parts(F.concat(F.lit("a, f(b, c), 'd, e', "), "p_name")).alias("parts"))


@add("f17_counted_nouns", "SELECT p_partkey, p_size || CASE WHEN p_size = 1 THEN ' entry' ELSE ' entries' END AS words FROM part")
def f17(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", vd.counted(F.col("p_size"), "entry").alias("words"))
