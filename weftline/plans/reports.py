"""Queries of the relational work behind reports (N*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import controls, joins, lines, reports
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add(
    "n1_component_profile",
    """WITH s AS (SELECT l_suppkey, list_distinct(list(l_partkey % 40) FILTER (l_returnflag = 'R')) AS r, list_distinct(list(l_partkey % 40) FILTER (l_returnflag = 'A')) AS w FROM lineitem GROUP BY 1)
    SELECT l_suppkey, list_sort(list_filter(coalesce(r, []), lambda x: NOT list_contains(coalesce(w, []), x))) AS reads_only, list_sort(coalesce(w, [])) AS writes FROM s""",
)
def n1(spark: SparkSession, root: str) -> DataFrame:
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_partkey") % 40))
    rows = table(spark, root, "lineitem").groupBy("l_suppkey")
    return rows.agg(F.sort_array(F.array_except(of("R"), of("A"))).alias("reads_only"), F.sort_array(of("A")).alias("writes"))


@add("n2_store_usage", "SELECT l_partkey AS store, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS readers, count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) AS writers FROM lineitem GROUP BY 1 HAVING count(DISTINCT CASE WHEN l_returnflag = 'A' THEN l_suppkey END) > 1")
def n2(spark: SparkSession, root: str) -> DataFrame:
    of = lambda flag: F.count_distinct(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    return table(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("store")).agg(of("R").alias("readers"), of("A").alias("writers")).where("writers > 1")


@add(
    "n4_labels_in_page",
    r"""WITH l AS (SELECT page_id, list_distinct(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a>', 1)) AS labels FROM pages), x AS (SELECT page_id, unnest(labels) AS label, len(labels) AS n FROM l WHERE len(labels) >= 3),
    m AS (SELECT x.page_id, p.page_id AS holder, count(*) AS found, any_value(n) AS n FROM x JOIN pages p ON contains(p.html, '>' || label || '<') AND p.page_id <> x.page_id GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) >= 0.75 * any_value(n))
    SELECT page_id, min(holder) AS holder FROM m GROUP BY 1""",
)
def n4(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    labels = pages.select("page_id", F.array_distinct(F.regexp_extract_all("html", F.lit('<li><a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("labels"))
    return reports.labelled_elsewhere(labels, pages, "page_id", "html")


@add("n5_only_inside", "SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_quantity > 40 AND l_returnflag = 'R') > 0 AND count(*) FILTER (l_quantity > 40 AND l_quantity < 41 AND l_returnflag <> 'R') = 0")
def n5(spark: SparkSession, root: str) -> DataFrame:
    both, outside = (F.col("l_quantity") > 40) & (F.col("l_returnflag") == "R"), (F.col("l_quantity") > 40) & (F.col("l_quantity") < 41) & (F.col("l_returnflag") != "R")
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count_if(both).alias("a"), F.count_if(outside).alias("b")).where("a > 0 AND b = 0").select("l_suppkey")


def _spans(spark: SparkSession, root: str) -> DataFrame:
    low = F.col("o_orderkey") % 500
    return table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 30).alias("file"), low.alias("lo"), (low + F.col("o_custkey") % 4).alias("hi"), F.col("o_orderstatus").alias("verdict"))


SPANS = "s AS (SELECT o_orderkey AS id, o_custkey % 30 AS file, o_orderkey % 500 AS lo, o_orderkey % 500 + o_custkey % 4 AS hi, o_orderstatus AS verdict FROM orders)"


@add(
    "n6_span_join_levels",
    f"""WITH {SPANS}, f AS (SELECT event_id, event_id % 30 AS file, (event_id * 13) % 500 AS line, (event_id % 5)::INTEGER AS level FROM events),
    m AS (SELECT f.event_id, any_value(level) AS level, bool_or(verdict = 'F') AS disproved, bool_or(verdict = 'O') AS confirmed FROM f LEFT JOIN s ON s.file = f.file AND f.line BETWEEN lo AND hi GROUP BY 1)
    SELECT event_id, level AS from_level, greatest(0, least(4, level + CASE WHEN coalesce(disproved, false) THEN -1 WHEN coalesce(confirmed, false) THEN 1 ELSE 0 END)) AS level FROM m""",
)
def n6(spark: SparkSession, root: str) -> DataFrame:
    findings = table(spark, root, "events").select("event_id", (F.col("event_id") % 30).alias("file"), ((F.col("event_id") * 13) % 500).alias("line"), (F.col("event_id") % 5).cast("int").alias("level"))
    return reports.reviewed_levels(findings, _spans(spark, root), "event_id")


@add(
    "n7_interval_overlap",
    f"WITH {SPANS} SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON a.file = b.file AND a.lo <= b.hi AND b.lo <= a.hi AND a.verdict = 'P' AND b.verdict = 'F'",
)
def n7(spark: SparkSession, root: str) -> DataFrame:
    spans = _spans(spark, root)
    left = spans.where("verdict = 'P'").select(F.col("id").alias("a"), "file", F.col("lo").alias("la"), F.col("hi").alias("ha"))
    right = spans.where("verdict = 'F'").select(F.col("id").alias("b"), "file", F.col("lo").alias("lb"), F.col("hi").alias("hb"))
    return joins.overlapping(left, right, "file", "la", "ha", "lb", "hb").select("a", "b")


@add(
    "n8_classified_observations",
    """WITH c AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'flow' WHEN o_orderpriority = '1-URGENT' THEN 'conflict' WHEN o_totalprice > 200000 THEN 'debt' ELSE 'agreement' END AS class, o_totalprice FROM orders), f AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o_orderkey) AS k FROM c)
    SELECT o_orderkey, class FROM f WHERE class <> 'flow' OR k = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 16""",
)
def n8(spark: SparkSession, root: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "flow").when(F.col("o_orderpriority") == "1-URGENT", "conflict").when(F.col("o_totalprice") > 200000, "debt").otherwise("agreement")
    rows = table(spark, root, "orders").select("o_orderkey", "o_totalprice", kind.alias("class"))
    first = rows.where("class = 'flow'").agg(F.min("o_orderkey").alias("first"), F.lit(1).alias("one"))
    kept = rows.withColumn("one", F.lit(1)).join(F.broadcast(first), "one").where("class <> 'flow' OR o_orderkey = first")  # one row
    return kept.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(16).select("o_orderkey", "class")


@add("n9_literal_numbers", r"SELECT doc_id, num, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+\.[0-9]+', 0)) AS num FROM documents) GROUP BY ALL")
def n9(spark: SparkSession, root: str) -> DataFrame:
    hits = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]+\.[0-9]+"), F.lit(0))).alias("num"))
    return hits.groupBy("doc_id", "num").agg(F.count("*").alias("n"))


@add(
    "n10_risk_register",
    """WITH r AS (SELECT c_custkey, 'balance' AS category, 4 AS l, 5 AS i FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey, 'segment', 3, 3 FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT c_custkey, 'region', 2, 4 FROM customer WHERE c_nationkey < 5)
    SELECT c_custkey, category, l * i AS score FROM r""",
)
def n10(spark: SparkSession, root: str) -> DataFrame:
    """One row per met condition: one pass that explodes the conditions, no union of scans."""
    conditions = (("balance", 4, 5, F.col("c_acctbal") < 0), ("segment", 3, 3, F.col("c_mktsegment") == "BUILDING"), ("region", 2, 4, F.col("c_nationkey") < 5))
    met = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(name).alias("category"), F.lit(p * i).alias("score"))) for name, p, i, c in conditions]))
    return table(spark, root, "customer").select("c_custkey", F.explode(met).alias("r")).select("c_custkey", "r.*")


@add(
    "n12_citation_integrity",
    "WITH c AS (SELECT doc_id, unnest([doc_id * 3 % 50, doc_id * 7 % 60, doc_id % 45]) AS item_id FROM documents), v AS (SELECT DISTINCT c.doc_id, c.item_id, b.item_id IS NOT NULL AS known FROM c LEFT JOIN benchmark b USING (item_id)) SELECT doc_id, list_sort(list(item_id) FILTER (known)) AS kept, count(*) FILTER (NOT known) AS removed FROM v GROUP BY 1 HAVING count(*) FILTER (known) > 0",
)
def n12(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("doc_id")
    cited = table(spark, root, "documents").select("doc_id", F.explode(F.array_distinct(F.array(key * 3 % 50, key * 7 % 60, key % 45))).alias("item_id"))
    known = table(spark, root, "benchmark").select("item_id", F.lit(True).alias("known"))
    met = cited.join(known, "item_id", "left").groupBy("doc_id")
    return met.agg(F.sort_array(F.collect_list(F.when(F.col("known"), F.col("item_id")))).alias("kept"), F.count_if(F.col("known").isNull()).alias("removed")).where(F.size("kept") > 0)


@add("n13_cap_then_order", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100)")
def n13(spark: SparkSession, root: str) -> DataFrame:
    from weftline.operators.ordering import capped_then_restored

    items = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return capped_then_restored(items, [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 100, ["l_orderkey", "l_linenumber"]).drop("l_extendedprice")


@add("n14_technology_rows", "SELECT p_name, p_brand, min(p_partkey) AS first FROM part GROUP BY ALL")
def n14(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("first"))


@add(
    "n15_level_tree",
    "WITH t AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations) SELECT a.conv_id, a.turn, max(b.turn) AS parent FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id AND b.turn < a.turn AND b.level < a.level GROUP BY a.conv_id, a.turn",
)
def n15(spark: SparkSession, root: str) -> DataFrame:
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return reports.level_parents(table(spark, root, "conversations").select("conv_id", "turn", level.alias("level")), "conv_id", "turn", "level", 3)


@add(
    "n16_folded_statements",
    "WITH c AS (SELECT conv_id, turn, text, role = 'user' AS cont FROM conversations), o AS (SELECT *, CASE WHEN coalesce(NOT lag(cont) OVER w, true) THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS statement FROM o) SELECT conv_id, statement::BIGINT AS statement, min(turn) AS first, max(turn) AS last, sha256(string_agg(text, ' ' ORDER BY turn)) AS h FROM n GROUP BY 1, 2",
)
def n16(spark: SparkSession, root: str) -> DataFrame:
    folded = lines.folded(table(spark, root, "conversations"), ["conv_id"], "turn", "text", F.col("role") == "user")
    return folded.select("conv_id", "statement", "first", "last", F.sha2("text", 256).alias("h"))


@add("n17_reads_minus_writes", r"SELECT doc_id, list_sort(list_filter(list_distinct(regexp_extract_all(text, '[a-z]{12,}', 0)), lambda x: NOT list_contains(regexp_extract_all(text, '([a-z]{12,})[.]', 1), x))) AS names FROM documents")
def n17(spark: SparkSession, root: str) -> DataFrame:
    used = F.regexp_extract_all("text", F.lit("[a-z]{12,}"), F.lit(0))
    return table(spark, root, "documents").select("doc_id", F.sort_array(F.array_except(used, F.regexp_extract_all("text", F.lit("([a-z]{12,})[.]"), F.lit(1)))).alias("names"))


@add(
    "n18_best_windows",
    r"""WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1))) AS tok FROM documents), f AS (SELECT tok, count(*) AS df FROM d GROUP BY 1), b AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) > 1))) AS tok FROM benchmark),
    s AS (SELECT item_id, doc_id, sum((1000000 // df)) AS score FROM b JOIN d USING (tok) JOIN f USING (tok) GROUP BY ALL) SELECT item_id, doc_id, score::BIGINT AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 2""",
)
def n18(spark: SparkSession, root: str) -> DataFrame:
    return reports.assigned(table(spark, root, "benchmark"), table(spark, root, "documents"), "item_id", "doc_id", "text", 2)


@add("n11_stale_measures", "SELECT a.doc_id, sha256(a.text) <> sha256(CASE WHEN a.doc_id % 10 = 0 THEN a.text || ' ' ELSE a.text END) AS stale FROM documents a")
def n11(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    stored = docs.select(F.col("doc_id").alias("id"), F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256).alias("h"))
    return docs.join(stored, F.col("doc_id") == F.col("id")).select("doc_id", (F.sha2("text", 256) != F.col("h")).alias("stale"))


@add("n3_accumulator_usage", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (contains(line, ' the ')) AS shown, count(*) FILTER (NOT contains(line, ' the ')) AS other, CASE WHEN count(*) FILTER (contains(line, ' the ')) > 1 THEN 'shown' WHEN count(*) FILTER (contains(line, ' the ')) = 0 THEN 'unused' ELSE 'neither' END AS class FROM l GROUP BY 1")
def n3(spark: SparkSession, root: str) -> DataFrame:
    shown = F.count_if(F.contains("line", F.lit(" the ")))
    found = lines.lines_of(table(spark, root, "documents")).groupBy("doc_id").agg(shown.alias("shown"), F.count_if(~F.contains("line", F.lit(" the "))).alias("other"))
    return found.withColumn("class", F.when(F.col("shown") > 1, "shown").when(F.col("shown") == 0, "unused").otherwise("neither"))


def _evidence(spark: SparkSession, root: str) -> tuple[DataFrame, ...]:
    """A program a supplier; what its line items say stands for routines, findings and data, its parts for files."""
    lineitem = table(spark, root, "lineitem").withColumn("program", F.col("l_suppkey")).withColumn("component", F.concat(F.lit("P"), "l_partkey"))
    programs = table(spark, root, "supplier").select(F.col("s_suppkey").alias("program"), (F.col("s_suppkey") % 3 != 0).alias("money"), (F.col("s_nationkey") < 10).alias("tier1"))
    late = F.col("l_linenumber") == 7
    routines = lineitem.select("program", F.lit("paragraph").alias("kind"), F.concat(F.when(late & (F.col("l_partkey") % 5 == 0), "APPROVE-").otherwise("CALC-"), "component").alias("name"), F.lit("extracted").alias("origin"))
    findings = lineitem.where(late).select("program", F.when(F.col("l_partkey") % 10 == 0, "SEC-AUTHZ").when(F.col("l_partkey") % 10 == 1, "SEC-ERR").otherwise("SEC-XSS").alias("rule"), F.col("component").alias("file"))
    engine = F.when(F.col("l_partkey") % 50 == 0, "Windows desktop (local file)").when(F.col("l_partkey") % 50 == 1, "Mainframe (files)").otherwise("DB2")
    occurrences = lineitem.where("l_linenumber >= 6").select("program", "component", F.when(F.col("l_returnflag") == "A", "Payment").otherwise("Staff").alias("business"), engine.alias("engine"), F.concat(F.lit("LOG"), F.col("l_partkey") % 2).alias("store"), F.when(F.col("l_linestatus") == "F", "RW").otherwise("R").alias("access"))
    part = table(spark, root, "part")
    files = part.select((F.col("p_partkey") % 10).alias("program"), F.concat(F.when(F.col("p_partkey") % 10 == 4, "tests/").otherwise("src/"), F.lit("P"), "p_partkey").alias("file"), F.concat(F.lit("COMPUTE A = B * "), F.col("p_size").cast("string")).alias("text"))
    return programs, routines, findings, occurrences, files


EVIDENCE = """
    p AS (SELECT s_suppkey AS program, s_nationkey < 10 AS tier1 FROM supplier WHERE s_suppkey % 3 <> 0),
    l AS (SELECT *, l_suppkey AS program, 'P' || l_partkey AS c FROM lineitem),
    a AS (SELECT program, bool_or(l_linenumber = 7 AND l_partkey % 5 = 0) AS approves, list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber = 7 AND l_partkey % 10 = 0), [])) AS unguarded, list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber = 7 AND l_partkey % 10 = 1), [])) AS swallowing,
          list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber >= 6 AND l_linestatus = 'F' AND l_partkey % 50 = 0), [])) AS local, list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber >= 6 AND l_linestatus = 'F' AND l_returnflag = 'A' AND l_partkey % 50 = 1), [])) AS exchanges,
          list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber >= 6 AND l_linestatus = 'F' AND l_returnflag = 'A'), [])) AS payers, count(DISTINCT l_partkey % 2) FILTER (l_linenumber >= 6 AND l_returnflag = 'A') AS copies, list_sort(coalesce(list(DISTINCT c) FILTER (l_linenumber >= 6 AND l_returnflag = 'A'), [])) AS holders FROM l GROUP BY 1),
    e AS (SELECT p.program, tier1, coalesce(approves, false) AS approves, coalesce(unguarded, []) AS unguarded, coalesce(swallowing, []) AS swallowing, coalesce(local, []) AS local, coalesce(exchanges, []) AS exchanges, coalesce(payers, []) AS payers, CASE WHEN copies >= 2 THEN holders ELSE [] END AS diverging FROM p LEFT JOIN a USING (program)),
    c AS (SELECT program, tier1, 'Maker-checker approval' AS control, CASE WHEN approves THEN 'not met' ELSE 'open' END AS state, CASE WHEN approves THEN CASE WHEN len(unguarded) > 0 THEN 5 ELSE 4 END END AS rating, CASE WHEN approves THEN unguarded ELSE [] END AS components FROM e
          UNION ALL SELECT program, tier1, 'Audit trail integrity', CASE WHEN len(local) > 0 THEN 'not met' ELSE 'open' END, CASE WHEN len(local) > 0 THEN 4 END, local FROM e
          UNION ALL SELECT program, tier1, 'Error handling in posting', CASE WHEN len(swallowing) > 0 THEN 'not met' ELSE 'open' END, CASE WHEN len(swallowing) > 0 THEN 4 END, CASE WHEN len(list_intersect(swallowing, payers)) > 0 THEN list_sort(list_intersect(swallowing, payers)) ELSE swallowing END FROM e
          UNION ALL SELECT program, tier1, 'Reconciliation between stores', CASE WHEN len(diverging) > 0 THEN 'not met' ELSE 'open' END, CASE WHEN len(diverging) > 0 THEN 4 END, diverging FROM e
          UNION ALL SELECT program, tier1, 'Control totals on file exchanges', 'open', NULL, exchanges FROM e WHERE len(exchanges) > 0
          UNION ALL SELECT program, tier1, 'Automated tests on calculations', CASE WHEN program = 4 THEN 'met' ELSE 'not met' END, CASE WHEN program = 4 THEN 2 ELSE 4 END, [] FROM e)
"""


@add("r21_controls", f"WITH {EVIDENCE} SELECT program, control, state, rating::INTEGER AS rating, array_to_string(components, ',') AS components FROM c")
def r21_controls(spark: SparkSession, root: str) -> DataFrame:
    found = controls.assessed(*_evidence(spark, root))
    return found.select("program", "control", "state", "rating", F.array_join("components", ",").alias("components"))


@add(
    "r21_risk_register",
    f"""WITH {EVIDENCE}, t AS (SELECT * FROM (VALUES ('Maker-checker approval', 'Payments can be approved without an authorized second person', 1, 4), ('Error handling in posting', 'Unchecked posting errors could leave incomplete or duplicate updates', 1, 3), ('Audit trail integrity', 'The audit trail can be altered or lost', 1, 3), ('Automated tests on calculations', 'Calculation changes need verified regression coverage', 4, 3)) t(control, title, rank, likelihood)),
    r AS (SELECT program, title, rank, likelihood, CASE WHEN tier1 THEN 5 ELSE 4 END AS impact FROM c JOIN t USING (control) WHERE rating >= 4)
    SELECT program, row_number() OVER (PARTITION BY program ORDER BY likelihood * impact DESC, rank, title)::INTEGER AS place, title, (likelihood * impact)::INTEGER AS score, CASE WHEN likelihood * impact >= 15 THEN 'High' WHEN likelihood * impact >= 8 THEN 'Medium' ELSE 'Low' END AS band FROM r""",
)
def r21_register(spark: SparkSession, root: str) -> DataFrame:
    evidence = _evidence(spark, root)
    none = spark.createDataFrame([], "program long, kind string, subject string, unused boolean")
    return controls.register(evidence[0], controls.assessed(*evidence), none).select("program", "place", "title", "score", "band")
