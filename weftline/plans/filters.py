"""Queries of the scans, selections and predicates (S*, P*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import filters, lines
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()


@registry.add("s1_ordered_read", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderstatus, o_orderkey")
def s1(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderstatus", "o_orderkey")


@registry.add("s2_point_lookup", "SELECT * FROM orders WHERE o_orderkey = 42")
def s2(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").where("o_orderkey = 42")


@registry.add("s7_content_cache", "SELECT d.doc_id, c.first_id FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents WHERE doc_id % 2 = 0 GROUP BY 1) c ON sha256(d.text) = c.h")
def s7(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    cache = docs.where("doc_id % 2 = 0").groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(cache, "h").select("doc_id", "first_id")


@registry.add("s8_refreshed_reference", "SELECT p_brand, coalesce(max(CASE WHEN p_size > 40 THEN p_retailprice END), min(p_retailprice)) AS price FROM part GROUP BY p_brand")
def s8(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    base = part.groupBy("p_brand").agg(F.min("p_retailprice").alias("base"))
    fresh = part.where("p_size > 40").groupBy("p_brand").agg(F.max("p_retailprice").alias("fresh"))
    return base.join(fresh, "p_brand", "full_outer").select("p_brand", F.coalesce("fresh", "base").alias("price"))


@registry.add("s9_log_tail", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def s9(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type")


@registry.add("s11_idempotent_upload", "WITH f AS (SELECT sha256(text) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1) SELECT sha, doc_id FROM f WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE doc_id < 100)")
def s11(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.sha2("text", 256).alias("sha"), "doc_id")
    stored = docs.where("doc_id < 100").select("sha")
    return docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).join(stored, "sha", "left_anti")


@registry.add("p1_current_version", "SELECT o_custkey, o_orderkey FROM orders QUALIFY o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey)")
def p1(spark: SparkSession, root: str) -> DataFrame:
    return filters.current_only(table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_custkey", "o_orderdate").select("o_custkey", "o_orderkey")


@registry.add("p2_optional_predicates", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
def p2(spark: SparkSession, root: str) -> DataFrame:
    found = filters.where_given(table(spark, root, "lineitem"), {"l_returnflag": "R", "l_linestatus": "F", "l_suppkey": None})
    return found.select("l_orderkey", "l_linenumber", "l_quantity")


@registry.add("p3_in_list", "SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9, 14, 23, 49)")
def p3(spark: SparkSession, root: str) -> DataFrame:
    return filters.among(table(spark, root, "part"), "p_size", (1, 5, 9, 14, 23, 49)).select("p_partkey", "p_brand")


@registry.add("p4_nocase_name", "SELECT p_partkey, p_name FROM part WHERE lower(p_brand) = lower('bRAND#12')")
def p4(spark: SparkSession, root: str) -> DataFrame:
    return filters.named(table(spark, root, "part"), "p_brand", "bRAND#12").select("p_partkey", "p_name")


@registry.add("p5_not_prefix", "SELECT s_suppkey, s_name FROM supplier WHERE s_name NOT LIKE 'Supplier#00000000%'")
def p5(spark: SparkSession, root: str) -> DataFrame:
    return filters.without_prefix(table(spark, root, "supplier"), "s_name", "Supplier#00000000").select("s_suppkey", "s_name")


@registry.add("p6_json_containment", "SELECT event_id FROM (SELECT event_id, to_json({'aliases': [event_type, 'k' || (event_id % 7)::VARCHAR]}) AS j FROM events) WHERE list_contains(from_json(j->'aliases', '[\"VARCHAR\"]'), 'k3')")
def p6(spark: SparkSession, root: str) -> DataFrame:
    names = F.struct(F.array("event_type", F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"))).alias("aliases"))
    return filters.json_array_has(table(spark, root, "events").select("event_id", F.to_json(names).alias("j")), "j", "$.aliases", "k3").select("event_id")


@registry.add("p7_json_attribute", "SELECT event_id, event_type FROM events WHERE try_cast(json_extract_string(props, '$.k') AS BIGINT) >= 90")
def p7(spark: SparkSession, root: str) -> DataFrame:
    return filters.json_number_at_least(table(spark, root, "events"), "props", "$.k", 90).select("event_id", "event_type")


@registry.add("p8_drop_runtime_names", "SELECT p_partkey, p_name FROM part WHERE NOT starts_with(lower(p_name), 'a') AND lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size <= 3)")
def p8(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    return filters.not_runtime_names(part, "p_name", part.where("p_size <= 3").select(F.col("p_name").alias("name")), ("a",)).select("p_partkey", "p_name")


@registry.add("p9_kind_validation", "SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 1")
def p9(spark: SparkSession, root: str) -> DataFrame:
    _, quarantined = filters.validated(table(spark, root, "events"), "event_type", ("click", "view"))
    return quarantined.groupBy("event_type").agg(F.count("*").alias("n"))


@registry.add(
    "p10_grounding",
    r"""WITH c AS (SELECT doc_id, lower(text) AS t FROM documents), w AS (SELECT doc_id, 'x.' || split_part(trim(text), ' ', 1) AS name FROM documents UNION ALL SELECT doc_id, 'x.nowhere9' FROM documents)
    SELECT w.doc_id, w.name FROM w JOIN c USING (doc_id) WHERE contains(c.t, lower(regexp_replace(w.name, '.*[.:]', '')))""",
)
def p10(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    first = docs.select("doc_id", F.concat(F.lit("x."), F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("name"))
    # '.' does not match a line end in the twin's pattern, so names with one are left to the operator's own test
    names = first.unionAll(docs.select("doc_id", F.lit("x.nowhere9")))
    return filters.grounded(names, docs, "doc_id", "name", "text")


@registry.add("p11_line_in_span", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20")
def p11(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").where(filters.inside(F.col("l_quantity"), F.lit(10.0), F.lit(20.0))).select("l_orderkey", "l_linenumber")


@registry.add(
    "p12_code_lines",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS n FROM l WHERE NOT (regexp_matches(line, '^\s*$') OR regexp_matches(line, '^\s*[{}();\[\]]+\s*$') OR regexp_matches(line, '^\s*(//|#|\*|--)')) GROUP BY 1""",
)
def p12(spark: SparkSession, root: str) -> DataFrame:
    return lines.lines_of(table(spark, root, "documents")).where(~filters.is_blank_or_comment(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("n"))


@registry.add("p13_open_findings", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus NOT IN ('F')")
def p13(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").where(~F.col("o_orderstatus").isin("F")).select("o_orderkey", "o_orderpriority")
