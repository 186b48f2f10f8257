"""Queries of sorts, limits, dedup and set operations (T*, U*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import joins
from weftline.operators import ordering as od
from weftline.operators.lines import squeezed
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("t1_ranked_search", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') ORDER BY CASE WHEN p_name = 'ring' THEN 0 WHEN starts_with(p_name, 'ring') THEN 1 ELSE 2 END, p_size DESC, p_name, p_partkey LIMIT 20")
def t1(spark: SparkSession, root: str) -> DataFrame:
    rank = F.when(F.col("p_name") == "ring", 0).when(F.col("p_name").startswith("ring"), 1).otherwise(2)
    return table(spark, root, "part").where(F.col("p_name").contains("ring")).orderBy(rank, F.desc("p_size"), "p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@add(
    "t2_fair_share",
    """WITH g AS (SELECT greatest(2, 300 // count(DISTINCT l_suppkey)) AS share FROM lineitem), r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem),
    f AS (SELECT r.* FROM r, g WHERE k <= share), x AS (SELECT r.*, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS p FROM r, g WHERE k > share)
    SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM f UNION ALL SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM x WHERE p <= greatest(0, 300 - (SELECT count(*) FROM f))""",
)
def t2(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    return od.fair_share(items, "l_suppkey", order, 300, 2).drop("l_extendedprice")


@add("t3_capped_in_order", "SELECT event_id, value FROM (SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 40) ORDER BY event_id")
def t3(spark: SparkSession, root: str) -> DataFrame:
    return od.capped_then_restored(table(spark, root, "events").select("event_id", "value"), [F.desc("value"), F.col("event_id")], 40, ["event_id"])


@add("t4_component_order", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def t4(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@add("t5_top_by_degree", "SELECT node, count(*) AS degree FROM (SELECT l_partkey AS node FROM lineitem UNION ALL SELECT l_suppkey FROM lineitem) GROUP BY 1 ORDER BY degree DESC, node LIMIT 150")
def t5(spark: SparkSession, root: str) -> DataFrame:
    return od.degrees(table(spark, root, "lineitem"), "l_partkey", "l_suppkey").orderBy(F.desc("degree"), "node").limit(150)


@add("t6_first_seen", "SELECT l_partkey, l_suppkey, min((l_orderkey, l_linenumber)).l_orderkey AS l_orderkey FROM (SELECT * FROM lineitem) GROUP BY 1, 2".replace("min((l_orderkey, l_linenumber)).l_orderkey", "min(l_orderkey)"))
def t6(spark: SparkSession, root: str) -> DataFrame:
    return od.first_seen(table(spark, root, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey"), ["l_partkey", "l_suppkey"], ["l_orderkey"])


@add("t8_content_dedup", r"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(regexp_replace(text, '\s+', ' ', 'g'))")
def t8(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(F.sha2(squeezed(F.col("text")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@add(
    "t10_case_variants",
    "WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, p_size > 25 AS real FROM part) SELECT p_partkey, first_value(p_partkey) OVER (PARTITION BY lower(name) ORDER BY real DESC, p_partkey) AS survivor FROM n",
)
def t10(spark: SparkSession, root: str) -> DataFrame:
    named = table(spark, root, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"), (F.col("p_size") > 25).alias("real"))
    return od.merged_case_variants(named, "name", "p_partkey", F.col("real"))


@add(
    "t11_full_containment",
    r"""WITH p AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 10000000, array_to_string(string_split(text, chr(10))[2:4], chr(10)) FROM documents), c AS (SELECT text AS t, min(doc_id) AS id FROM p WHERE trim(text) <> '' GROUP BY 1)
    SELECT a.id AS held, b.id AS holder FROM c a JOIN c b ON a.id <> b.id AND contains(chr(10) || b.t || chr(10), chr(10) || a.t || chr(10))""",
)
def t11(spark: SparkSession, root: str) -> DataFrame:
    """All documents, and of each a fragment of its second to fourth line: which of them another one holds as a run of lines."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    inner = F.array_join(F.slice(F.split("text", "\n"), F.lit(2), F.lit(3)), "\n")
    return joins.contained_runs(docs.unionAll(docs.select(F.col("doc_id") + 10_000_000, inner)))


@add("u1_union_distinct", "SELECT c_nationkey AS id FROM customer UNION SELECT s_nationkey FROM supplier")
def u1(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "customer").select(F.col("c_nationkey").alias("id")).union(table(spark, root, "supplier").select("s_nationkey")).distinct()


@add("u2_union_all", "SELECT 'customer' AS source, c_custkey AS id FROM customer WHERE c_acctbal < 0 UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal < 0")
def u2(spark: SparkSession, root: str) -> DataFrame:
    one = table(spark, root, "customer").where("c_acctbal < 0").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"))
    return one.unionByName(table(spark, root, "supplier").where("s_acctbal < 0").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id")))


@add("u3_intersection", "SELECT p_brand FROM part WHERE p_size < 10 INTERSECT SELECT p_brand FROM part WHERE p_size > 40")
def u3(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    return part.where("p_size < 10").select("p_brand").intersect(part.where("p_size > 40").select("p_brand"))


@add(
    "u4_all_but_one",
    "WITH h AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS has FROM orders GROUP BY 1), m AS (SELECT o_custkey, list_filter(['1-URGENT','2-HIGH','3-MEDIUM','4-NOT SPECIFIED','5-LOW'], lambda x: NOT list_contains(has, x)) AS missing FROM h) SELECT o_custkey, missing[1] AS missing FROM m WHERE len(missing) = 1",
)
def u4(spark: SparkSession, root: str) -> DataFrame:
    return od.all_but_one(table(spark, root, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])


@add(
    "u5_snapshot_difference",
    """WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE NOT (a.k IS NOT DISTINCT FROM b.k AND a.v IS NOT DISTINCT FROM b.v)""",
)
def u5(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    after = rows.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "X").otherwise(F.col("v")))
    return od.compared(rows.where("k % 7 <> 0"), after, "k", "v")
