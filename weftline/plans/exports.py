"""Queries of the sinks (K*): what is exported, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.graphs import EDGES, edges
from weftline.plans.registry import Registry
from weftline.sources import files
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("k1_nested_export")
def k1(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return files.nested_export(table(spark, root, "customer").select("c_custkey", "c_name"), orders, "c_custkey")


@add("k2_node_edge_export", f"WITH {EDGES} SELECT 'node' AS what, node AS a, NULL::BIGINT AS b FROM (SELECT from_id AS node FROM e UNION SELECT to_id FROM e) UNION ALL SELECT DISTINCT 'edge', from_id, to_id FROM e")
def k2(spark: SparkSession, root: str) -> DataFrame:
    links = edges(spark, root)
    nodes = links.select(F.col("from_id").alias("a")).union(links.select("to_id")).distinct()
    return nodes.select(F.lit("node").alias("what"), "a", F.lit(None).cast("long").alias("b")).unionAll(links.select(F.lit("edge"), "from_id", "to_id").distinct())


@add("k3_flow_chart", f"WITH {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT from_id AS node FROM e UNION ALL SELECT to_id FROM e) GROUP BY 1), t AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT 150), k AS (SELECT DISTINCT '  n' || from_id || ' --> n' || to_id AS line FROM e WHERE from_id IN (SELECT node FROM t) AND to_id IN (SELECT node FROM t)) SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS chart FROM k")
def k3(spark: SparkSession, root: str) -> DataFrame:
    return files.flow_chart(edges(spark, root), "from_id", "to_id")


@add("k7_name_variants", "SELECT DISTINCT p_name, v AS variant FROM (SELECT p_name, unnest([p_name, upper(p_name)]) AS v FROM part)")
def k7(spark: SparkSession, root: str) -> DataFrame:
    return files.name_variants(table(spark, root, "part").select("p_name").distinct(), "p_name")
