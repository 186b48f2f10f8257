"""Queries of files, logs and mutations that keep state (S3 to S6, K4 to K6, ST6, M5, M7, M10), on files written from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import changes
from weftline.plans.registry import Registry
from weftline.sources import files
from weftline.sources.tables import table
from weftline.staging import run_folder

registry = Registry()
add = registry.add


def _folder(spark: SparkSession, label: str) -> str:
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


@add("s3_folder_scan", "SELECT 'taken' AS reason, 1::BIGINT AS n, sha256(string_agg(n_name, chr(10) ORDER BY n_name) || chr(10)) AS h FROM nation UNION ALL SELECT 'folder', 2, NULL UNION ALL SELECT 'extension', 1, NULL")
def s3(spark: SparkSession, root: str) -> DataFrame:
    """Nation names as one text file, copies of it in folders that are skipped, and a file of another kind."""
    base = _folder(spark, "tree")
    names = table(spark, root, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name")
    for inner in ("src", "node_modules", "src/build"):
        names.write.text(f"{base}/{inner}")
    names.write.json(f"{base}/other")
    scanned = files.scan_folder(spark, base, ("txt",))
    return scanned.groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count("*").alias("n"), F.max(F.sha2("text", 256)).alias("h"))


@add("s4_decoded", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN p_name || chr(233) WHEN p_partkey % 4 = 2 THEN p_name || chr(8364) END AS text FROM part")
def s4(spark: SparkSession, root: str) -> DataFrame:
    """Names with a letter behind in UTF-8, in Windows-1252 (twice), and with a NUL."""
    name, k = F.encode("p_name", "UTF-8"), F.col("p_partkey") % 4
    end = F.when(k == 0, F.unhex(F.lit("C3A9"))).when(k == 1, F.unhex(F.lit("E9"))).when(k == 2, F.unhex(F.lit("80"))).otherwise(F.unhex(F.lit("00")))
    return table(spark, root, "part").select("p_partkey", files.decoded(F.concat(name, end)).alias("text"))


@add("s5_imported_bundles", "SELECT 'n' || p_partkey AS name, p_name AS text FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 2 <> 0")
def s5(spark: SparkSession, root: str) -> DataFrame:
    """Every fifth line is cut off, every seventh text is blank, and even parts are known already."""
    part, path = table(spark, root, "part"), _folder(spark, "bundles")
    name = F.concat(F.lit("n"), F.col("p_partkey").cast("string"))
    line = F.to_json(F.struct(name.alias("name"), F.when(F.col("p_partkey") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("text")))
    part.select(F.when(F.col("p_partkey") % 5 == 0, F.left(line, F.length(line) - 3)).otherwise(line).alias("value")).write.text(path)
    return files.import_bundles(spark, path, part.where("p_partkey % 2 = 0").select(name.alias("name")))


@add("s6_listing", "SELECT name, fresh FROM (VALUES ('region.parquet', false), ('nation.parquet', false), ('part.parquet', true)) t(name, fresh)")
def s6(spark: SparkSession, root: str) -> DataFrame:
    """Three files of the folder; a cache knows two as they are and one in another size."""
    wanted = f"{root}/{{region,nation,part}}.parquet"
    first = files.listed(spark, wanted)
    cache = first.withColumn("size", F.when(F.col("name") == "part.parquet", F.col("size") + 1).otherwise(F.col("size")))
    return files.listed(spark, wanted, cache).select("name", "fresh")


@add("k5_replaced_partition", "SELECT (p_size % 5)::INTEGER AS part, count(*) AS n, sum(CASE WHEN p_size % 5 = 3 THEN 1 ELSE p_size END)::BIGINT AS total FROM part GROUP BY 1")
def k5(spark: SparkSession, root: str) -> DataFrame:
    """One of five partitions is computed anew and swapped; the others keep their files (K4: by Spark's commit)."""
    path = _folder(spark, "swap")
    rows = table(spark, root, "part").select((F.col("p_size") % 5).alias("part"), "p_partkey", "p_size")
    rows.write.partitionBy("part").parquet(path)
    files.replace_partitions(rows.where("part = 3").withColumn("p_size", F.lit(1)), path, "part")
    return spark.read.parquet(path).groupBy("part").agg(F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total"))


@add("k6_appended_log", "SELECT event_type AS kind, event_id::VARCHAR AS msg FROM events ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 40")
def k6(spark: SparkSession, root: str) -> DataFrame:
    """A log appended to in two rounds, and its last rows (ST6)."""
    path = _folder(spark, "log")
    rows = table(spark, root, "events").select(F.col("ts").cast("timestamp").alias("t"), F.col("event_type").alias("kind"), F.col("event_id").cast("string").alias("msg"), F.lit("run").alias("stage"))
    for half in (0, 1):
        files.appended_log(rows.where(F.col("msg").cast("long") % 2 == half), path)
    return files.event_log(spark, path, 40).select("kind", "msg")


@add(
    "m5_purged",
    """WITH g AS (SELECT o_orderkey AS a FROM orders WHERE o_custkey % 100 = 7), s AS (SELECT l_orderkey AS a, l_partkey AS e FROM lineitem), l AS (SELECT e FROM s GROUP BY e HAVING count(*) FILTER (a NOT IN (SELECT a FROM g)) = 0),
    x AS (SELECT l_partkey AS f, l_suppkey AS t, l_orderkey AS a FROM lineitem WHERE l_orderkey NOT IN (SELECT a FROM g) AND l_partkey NOT IN (SELECT e FROM l) AND l_suppkey NOT IN (SELECT e FROM l))
    SELECT 'entities' AS what, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT e FROM l) UNION ALL SELECT 'edges', count(*) FROM x""",
)
def m5(spark: SparkSession, root: str) -> DataFrame:
    """Orders are file versions of customers; the parts of their lines are the entities they support."""
    orders, items = table(spark, root, "orders"), table(spark, root, "lineitem")
    artifacts = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("name"))
    links = items.select(F.monotonically_increasing_id().alias("id"), F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), F.col("l_orderkey").alias("artifact_id"))
    supports = items.select(F.col("l_orderkey").alias("artifact_id"), F.col("l_partkey").alias("entity_id"))
    entities, edges = changes.purged(artifacts, supports, links, table(spark, root, "part").select(F.col("p_partkey").alias("id")), artifacts.where("name % 100 = 7").select("name"))
    count = lambda df, what: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return count(entities, "entities").unionAll(count(edges, "edges"))


@add("m7_undone", "WITH l AS (SELECT o_orderkey AS id, o_custkey AS target, o_orderpriority AS field, o_orderstatus AS value FROM orders WHERE o_orderkey % 10 <> 3) SELECT target, field, arg_max(value, id) AS value FROM l GROUP BY ALL")
def m7(spark: SparkSession, root: str) -> DataFrame:
    log = table(spark, root, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("target"), F.col("o_orderpriority").alias("field"), F.col("o_orderstatus").alias("value"), F.lit("set").alias("op"), F.lit(True).alias("active"))
    return changes.undone(log, log.where("id % 10 = 3").select("id"))


@add(
    "m10_claims",
    """WITH i AS (SELECT o_orderkey AS item, o_custkey % 40 AS owner FROM orders), f AS (SELECT item, row_number() OVER (ORDER BY item) AS k FROM i WHERE owner >= 30), q AS (SELECT owner, row_number() OVER (ORDER BY asked, owner) AS k FROM (SELECT user_id % 40 AS owner, ts AS asked FROM events) WHERE owner < 30)
    SELECT item, owner FROM i WHERE owner < 30 UNION ALL SELECT item, q.owner FROM f LEFT JOIN q USING (k)""",
)
def m10(spark: SparkSession, root: str) -> DataFrame:
    """Orders are work items; owners 0 to 29 are alive, and events are their requests."""
    items = table(spark, root, "orders").select(F.col("o_orderkey").alias("item"), (F.col("o_custkey") % 40).alias("owner"))
    requests = table(spark, root, "events").select((F.col("user_id") % 40).alias("owner"), F.col("ts").alias("at"))
    return changes.claimed(items, requests, spark.range(30).select(F.col("id").alias("owner")))
