"""Queries of the windows and runs (W*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import lines, runs
from weftline.plans.registry import Registry
from weftline.plans.usage import dec
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("w1_versions", "SELECT o_custkey, o_orderkey, row_number() OVER w::INTEGER AS version, lag(o_orderkey) OVER w AS supersedes FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)".replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER"))
def w1(spark: SparkSession, root: str) -> DataFrame:
    return runs.versions(table(spark, root, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").select("o_custkey", "o_orderkey", "version", "supersedes")


@add(
    "w2_supersedes_chain",
    """WITH RECURSIVE v AS (SELECT o_orderkey AS id, o_orderstatus AS st, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev FROM orders),
    c AS (SELECT id AS start, id, st, prev, 0 AS depth FROM v UNION ALL SELECT c.start, v.id, v.st, v.prev, depth + 1 FROM c JOIN v ON v.id = c.prev AND v.st = c.st WHERE depth < 6)
    SELECT start, max(depth) AS depth, arg_max(id, depth) AS origin FROM c GROUP BY 1""",
)
def w2(spark: SparkSession, root: str) -> DataFrame:
    """How far back, at most 6, a version equals its predecessors: windows over the version order instead of a recursion."""
    order = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, root, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", F.row_number().over(order).alias("v"))
    fresh = F.coalesce((F.col("o_orderstatus") != F.lag("o_orderstatus").over(order)).cast("int"), F.lit(1))
    first = F.max(F.when(F.col("fresh") == 1, F.col("v"))).over(order.rowsBetween(W.unboundedPreceding, 0))
    chained = rows.withColumn("fresh", fresh).withColumn("depth", F.least(F.lit(6), F.col("v") - first))
    behind = [F.lag("o_orderkey", k).over(order) if k else F.col("o_orderkey") for k in range(7)]
    return chained.select(F.col("o_orderkey").alias("start"), "depth", F.element_at(F.array(*behind), F.col("depth") + 1).alias("origin"))


@add(
    "w3_islands",
    "SELECT l_suppkey, min(l_orderkey) AS low, max(l_orderkey) AS high, count(*) AS size FROM (SELECT l_suppkey, l_orderkey, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g FROM (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem)) GROUP BY l_suppkey, g",
)
def w3(spark: SparkSession, root: str) -> DataFrame:
    return lines.islands(table(spark, root, "lineitem"), ["l_suppkey"], "l_orderkey")


@add("w3_gaps", "SELECT o_custkey, o_orderkey + 1 AS low, nxt - 1 AS high FROM (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders) WHERE nxt > o_orderkey + 1")
def w3_gaps(spark: SparkSession, root: str) -> DataFrame:
    return lines.gaps(table(spark, root, "orders"), ["o_custkey"], "o_orderkey")


@add(
    "w4_uncovered_runs",
    """WITH l AS (SELECT doc_id AS k, unnest(generate_series(1, len(string_split(text, chr(10))))) AS n FROM documents), s AS (SELECT DISTINCT o_orderkey % 1000 AS k, o_orderkey % 23 AS lo, o_orderkey % 23 + o_custkey % 5 AS hi FROM orders WHERE o_orderstatus = 'P'),
    f AS (SELECT k, n FROM l WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.k = l.k AND n BETWEEN lo AND hi)) SELECT k, min(n)::BIGINT AS "from", max(n)::BIGINT AS "to", count(*) AS size FROM (SELECT k, n, n - row_number() OVER (PARTITION BY k ORDER BY n) AS g FROM f) GROUP BY k, g HAVING count(*) >= 3""",
)
def w4(spark: SparkSession, root: str) -> DataFrame:
    """The lines of all documents against spans made of orders."""
    ids = lines.lines_of(table(spark, root, "documents")).select(F.col("doc_id").alias("k"), F.col("n").cast("long").alias("n"))
    low = F.col("o_orderkey") % 23
    spans = table(spark, root, "orders").where("o_orderstatus = 'P'").select((F.col("o_orderkey") % 1000).alias("k"), low.alias("lo"), (low + F.col("o_custkey") % 5).alias("hi")).distinct()
    return runs.uncovered(ids, spans, "k", "n", "lo", "hi")


@add(
    "w5_sequence_jumps",
    """WITH s AS (SELECT o_custkey, o_orderkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders), m AS (SELECT o_custkey, median(step) AS median FROM s WHERE step IS NOT NULL GROUP BY 1)
    SELECT o_custkey, o_orderkey, step, median FROM s JOIN m USING (o_custkey) WHERE step > greatest(3.0 * median, median + 100)""",
)
def w5(spark: SparkSession, root: str) -> DataFrame:
    return runs.sequence_jumps(table(spark, root, "orders"), ["o_custkey"], "o_orderkey", 3.0, 100)


@add(
    "w6_family_gaps",
    """WITH r AS (SELECT DISTINCT p_name, p_size FROM part), s AS (SELECT p_name, p_size, p_size - lag(p_size) OVER (PARTITION BY p_name ORDER BY p_size) AS step FROM r), m AS (SELECT p_name, count(*) AS members, median(step) AS median FROM s GROUP BY 1 HAVING count(*) >= 6)
    SELECT p_name, p_size, step, members, median FROM s JOIN m USING (p_name) WHERE step > median AND step % median = 0 AND step <= 3 * median""",
)
def w6(spark: SparkSession, root: str) -> DataFrame:
    return runs.family_gaps(table(spark, root, "part"), ["p_name"], "p_size")


@add(
    "w7_broken_runs",
    """WITH s AS (SELECT user_id % 10 AS u, event_id, CASE WHEN event_id - lag(event_id) OVER w > 6 THEN 1 WHEN lag(event_id) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY event_id)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY u ORDER BY event_id) AS run FROM s) SELECT u, run::BIGINT AS run, min(event_id) AS low, max(event_id) AS high, count(*) AS size FROM n GROUP BY ALL HAVING count(*) >= 4""",
)
def w7(spark: SparkSession, root: str) -> DataFrame:
    return runs.broken_runs(table(spark, root, "events").select((F.col("user_id") % 10).alias("u"), "event_id"), ["u"], "event_id", 6, 4)


@add(
    "w8_adjacent_duplicates",
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents) SELECT doc_id, n::INTEGER AS n FROM (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM l) WHERE line = prev AND line <> ''",
)
def w8(spark: SparkSession, root: str) -> DataFrame:
    rows = lines.lines_of(table(spark, root, "documents"))
    return rows.withColumn("prev", F.lag("line").over(W.partitionBy("doc_id").orderBy("n"))).where("line = prev AND line <> ''").select("doc_id", "n")


@add("w9_repeated_definitions")
def w9(spark: SparkSession, root: str) -> DataFrame:
    return runs.repeated_definitions(lines.lines_of(table(spark, root, "documents")))


@add(
    "w10_line_signatures",
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), s AS (SELECT doc_id, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS norm FROM l)
    SELECT doc_id, n::INTEGER AS n, sha256(concat_ws('|', coalesce(lag(norm) OVER w, ''), norm, coalesce(lead(norm) OVER w, ''))) AS sig, count(*) OVER (PARTITION BY doc_id, norm) = 1 AS "unique" FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY n)""",
)
def w10(spark: SparkSession, root: str) -> DataFrame:
    signed = lines.signatures(lines.lines_of(table(spark, root, "documents")))
    return signed.select("doc_id", "n", F.sha2(F.concat_ws("|", "before", "norm", "after"), 256).alias("sig"), "unique")


@add(
    "w11_line_owner",
    "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS owner FROM events",
)
def w11(spark: SparkSession, root: str) -> DataFrame:
    start = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return lines.carried_down(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], start, "owner").select("event_id", "owner")


@add(
    "w12_carried_state",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_price FROM events",
)
def w12(spark: SparkSession, root: str) -> DataFrame:
    return lines.carried_down(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_price").select("event_id", "last_price")


@add(
    "w13_chunk_windows",
    """WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(greatest(0, ceil((n - 6) / 4))::BIGINT, (floor((n - 1) / 4))::BIGINT + 1)) AS win FROM l)
    SELECT doc_id, win AS "window", count(*) AS n, min(n)::INTEGER AS low FROM w GROUP BY ALL""",
)
def w13(spark: SparkSession, root: str) -> DataFrame:
    cut = lines.chunks(lines.lines_of(table(spark, root, "documents")).select("doc_id", "n"), ["doc_id"], "n", 6, 2)
    return cut.groupBy("doc_id", "window").agg(F.count("*").alias("n"), F.min("n").alias("low"))


@add("w14_batches")
def w14(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", (F.col("l_partkey") + F.col("l_linenumber")).alias("high"))
    return runs.batches(items, "l_suppkey", "l_partkey", "l_partkey", "high").groupBy("l_suppkey", "batch").agg(F.count("*").alias("n"))


@add(
    "w15_errors_since_success",
    """WITH r AS (SELECT user_id, event_id, event_type, ts FROM events), g AS (SELECT user_id, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM r WHERE event_type = 'purchase'), s AS (SELECT user_id, ts AS second_last FROM g WHERE k = 2)
    SELECT user_id, arg_max(event_id, (ts, event_id)) FILTER (event_type = 'error') AS last_error, count(*) FILTER (event_type = 'error' AND (second_last IS NULL OR ts > second_last)) AS errors FROM r LEFT JOIN s USING (user_id) GROUP BY 1""",
)
def w15(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    recent = W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    second = events.where("event_type = 'purchase'").withColumn("k", F.row_number().over(recent)).where("k = 2").select("user_id", F.col("ts").alias("second_last"))
    met = events.join(second, "user_id", "left")
    error = F.col("event_type") == "error"
    return met.groupBy("user_id").agg(
        F.max(F.when(error, F.struct("ts", "event_id")))["event_id"].alias("last_error"),
        F.count_if(error & (F.col("second_last").isNull() | (F.col("ts") > F.col("second_last")))).alias("errors"),
    )


@add(
    "w16_running_budget",
    "SELECT o_custkey, o_orderkey, spent::DOUBLE AS spent, CASE WHEN spent > 1000000 THEN 'exceeded' WHEN spent >= 800000 THEN 'warn' ELSE 'ok' END AS state FROM (SELECT o_custkey, o_orderkey, sum(o_totalprice::DECIMAL(18,4)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS spent FROM orders)",
)
def w16(spark: SparkSession, root: str) -> DataFrame:
    found = runs.running_budget(table(spark, root, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], dec("o_totalprice"), F.lit(1_000_000))
    return found.select("o_custkey", "o_orderkey", F.col("spent").cast("double").alias("spent"), "state")


@add(
    "w17_shifted_references",
    "WITH r AS (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'N'), d AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_suppkey, l_partkey, l_partkey - (SELECT count(*) FROM d WHERE d.l_suppkey = r.l_suppkey AND d.l_partkey < r.l_partkey) AS moved FROM r",
)
def w17(spark: SparkSession, root: str) -> DataFrame:
    items = table(spark, root, "lineitem")
    return runs.shifted_after_deletions(items.where("l_returnflag = 'N'").select("l_suppkey", "l_partkey"), items.where("l_returnflag = 'R'"), "l_suppkey", "l_partkey").select("l_suppkey", "l_partkey", "moved")
