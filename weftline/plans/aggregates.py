"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import aggregates as ag
from weftline.operators import lines
from weftline.plans.registry import Registry
from weftline.plans.usage import dec
from weftline.sources.tables import table

registry = Registry()
add = registry.add


@add("a3_group_over_left_join", "SELECT c_mktsegment, count(o_orderkey) AS n, coalesce(sum(o_totalprice::DECIMAL(18,4)), 0)::DOUBLE AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def a3(spark: SparkSession, root: str) -> DataFrame:
    met = table(spark, root, "customer").join(table(spark, root, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return met.groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("n"), F.coalesce(F.sum(dec("o_totalprice")), F.lit(0)).cast("double").alias("total"))


@add("a4_sum_over_versions", "SELECT p_partkey, (SELECT sum(q.p_retailprice::DECIMAL(18,4)) FROM part q WHERE q.p_name = p.p_name)::DOUBLE AS all_versions FROM part p")
def a4(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").select("p_partkey", F.sum(dec("p_retailprice")).over(W.partitionBy("p_name")).cast("double").alias("all_versions"))


@add("a5_count_by_status", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a5(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@add("a6_duplicates", r"SELECT sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS h, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def a6(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").groupBy(F.sha2(F.lower(lines.squeezed(F.col("text"))), 256).alias("h")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@add("a7_keep_first", "SELECT l_returnflag, l_partkey, coalesce(l_linenumber, -1) AS line, min(l_orderkey) AS keep FROM lineitem GROUP BY ALL")
def a7(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_returnflag", "l_partkey", F.coalesce("l_linenumber", F.lit(-1)).alias("line")).agg(F.min("l_orderkey").alias("keep"))


@add("a8_two_level_rollup", "SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY GROUPING SETS ((), (event_type))")
def a8(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "events").rollup("event_type").agg(F.count("*").alias("n"), F.sum(dec("value")).cast("double").alias("total"))


@add("a9_count_matrix", "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1")
def a9(spark: SparkSession, root: str) -> DataFrame:
    return ag.count_matrix(table(spark, root, "events"), "user_id", "event_type", ["click", "error", "view"])


@add("a10_fan_in_out", "SELECT l_suppkey, count(DISTINCT l_partkey) AS fan_out, count(DISTINCT l_orderkey) AS fan_in FROM lineitem GROUP BY 1")
def a10(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("fan_out"), F.count_distinct("l_orderkey").alias("fan_in"))


@add("a11_shared_writes", "WITH p AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), s AS (SELECT l_partkey, count(*) AS writers FROM p GROUP BY 1 HAVING count(*) > 1) SELECT l_suppkey, l_partkey, writers FROM p JOIN s USING (l_partkey)")
def a11(spark: SparkSession, root: str) -> DataFrame:
    return ag.shared_targets(table(spark, root, "lineitem"), "l_suppkey", "l_partkey")


@add(
    "a12_capped_score",
    "WITH r AS (SELECT l_suppkey, l_returnflag, least(sum(l_linenumber), 40) AS p FROM lineitem GROUP BY ALL) SELECT l_suppkey, greatest(0, 100 - sum(p))::BIGINT AS score FROM r GROUP BY 1",
)
def a12(spark: SparkSession, root: str) -> DataFrame:
    deductions = table(spark, root, "lineitem").select("l_suppkey", "l_returnflag", "l_linenumber", F.lit(40).alias("cap"))
    return ag.capped_score(deductions, ["l_suppkey"], "l_returnflag", "l_linenumber", "cap")


@add(
    "a13_guarded_mean",
    """WITH c AS (SELECT c_nationkey, c_mktsegment, (c_custkey * 37 % 101)::BIGINT AS s, greatest(20, c_custkey % 300)::DOUBLE AS w FROM customer), m AS (SELECT c_mktsegment, sum(s * w) / sum(w) AS mean, min(s) AS worst FROM c GROUP BY 1)
    SELECT c_mktsegment, round_even(least(mean, worst + 25.0), 0)::DOUBLE AS score, round_even(mean, 0)::DOUBLE AS average, worst FROM m""",
)
def a13(spark: SparkSession, root: str) -> DataFrame:
    scored = table(spark, root, "customer").select("c_mktsegment", (F.col("c_custkey") * 37 % 101).alias("s"), (F.col("c_custkey") % 300).alias("lines"))
    return ag.guarded_mean(scored, ["c_mktsegment"], "s", "lines", guard=25)


@add("a14_worst_component", "SELECT s_nationkey, arg_min(s_suppkey, (s_acctbal, s_suppkey)) AS worst, arg_max(s_suppkey, (s_acctbal, -s_suppkey)) AS best FROM supplier GROUP BY 1")
def a14(spark: SparkSession, root: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, root, "supplier").groupBy("s_nationkey").agg(F.min_by(key, F.struct("s_acctbal", key)).alias("worst"), F.max_by(key, F.struct(F.col("s_acctbal"), (-key).alias("k"))).alias("best"))


@add("a15_share", "SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) / sum(l_linenumber) AS share FROM lineitem GROUP BY 1")
def a15(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_suppkey").agg((F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")).otherwise(0)) / F.sum("l_linenumber")).alias("share"))


@add("a16_worst_control", "SELECT doc_id % 10 AS area, greatest(floor(avg(quality + toxic) + 0.5), max(quality + toxic) - 1)::BIGINT AS rating FROM labels GROUP BY 1")
def a16(spark: SparkSession, root: str) -> DataFrame:
    marks = F.col("quality") + F.col("toxic")
    return table(spark, root, "labels").groupBy((F.col("doc_id") % 10).alias("area")).agg(F.greatest(F.floor(F.avg(marks) + 0.5), (F.max(marks) - 1).cast("long")).alias("rating"))


@add(
    "a17_width_conflicts",
    """SELECT p_name AS concept, count(DISTINCT p_size) AS widths, count(DISTINCT p_partkey) AS files, min(p_size) AS narrowest, arg_min(p_partkey, (p_size, p_partkey)) AS narrowest_file,
    max(p_size) AS widest, arg_max(p_partkey, (p_size, -p_partkey)) AS widest_file FROM part GROUP BY 1 HAVING count(DISTINCT p_size) > 1 AND count(DISTINCT p_partkey) >= 2""",
)
def a17(spark: SparkSession, root: str) -> DataFrame:
    return ag.width_conflicts(table(spark, root, "part").withColumnRenamed("p_name", "concept"), "concept", "p_size", "p_partkey")


@add("a18_values_in_several_files", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT line, count(DISTINCT doc_id) AS holders, min(doc_id) AS first FROM l WHERE line <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2")
def a18(spark: SparkSession, root: str) -> DataFrame:
    return ag.values_in_several(lines.lines_of(table(spark, root, "documents")).where("line <> ''"), "line", "doc_id")


@add("a19_nested_groups", "SELECT l_partkey, l_suppkey, count(DISTINCT l_linenumber) AS steps FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) >= 2")
def a19(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count_distinct("l_linenumber").alias("steps")).where("steps >= 2")


@add("a20_digit_families", "SELECT regexp_replace(n, '[0-9]+', 'nn', 'g') AS family, count(DISTINCT n) AS members, min(n) AS first FROM (SELECT s_name AS n FROM supplier UNION ALL SELECT p_brand FROM part) GROUP BY 1 HAVING count(DISTINCT n) >= 4")
def a20(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "supplier").select(F.col("s_name").alias("n")).unionAll(table(spark, root, "part").select("p_brand"))
    return ag.digit_families(names, "n")


@add("a20_segment_families")
def a20_segments(spark: SparkSession, root: str) -> DataFrame:
    """Part names, types and the second words of names as dotted names without digits."""
    part = table(spark, root, "part")
    dotted = F.regexp_replace(F.lower(F.concat_ws(".", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_type", F.split_part("p_name", F.lit(" "), F.lit(2)))), "[0-9 ]", "")
    return ag.segment_families(part.select(dotted.alias("n")), "n")


@add(
    "a21_ownership_rollup",
    """SELECT l_partkey % 50 AS entity, count(DISTINCT l_suppkey) AS copies, list_sort(list_distinct(list(CASE WHEN l_returnflag = 'A' THEN l_suppkey END))) AS writers,
    list_sort(list_filter(list_distinct(list(CASE WHEN l_returnflag = 'R' THEN l_suppkey END)), lambda x: NOT list_contains(list_distinct(list(CASE WHEN l_returnflag = 'A' THEN l_suppkey END)), x))) AS readers FROM lineitem GROUP BY 1""",
)
def a21(spark: SparkSession, root: str) -> DataFrame:
    of = lambda flag: F.collect_set(F.when(F.col("l_returnflag") == flag, F.col("l_suppkey")))
    rows = table(spark, root, "lineitem").groupBy((F.col("l_partkey") % 50).alias("entity"))
    return rows.agg(F.count_distinct("l_suppkey").alias("copies"), F.sort_array(of("A")).alias("writers"), F.sort_array(F.array_except(of("R"), of("A"))).alias("readers"))


@add(
    "a22_text_matrix",
    "SELECT c_nationkey, coalesce(string_agg(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN (c_custkey % 4)::VARCHAR END, ',' ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN (c_custkey % 4)::VARCHAR END), '') AS building, coalesce(string_agg(DISTINCT CASE WHEN c_mktsegment = 'MACHINERY' THEN (c_custkey % 4)::VARCHAR END, ',' ORDER BY CASE WHEN c_mktsegment = 'MACHINERY' THEN (c_custkey % 4)::VARCHAR END), '') AS machinery FROM customer GROUP BY 1",
)
def a22(spark: SparkSession, root: str) -> DataFrame:
    cells = table(spark, root, "customer").withColumn("cell", (F.col("c_custkey") % 4).cast("string"))
    joined = F.array_join(F.sort_array(F.collect_set("cell")), ",")
    wide = cells.groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(joined)
    return wide.select("c_nationkey", F.coalesce("BUILDING", F.lit("")).alias("building"), F.coalesce("MACHINERY", F.lit("")).alias("machinery"))


@add(
    "a23_dense_grid",
    """WITH c AS (SELECT c_custkey % 5 + 1 AS l, c_nationkey % 5 + 1 AS i, c_custkey FROM customer) SELECT g.l::INTEGER AS l, h.i::INTEGER AS i, coalesce(list(c_custkey ORDER BY c_custkey) FILTER (c_custkey IS NOT NULL), []) AS names
    FROM range(1, 6) g(l) CROSS JOIN range(1, 6) h(i) LEFT JOIN c ON c.l = g.l AND c.i = h.i GROUP BY ALL""",
)
def a23(spark: SparkSession, root: str) -> DataFrame:
    rich = table(spark, root, "customer")
    cells = rich.groupBy((F.col("c_custkey") % 5 + 1).cast("int").alias("l"), (F.col("c_nationkey") % 5 + 1).cast("int").alias("i")).agg(F.sort_array(F.collect_list("c_custkey")).alias("names"))
    grid = spark.range(25).select((F.floor(F.col("id") / 5) + 1).cast("int").alias("l"), (F.col("id") % 5 + 1).cast("int").alias("i"))
    return grid.join(cells, ["l", "i"], "left").select("l", "i", F.coalesce("names", F.array().cast("array<bigint>")).alias("names"))


@add(
    "a24_plurality_vote",
    """WITH v AS (SELECT event_id // 4 AS line, event_type, sum(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) AS weight, count(*) AS voters FROM events GROUP BY ALL)
    SELECT line, event_type, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER w AS rn, lead(weight) OVER w AS second FROM v WINDOW w AS (PARTITION BY line ORDER BY weight DESC, event_type)) WHERE rn = 1 AND voters >= 2 AND weight >= 2 * coalesce(second, 0)""",
)
def a24(spark: SparkSession, root: str) -> DataFrame:
    votes = table(spark, root, "events").withColumn("line", F.floor(F.col("event_id") / 4))
    return ag.plurality(votes, ["line"], "event_type", F.when(F.col("event_id") % 3 == 0, 2).otherwise(1))


@add(
    "a25_clear_mode",
    """WITH v AS (SELECT doc_id % 40 AS g, n_chars // 1000 AS k, count(*) AS weight FROM documents GROUP BY ALL)
    SELECT g, k, weight FROM (SELECT *, row_number() OVER w AS rn, lead(weight) OVER w AS second FROM v WINDOW w AS (PARTITION BY g ORDER BY weight DESC, k)) WHERE rn = 1 AND weight >= 2 AND weight >= 2 * coalesce(second, 0)""",
)
def a25(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select((F.col("doc_id") % 40).alias("g"), F.floor(F.col("n_chars") / 1000).alias("k"))
    return ag.plurality(docs, ["g"], "k", F.lit(1))


@add(
    "a26_majority_remainder",
    "WITH c AS (SELECT o_custkey, (o_orderkey * 4 + CASE WHEN o_orderkey % 29 = 0 THEN 1 ELSE 0 END) % 4 AS remainder, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, remainder, n, total FROM (SELECT *, (sum(n) OVER (PARTITION BY o_custkey))::BIGINT AS total FROM c) WHERE n >= 0.9 * total",
)
def a26(spark: SparkSession, root: str) -> DataFrame:
    value = F.col("o_orderkey") * 4 + F.when(F.col("o_orderkey") % 29 == 0, 1).otherwise(0)
    return ag.majority_remainder(table(spark, root, "orders"), ["o_custkey"], value)


@add("a27_median_step", "WITH s AS (SELECT o_custkey, o_orderkey - lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders) SELECT o_custkey, median(step) AS median FROM s WHERE step IS NOT NULL GROUP BY 1")
def a27(spark: SparkSession, root: str) -> DataFrame:
    step = F.col("o_orderkey") - F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return ag.nearest_rank_median(table(spark, root, "orders").select("o_custkey", step.alias("step")).where("step IS NOT NULL"), ["o_custkey"], "step")


@add("a28_best_status", "SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'signup' THEN 4 WHEN 'click' THEN 3 WHEN 'view' THEN 2 ELSE 1 END) AS rank FROM events GROUP BY 1")
def a28(spark: SparkSession, root: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "signup", 4).when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 2).otherwise(1)
    return table(spark, root, "events").groupBy("user_id").agg(F.max(rank).alias("rank"))


@add("a29_model_stamp")
def a29(spark: SparkSession, root: str) -> DataFrame:
    return ag.stamp(table(spark, root, "orders"), ["o_orderkey"])


@add(
    "a30_health_rollup",
    "SELECT count(*) FILTER (o_orderstatus = 'F') AS failed, count(*) FILTER (o_orderstatus = 'P') AS partial, CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'failed' WHEN count(*) FILTER (o_orderstatus = 'P') > 0 THEN 'partial' ELSE 'ok' END AS status, o_orderpriority FROM orders GROUP BY o_orderpriority",
)
def a30(spark: SparkSession, root: str) -> DataFrame:
    failed, partial = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus") == "P")
    return table(spark, root, "orders").groupBy("o_orderpriority").agg(failed.alias("failed"), partial.alias("partial"), F.when(failed > 0, "failed").when(partial > 0, "partial").otherwise("ok").alias("status"))


@add(
    "a31_coverage",
    "SELECT count(*) AS referenced, count(o.o_custkey) AS resolved, count(o.o_custkey) / count(*) AS ratio, c_mktsegment FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) o ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def a31(spark: SparkSession, root: str) -> DataFrame:
    used = table(spark, root, "orders").select("o_custkey").distinct()
    met = table(spark, root, "customer").join(used, F.col("o_custkey") == F.col("c_custkey"), "left")
    return met.groupBy("c_mktsegment").agg(F.count("*").alias("referenced"), F.count("o_custkey").alias("resolved"), (F.count("o_custkey") / F.count("*")).alias("ratio"))


@add(
    "a32_risk_levels",
    "SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, CASE WHEN count(*) FILTER (o_orderpriority = '1-URGENT') > 0 THEN 'critical' WHEN count(*) FILTER (o_orderpriority = '2-HIGH') > 0 THEN 'high' ELSE 'low' END AS overall FROM orders GROUP BY 1",
)
def a32(spark: SparkSession, root: str) -> DataFrame:
    critical, high = F.count_if(F.col("o_orderpriority") == "1-URGENT"), F.count_if(F.col("o_orderpriority") == "2-HIGH")
    return table(spark, root, "orders").groupBy("o_custkey").agg(critical.alias("critical"), F.when(critical > 0, "critical").when(high > 0, "high").otherwise("low").alias("overall"))


@add("a33_effort_with_fixed_cost", "SELECT l_returnflag, (sum(l_linenumber) + 100 * count(DISTINCT l_suppkey))::BIGINT AS effort FROM lineitem GROUP BY 1")
def a33(spark: SparkSession, root: str) -> DataFrame:
    """The fixed cost of a supplier counts once per phase: per (phase, supplier) first, then per phase."""
    per = table(spark, root, "lineitem").groupBy("l_returnflag", "l_suppkey").agg(F.sum("l_linenumber").alias("work"))
    return per.groupBy("l_returnflag").agg(F.sum(F.col("work") + 100).alias("effort"))


@add(
    "a34_progress",
    "WITH s AS (SELECT o_custkey, arg_max(o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS state FROM orders GROUP BY 1) SELECT state, count(*) AS n, round_even(100.0 * count(*) / sum(count(*)) OVER (), 2)::DOUBLE AS percent FROM s GROUP BY 1",
)
def a34(spark: SparkSession, root: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    states = table(spark, root, "orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", rank).alias("state")).groupBy("state").agg(F.count("*").alias("n"))
    return states.select("state", "n", F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2).alias("percent"))  # one row per state


@add(
    "a35_precision_recall",
    """WITH f AS (SELECT doc_id, quality = 1 AS truth, n_chars > 400 AS said, lang FROM labels JOIN documents USING (doc_id)), m AS (SELECT lang, count(*) FILTER (truth AND said) AS tp, count(*) FILTER (said) AS said, count(*) FILTER (truth) AS truth FROM f GROUP BY 1)
    SELECT sum(tp) / sum(said) AS precision, sum(tp) / sum(truth) AS recall FROM m""",
)
def a35(spark: SparkSession, root: str) -> DataFrame:
    met = table(spark, root, "labels").join(table(spark, root, "documents").select("doc_id", "n_chars"), "doc_id")
    truth, said = F.col("quality") == 1, F.col("n_chars") > 400
    return met.agg((F.count_if(truth & said) / F.count_if(said)).alias("precision"), (F.count_if(truth & said) / F.count_if(truth)).alias("recall"))


@add("a36_distinct_signatures", "SELECT p_type, count(DISTINCT lower(p_name)) AS signatures, count(*) AS findings FROM part GROUP BY 1")
def a36(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "part").groupBy("p_type").agg(F.count_distinct(F.lower("p_name")).alias("signatures"), F.count("*").alias("findings"))
