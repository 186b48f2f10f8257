"""Queries of the joins (J*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import joins
from weftline.operators.lines import squeezed
from weftline.plans.registry import Registry
from weftline.plans.usage import dec
from weftline.sources.tables import table

registry = Registry()


@registry.add("j1_inner_equi", "SELECT o_orderkey, c_name, o_orderdate FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey")
def j1(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.select("o_orderkey", "c_name", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


@registry.add("j2_inner_filtered", "SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_returnflag = 'R'")
def j2(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part").where("p_size < 10")
    return table(spark, root, "lineitem").where("l_returnflag = 'R'").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


@registry.add(
    "j3_left_outer_rollup",
    """SELECT c_custkey, count(o_orderkey) AS runs, coalesce(sum(o_totalprice::DECIMAL(18,4)), 0)::DOUBLE AS cost FROM customer LEFT JOIN orders ON o_custkey = c_custkey
    WHERE c_acctbal > 0 OR o_orderkey IS NOT NULL GROUP BY c_custkey""",
)
def j3(spark: SparkSession, root: str) -> DataFrame:
    met = table(spark, root, "customer").join(table(spark, root, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left")
    kept = met.where((F.col("c_acctbal") > 0) | F.col("o_orderkey").isNotNull())
    return kept.groupBy("c_custkey").agg(F.count("o_orderkey").alias("runs"), F.coalesce(F.sum(dec("o_totalprice")), F.lit(0)).cast("double").alias("cost"))


@registry.add("j4_three_way_distinct", "SELECT DISTINCT l_suppkey, c_mktsegment FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'")
def j4(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders").where("o_orderstatus = 'O'")
    met = table(spark, root, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, root, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return met.select("l_suppkey", "c_mktsegment").distinct()


@registry.add(
    "j5_later_duplicates",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1""",
)
def j5(spark: SparkSession, root: str) -> DataFrame:
    first = W.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return table(spark, root, "lineitem").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@registry.add(
    "j6_innermost_span",
    """WITH s AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey % 1000 AS lo, o_orderkey % 1000 + o_custkey % 97 AS hi FROM orders),
    p AS (SELECT DISTINCT o_custkey AS k, (o_orderkey * 7) % 1000 AS line FROM orders)
    SELECT k, line, arg_min(id, (hi - lo) * 1000000000 + id) AS id FROM p JOIN s USING (k) WHERE lo <= line AND line <= hi GROUP BY k, line""",
)
def j6(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    low = F.col("o_orderkey") % 1000
    spans = orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), low.alias("lo"), (low + F.col("o_custkey") % 97).alias("hi"))
    points = orders.select(F.col("o_custkey").alias("k"), ((F.col("o_orderkey") * 7) % 1000).alias("line")).distinct()
    return joins.narrowest_span(points, spans, "k", "line", "lo", "hi", "id")


@registry.add("j7_semi", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j7(spark: SparkSession, root: str) -> DataFrame:
    done = table(spark, root, "orders").where("o_orderstatus = 'F'")
    return table(spark, root, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@registry.add("j8_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j8(spark: SparkSession, root: str) -> DataFrame:
    large = table(spark, root, "orders").where("o_totalprice > 300000")
    return table(spark, root, "customer").join(large, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@registry.add(
    "j9_guarded_lookup",
    """WITH p AS (SELECT p_partkey, p_name, p_brand, upper(regexp_extract(p_name, '[^ ]*$')) AS short FROM part), a AS (SELECT p_name AS k, min(p_partkey) AS m FROM p GROUP BY 1 HAVING count(*) = 1),
    b AS (SELECT short || p_brand AS k, min(p_partkey) AS m FROM p GROUP BY 1 HAVING count(*) = 1)
    SELECT p_partkey, coalesce(a.m, b.m) AS match FROM p LEFT JOIN a ON a.k = p_name LEFT JOIN b ON b.k = short || p_brand""",
)
def j9(spark: SparkSession, root: str) -> DataFrame:
    short = F.upper(F.regexp_extract("p_name", "[^ ]*$", 0))
    keys = [F.col("p_name"), F.concat(short, "p_brand")]
    part = table(spark, root, "part").select("p_partkey", "p_name", "p_brand")
    return joins.only_candidate(part, part.withColumnRenamed("p_partkey", "id"), keys, keys, "id").select("p_partkey", "match")


@registry.add(
    "j10_multi_key_link",
    "SELECT l_orderkey, l_linenumber, p_partkey, s_suppkey FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey AND p_size % 5 = s_nationkey % 5",
)
def j10(spark: SparkSession, root: str) -> DataFrame:
    part, supplier = table(spark, root, "part"), table(spark, root, "supplier")
    met = table(spark, root, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    met = met.join(supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("p_size") % 5 == F.col("s_nationkey") % 5))
    return met.select("l_orderkey", "l_linenumber", "p_partkey", "s_suppkey")


@registry.add(
    "j11_text_key_link",
    r"""WITH k AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '([A-Za-z_]+) = ', 1))) AS key FROM documents)
    SELECT k.doc_id, k.key, e.n FROM k JOIN (SELECT 'token' AS key, count(*) AS n FROM events WHERE event_type = 'error') e USING (key)""",
)
def j11(spark: SparkSession, root: str) -> DataFrame:
    keys = table(spark, root, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_]+) = "), F.lit(1))).alias("key"))
    items = table(spark, root, "events").where("event_type = 'error'").agg(F.count("*").alias("n")).select(F.lit("token").alias("key"), "n")
    return keys.select("doc_id", F.lower("key").alias("key")).distinct().join(items, "key").select("doc_id", "key", "n")


@registry.add(
    "j12_similarity_best",
    r"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS text FROM part), r AS (SELECT text, min(p_partkey) AS b_id FROM p WHERE p_partkey % 2 = 1 GROUP BY 1),
    a AS (SELECT p_partkey AS a_id, len(list_distinct(string_split(text, ' '))) AS na, unnest(list_distinct(string_split(text, ' '))) AS tok FROM p WHERE p_partkey % 2 = 0), b AS (SELECT b_id, len(list_distinct(string_split(text, ' '))) AS nb, unnest(list_distinct(string_split(text, ' '))) AS tok FROM r),
    s AS (SELECT a_id, b_id, count(*) / (any_value(na) + any_value(nb) - count(*)) AS score FROM a JOIN b USING (tok) GROUP BY 1, 2)
    SELECT a_id, b_id, score FROM s WHERE score >= 0.4 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1""",
)
def j12(spark: SparkSession, root: str) -> DataFrame:
    """The words of each part of one half (the left table) find their best match among the different ones of the other half."""
    parts = table(spark, root, "part").select("p_partkey", F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("text"))
    left = parts.where("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "a_id")
    right = parts.where("p_partkey % 2 = 1").groupBy("text").agg(F.min("p_partkey").alias("b_id"))
    return joins.best_by_jaccard(left, right, "a_id", "b_id", "text", 0.4)


@registry.add(
    "j14_passages_in_documents",
    r"""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT item_id, doc_id FROM b JOIN d ON contains(d.t, b.q)""",
)
def j14(spark: SparkSession, root: str) -> DataFrame:
    return joins.contained_passages(table(spark, root, "benchmark"), table(spark, root, "documents"), "item_id", "doc_id", "text", "text")


@registry.add(
    "j15_drift_pairs",
    """WITH c AS (SELECT l_suppkey AS o, l_partkey % 40 AS n, max(l_linenumber) AS v FROM lineitem GROUP BY ALL)
    SELECT x.o AS a, y.o AS b, count(*) AS common, count(*) FILTER (x.v <> y.v) AS differ FROM c x JOIN c y ON x.n = y.n AND x.o < y.o GROUP BY ALL HAVING differ >= 3 AND differ >= 0.5 * common""",
)
def j15(spark: SparkSession, root: str) -> DataFrame:
    cells = table(spark, root, "lineitem").groupBy(F.col("l_suppkey").alias("o"), (F.col("l_partkey") % 40).alias("n")).agg(F.max("l_linenumber").alias("v"))
    return joins.drift_pairs(cells, "o", "n", "v")


@registry.add(
    "j16_prefix_names",
    "WITH n AS (SELECT DISTINCT lower(p_type) AS long FROM part UNION SELECT DISTINCT left(lower(p_type), 5) FROM part) SELECT a.long AS short, b.long FROM n a JOIN n b ON starts_with(b.long, a.long) AND a.long <> b.long WHERE length(a.long) >= 5",
)
def j16(spark: SparkSession, root: str) -> DataFrame:
    types = table(spark, root, "part").select(F.lower("p_type").alias("name"))
    return joins.prefix_pairs(types.unionAll(types.select(F.left("name", F.lit(5)))), "name")


@registry.add(
    "j17_longest_prefix",
    """WITH r AS (SELECT left(p_type, n) AS prefix, min(p_size)::INTEGER AS price FROM part, (VALUES (2), (5), (9)) v(n) WHERE length(p_type) > n GROUP BY 1)
    SELECT p_partkey, (SELECT arg_max(price, length(prefix)) FROM r WHERE starts_with(p_type, prefix)) AS price FROM part""",
)
def j17(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    spelled = part.select("p_type", "p_size", F.explode(F.array(F.lit(2), F.lit(5), F.lit(9))).alias("n")).where("length(p_type) > n")
    prices = spelled.groupBy(F.expr("left(p_type, n)").alias("prefix")).agg(F.min("p_size").alias("price"))
    return joins.longest_prefix(part.select("p_partkey", "p_type"), prices, "p_type", "prefix", "price").select("p_partkey", "price")


@registry.add(
    "j18_missing_references",
    r"""WITH u AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages) SELECT link FROM u WHERE link NOT IN (SELECT url FROM pages)""",
)
def j18(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "pages")
    used = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link")).distinct()
    return used.join(pages.select(F.col("url").alias("link")), "link", "left_anti")


@registry.add(
    "j21_status_carried",
    """WITH o AS (SELECT o_custkey % 50 AS s, o_orderpriority AS l, o_orderstatus AS st FROM orders WHERE o_orderkey % 3 = 0), n AS (SELECT o_orderkey, o_custkey % 90 AS s, o_orderpriority AS l, 'new' AS st FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT o_orderkey, coalesce((SELECT min(st) FROM o WHERE o.s = n.s), (SELECT min(st) FROM o WHERE o.l = n.l), n.st) AS st FROM n""",
)
def j21(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders")
    old = orders.where("o_orderkey % 3 = 0").select((F.col("o_custkey") % 50).alias("s"), F.col("o_orderpriority").alias("l"), F.col("o_orderstatus").alias("st"))
    new = orders.where("o_orderkey % 3 <> 0").select("o_orderkey", (F.col("o_custkey") % 90).alias("s"), F.col("o_orderpriority").alias("l"), F.lit("new").alias("st"))
    return joins.carried_status(new, old, "s", "l", "st").select("o_orderkey", "st")


@registry.add(
    "j_asof_addition",
    """SELECT e.event_id, arg_max(p.value, p.ts) AS last_value FROM events e LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL) p ON p.user_id = e.user_id AND p.ts <= e.ts
    WHERE e.event_type = 'click' GROUP BY 1""",
)
def j_asof(spark: SparkSession, root: str) -> DataFrame:
    events = table(spark, root, "events")
    bought = events.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    clicks = events.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.asof(clicks, bought, ["user_id"], "ts", "ts", "last_value").select("event_id", "last_value")
