"""Queries of graph operators (G*, U6) and mutations (M*) on trees and edges made of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import changes, graph
from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()
add = registry.add


def edges(spark: SparkSession, root: str) -> DataFrame:
    """customer -> supplier by orders: id, from_id, to_id, kind."""
    items = table(spark, root, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_returnflag").distinct()
    met = items.join(table(spark, root, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    kind = F.when(F.col("l_returnflag") == "R", "reads").when(F.col("l_returnflag") == "A", "writes").otherwise("calls")
    return met.groupBy((F.col("o_custkey") + 100000).alias("from_id"), F.col("l_suppkey").alias("to_id"), kind.alias("kind")).agg(F.min("l_orderkey").alias("id"))


EDGES = "e AS (SELECT o_custkey + 100000 AS from_id, l_suppkey AS to_id, CASE l_returnflag WHEN 'R' THEN 'reads' WHEN 'A' THEN 'writes' ELSE 'calls' END AS kind, min(l_orderkey) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 GROUP BY ALL)"


def tree(spark: SparkSession, root: str) -> DataFrame:
    """(parent, child) of region -> nation -> customer; ids of the levels apart by a million."""
    nation = table(spark, root, "nation").select(F.col("n_regionkey").cast("long").alias("parent"), (F.col("n_nationkey") + 1_000_000).cast("long").alias("child"))
    return nation.unionAll(table(spark, root, "customer").select((F.col("c_nationkey") + 1_000_000).cast("long"), F.col("c_custkey") + 2_000_000))


@add("g1_neighbours", f"WITH {EDGES} SELECT DISTINCT from_id AS node, 'in' AS direction, kind FROM e WHERE to_id = 7 UNION SELECT to_id, 'out', kind FROM e WHERE from_id = 7")
def g1(spark: SparkSession, root: str) -> DataFrame:
    return graph.neighbours(edges(spark, root), 7)


def _calls(spark: SparkSession, root: str) -> DataFrame:
    """A forest with terminals: nations call customers by number; customers with a large balance write a store."""
    customer = table(spark, root, "customer")
    calls = customer.where("c_custkey > 1").select(F.floor(F.col("c_custkey") / 3).alias("from_id"), F.col("c_custkey").alias("to_id"), F.lit("calls").alias("kind"), F.col("c_custkey").alias("id"))
    ends = customer.where("c_acctbal > 9500").select(F.col("c_custkey"), (F.col("c_custkey") + 5_000_000), F.lit("writes"), F.col("c_custkey") + 5_000_000)
    return calls.unionAll(ends).where("from_id > 0")


@add(
    "g2_flows",
    """WITH RECURSIVE c AS (SELECT c_custkey // 3 AS f, c_custkey AS t FROM customer WHERE c_custkey > 1 AND c_custkey // 3 > 0), r AS (SELECT v AS entry, v AS node, 0 AS d FROM (VALUES (1::BIGINT), (2)) x(v) UNION ALL SELECT entry, t, d + 1 FROM r JOIN c ON f = node WHERE d < 11)
    SELECT entry, c_custkey + 5000000 AS target, 'writes' AS access, d + 1 AS length FROM r JOIN customer ON node = c_custkey WHERE c_acctbal > 9500""",
)
def g2(spark: SparkSession, root: str) -> DataFrame:
    entries = spark.range(1, 3).select(F.col("id").alias("node"))
    return graph.flows(_calls(spark, root), entries, ["calls"], ["writes"]).drop("path")


@add(
    "g3_simple_paths",
    """WITH RECURSIVE c AS (SELECT c_custkey // 3 AS f, c_custkey AS t FROM customer WHERE c_custkey > 1 AND c_custkey // 3 > 0), r AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS node, 0 AS d UNION ALL SELECT list_append(path, t), t, d + 1 FROM r JOIN c ON f = node WHERE d < 10 AND NOT list_contains(path, t))
    SELECT path, node FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE f = node) OR d = 10""",
)
def g3(spark: SparkSession, root: str) -> DataFrame:
    calls = _calls(spark, root).where("kind = 'calls'")
    return graph.simple_paths(calls, spark.range(1, 2).select(F.col("id").alias("node")))


@add("g4_canonical", "SELECT c_custkey AS node, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 50 = c_custkey % 50 AND c_custkey % 2 = 0), c_custkey) AS canonical FROM customer")
def g4(spark: SparkSession, root: str) -> DataFrame:
    nodes = table(spark, root, "customer").select(F.col("c_custkey").alias("node"))
    first = table(spark, root, "supplier").groupBy((F.col("s_suppkey") % 50).alias("r")).agg(F.min("s_suppkey").alias("to_id"))
    same = nodes.where("node % 2 = 0").join(first, F.col("node") % 50 == F.col("r")).select(F.col("node").alias("from_id"), "to_id")
    return graph.canonical(nodes, same)


@add("g5_nearest_ancestor", "SELECT c_custkey + 2000000 AS node, n_regionkey::BIGINT AS ancestor FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey::BIGINT + 1000000, n_regionkey FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_regionkey FROM region")
def g5(spark: SparkSession, root: str) -> DataFrame:
    links = tree(spark, root)
    nodes = links.select(F.col("child").alias("node")).unionAll(table(spark, root, "region").select(F.col("r_regionkey").cast("long")))
    kind = F.when(F.col("node") < 1_000_000, "region").when(F.col("node") < 2_000_000, "nation").otherwise("customer")
    return graph.nearest_ancestor(links, nodes.select("node", kind.alias("kind")), "region")


@add("g6_descendants", "SELECT r_regionkey::BIGINT AS root, r_regionkey::BIGINT AS node, 0 AS depth FROM region UNION ALL SELECT n_regionkey, n_nationkey + 1000000, 1 FROM nation UNION ALL SELECT n_regionkey, c_custkey + 2000000, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g6(spark: SparkSession, root: str) -> DataFrame:
    return graph.closure(tree(spark, root), table(spark, root, "region").select(F.col("r_regionkey").cast("long").alias("node")))


@add(
    "u6_subtree",
    "WITH RECURSIVE t AS (SELECT n_nationkey::BIGINT + 1000000 AS node FROM nation WHERE n_nationkey = 3 UNION ALL SELECT c_custkey + 2000000 FROM customer JOIN t ON node = c_nationkey + 1000000) SELECT node FROM t",
)
def u6(spark: SparkSession, root: str) -> DataFrame:
    tree(spark, root).createOrReplaceTempView("weftline_tree")
    return spark.sql("WITH RECURSIVE t(node) AS (SELECT 1000003L UNION ALL SELECT child FROM weftline_tree JOIN t ON parent = node) SELECT node FROM t")


@add("g7_longest_ranks", "WITH RECURSIVE r AS (SELECT c_custkey AS node, 0 AS d FROM customer WHERE c_custkey > 0 UNION ALL SELECT c_custkey, d + 1 FROM r JOIN customer ON c_custkey // 3 = node AND c_custkey > 1) SELECT node, max(d)::INTEGER AS rank FROM r GROUP BY 1")
def g7(spark: SparkSession, root: str) -> DataFrame:
    """The calls, with an edge back from every node to its caller's caller in the way: these close cycles and are left out."""
    calls = _calls(spark, root).where("kind = 'calls'").select("from_id", "to_id")
    a, b = calls.alias("a"), calls.alias("b")
    back = a.hint("merge").join(b, F.col("a.to_id") == F.col("b.from_id")).select(F.col("b.to_id").alias("from_id"), F.col("a.from_id").alias("to_id"))
    return graph.ranks_without_cycles(calls.unionAll(back))


@add("g8_component_graph", f"WITH {EDGES} SELECT c_nationkey AS source, s_nationkey AS target, list_sort(list_distinct(list(kind))) AS kinds FROM e JOIN customer ON from_id = c_custkey + 100000 JOIN supplier ON to_id = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL")
def g8(spark: SparkSession, root: str) -> DataFrame:
    owner = table(spark, root, "customer").select((F.col("c_custkey") + 100000).alias("node"), F.col("c_nationkey").alias("owner")).unionAll(table(spark, root, "supplier").select("s_suppkey", "s_nationkey"))
    return graph.lifted(edges(spark, root), owner)


@add("g9_store_lineage", f"WITH {EDGES} SELECT to_id AS store, count(DISTINCT CASE WHEN kind = 'writes' THEN from_id END) AS n_in, count(DISTINCT CASE WHEN kind = 'reads' THEN from_id END) AS n_out FROM e WHERE kind <> 'calls' GROUP BY 1")
def g9(spark: SparkSession, root: str) -> DataFrame:
    return graph.store_lineage(edges(spark, root))


@add("g10_degree", f"WITH {EDGES} SELECT node, count(*) AS degree FROM (SELECT from_id AS node FROM e UNION ALL SELECT to_id FROM e) GROUP BY 1")
def g10(spark: SparkSession, root: str) -> DataFrame:
    from weftline.operators.ordering import degrees

    return degrees(edges(spark, root), "from_id", "to_id")


@add("g12_interaction_sequence")
def g12(spark: SparkSession, root: str) -> DataFrame:
    entries = spark.range(1, 3).select(F.col("id").alias("node"))
    return graph.sequences(graph.flows(_calls(spark, root), entries, ["calls"], ["writes"]))


ENTITIES = "SELECT p_partkey::VARCHAR AS key, p_name AS name, CASE p_size % 4 WHEN 0 THEN 'placeholder' WHEN 1 THEN 'corrected' ELSE 'extracted' END AS origin, p_retailprice AS confidence, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS line_start"


@add(
    "m1_merging_upsert",
    f"""WITH a AS ({ENTITIES} FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT key, upper(name) AS name, CASE WHEN origin = 'placeholder' THEN 'extracted' WHEN origin = 'extracted' THEN 'placeholder' ELSE origin END AS origin, confidence + 10 AS confidence, line_start FROM ({ENTITIES} FROM part WHERE p_partkey % 3 <> 1)),
    m AS (SELECT a.key AS ak, b.key AS bk, a.origin AS ao, b.origin AS bo, a.name AS an, b.name AS bn, a.confidence AS ac, b.confidence AS bc, a.line_start AS al, b.line_start AS bl FROM a FULL JOIN b ON a.key = b.key),
    s AS (SELECT *, CASE WHEN ak IS NULL THEN 'new' WHEN bk IS NULL OR ao = 'corrected' OR bo = 'placeholder' THEN 'old' WHEN ao = 'placeholder' THEN 'up' ELSE 'merge' END AS c FROM m)
    SELECT coalesce(ak, bk) AS key, CASE WHEN c IN ('new', 'up') THEN bn ELSE an END AS name, CASE WHEN c IN ('new', 'up') OR (c = 'merge' AND bo = 'corrected') THEN bo ELSE ao END AS origin, CASE c WHEN 'new' THEN bc WHEN 'old' THEN ac ELSE greatest(ac, bc) END AS confidence,
    CASE WHEN c IN ('new', 'up') THEN bl WHEN c = 'old' THEN al ELSE coalesce(al, bl) END AS line_start FROM s""",
)
def m1(spark: SparkSession, root: str) -> DataFrame:
    size = F.col("p_size") % 4
    rows = table(spark, root, "part").select(
        F.col("p_partkey").cast("string").alias("key"),
        F.col("p_name").alias("name"),
        F.when(size == 0, "placeholder").when(size == 1, "corrected").otherwise("extracted").alias("origin"),
        F.col("p_retailprice").alias("confidence"),
        F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_size")).alias("line_start"),
        F.create_map(F.lit("brand"), "p_brand").alias("attrs"),
        "p_partkey",
    )
    other = F.when(F.col("origin") == "placeholder", "extracted").when(F.col("origin") == "extracted", "placeholder").otherwise(F.col("origin"))
    new = rows.where("p_partkey % 3 <> 1").withColumns({"name": F.upper("name"), "origin": other, "confidence": F.col("confidence") + 10})
    return changes.merged_upsert(rows.where("p_partkey % 3 <> 0"), new).drop("attrs")


@add(
    "m2_idempotent_relations",
    "WITH o AS (SELECT DISTINCT 'calls' AS kind, o_custkey AS from_id, o_orderkey % 100 AS to_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 5 END AS artifact_id FROM orders WHERE o_orderstatus = 'F'), n AS (SELECT DISTINCT 'calls' AS kind, o_custkey AS from_id, o_orderkey % 100 AS to_id, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 5 END AS artifact_id FROM orders WHERE o_orderstatus <> 'F') SELECT * FROM o UNION SELECT * FROM n",
)
def m2(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "orders").select("o_orderstatus", F.lit("calls").alias("kind"), F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") % 100).alias("to_id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 5).alias("artifact_id"))
    old = rows.where("o_orderstatus = 'F'").drop("o_orderstatus").distinct()
    return changes.inserted_relations(old, rows.where("o_orderstatus <> 'F'").drop("o_orderstatus"))


@add(
    "m3_merged_entities",
    f"WITH {EDGES}, m AS (SELECT CASE WHEN from_id % 10 = 0 THEN 100001 ELSE from_id END AS f, CASE WHEN to_id % 7 = 0 THEN 1 ELSE to_id END AS t, kind, id FROM e) SELECT f AS from_id, t AS to_id, kind, min(id) AS id FROM m WHERE f <> t GROUP BY ALL",
)
def m3(spark: SparkSession, root: str) -> DataFrame:
    rows = edges(spark, root).withColumn("artifact_id", F.lit(None).cast("long"))
    nodes = rows.select(F.col("from_id").alias("source")).distinct().where("source % 10 = 0").withColumn("target", F.lit(100001).cast("long"))
    more = rows.select(F.col("to_id").alias("source")).distinct().where("source % 7 = 0").withColumn("target", F.lit(1).cast("long"))
    return changes.merged_entities(rows, nodes.unionAll(more)).select("from_id", "to_id", "kind", "id")


@add("m4_retract_artifact")
def m4(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    entities = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 5 == 0, "corrected").otherwise("extracted").alias("origin"), (F.col("p_partkey") % 20).alias("artifact_id"), F.col("p_size").alias("line_start"), (F.col("p_size") + 5).alias("line_end"))
    sources = part.select(F.col("p_partkey").alias("entity_id"), F.explode(F.array(F.col("p_partkey") % 20, F.col("p_partkey") % 7)).alias("artifact_id"), F.col("p_size").alias("line_start"), (F.col("p_size") + 5).alias("line_end"))
    links = table(spark, root, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"), (F.col("l_partkey") % 20).alias("artifact_id"), F.lit("extracted").alias("origin")).distinct()
    return changes.retracted(entities, sources, links, 13)[0]


@add(
    "m6_replayed_log",
    """WITH l AS (SELECT event_id AS id, user_id AS target, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'set' END AS op, event_type AS field, value FROM events WHERE event_type <> 'view'), c AS (SELECT target, max(id) AS cleared FROM l WHERE op = 'delete' GROUP BY 1),
    s AS (SELECT target, field, arg_max(value, id) AS value, max(id) AS pos FROM l WHERE op = 'set' GROUP BY ALL) SELECT target, field, value FROM s LEFT JOIN c USING (target) WHERE cleared IS NULL OR pos > cleared""",
)
def m6(spark: SparkSession, root: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").otherwise("set")
    log = table(spark, root, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("target"), op.alias("op"), F.col("event_type").alias("field"), "value", (F.col("event_type") != "view").alias("active"))
    return changes.replayed(log)


@add("m8_optimistic_replace", "SELECT doc_id AS id, sha256(CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE text END) AS sha, doc_id % 2 = 0 AS replaced FROM documents")
def m8(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select(F.col("doc_id").alias("id"), "text")
    base = F.when(F.col("id") % 2 == 0, F.sha2("text", 256)).otherwise(F.lit("stale"))
    proposed = docs.select("id", F.lower("text").alias("text"), base.alias("base_sha"))
    return changes.replaced_if_unchanged(docs, proposed).select("id", F.sha2("text", 256).alias("sha"), "replaced")


@add("m9_rename", "SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'TINY' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS p_type FROM part")
def m9(spark: SparkSession, root: str) -> DataFrame:
    names = spark.sql("SELECT * FROM VALUES ('SMALL', 'TINY'), ('PROMO', 'OFFER') AS n(old, new)")
    return changes.renamed(table(spark, root, "part").select("p_partkey", "p_type"), names, "p_type")


@add("g3_dead_ends", "WITH n AS (SELECT c_custkey AS node FROM customer), e AS (SELECT o_custkey AS f, (o_orderkey * 7) % 3000 AS t FROM orders WHERE o_orderstatus = 'P') SELECT node, 'dead end' AS reason FROM n WHERE node NOT IN (SELECT f FROM e) UNION ALL SELECT node, 'orphan' FROM n WHERE node NOT IN (SELECT t FROM e)")
def g3_dead_ends(spark: SparkSession, root: str) -> DataFrame:
    links = table(spark, root, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("from_id"), (F.col("o_orderkey") * 7 % 3000).alias("to_id"))
    return graph.dead_ends(links, table(spark, root, "customer").select(F.col("c_custkey").alias("node")))
