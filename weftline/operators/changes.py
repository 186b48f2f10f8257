"""Mutations as snapshot-to-snapshot functions (M*): nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """M1: entities (key, name, origin, confidence, line_start, attrs as map) after an upsert by key.

    A corrected row never changes and a new placeholder changes nothing; a placeholder becomes real
    with the new name and span; else attributes merge (new wins), confidence is the larger, and the
    old span stays where there is one.
    """
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, F.col("a.key") == F.col("b.key"), "full_outer")
    c = F.col
    fresh, gone = c("a.key").isNull(), c("b.key").isNull()
    frozen = gone | (c("a.origin") == "corrected") | (c("b.origin") == "placeholder")
    upgrade = c("a.origin") == "placeholder"
    attrs = F.map_concat(F.map_filter(c("a.attrs"), lambda k, v: ~F.array_contains(F.map_keys(c("b.attrs")), k)), c("b.attrs"))
    pick = lambda name, merged: F.when(fresh, c(f"b.{name}")).when(frozen, c(f"a.{name}")).otherwise(merged).alias(name)
    return met.select(
        F.coalesce("a.key", "b.key").alias("key"),
        pick("name", F.when(upgrade, c("b.name")).otherwise(c("a.name"))),
        pick("origin", F.when((c("b.origin") == "corrected") | upgrade, c("b.origin")).otherwise(c("a.origin"))),
        pick("confidence", F.greatest("a.confidence", "b.confidence")),
        pick("line_start", F.when(upgrade, c("b.line_start")).otherwise(F.coalesce("a.line_start", "b.line_start"))),
        pick("attrs", attrs),
    )


def inserted_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2: old relations and those new ones whose (kind, from_id, to_id, artifact_id), null equal to null, is not there yet."""
    keys = ["kind", "from_id", "to_id", "artifact_id"]
    first = new.dropDuplicates(keys).alias("n")
    same = None
    for k in keys:
        same = F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) if same is None else same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
    return old.unionByName(first.join(old.select(*keys).alias("o"), same, "left_anti"))


def merged_entities(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """M3: edges re-pointed by (source, target) of `merged`, without self-loops and later duplicates."""
    a, b = merged.select(F.col("source").alias("__s"), F.col("target").alias("__t")), merged.select(F.col("source").alias("__s2"), F.col("target").alias("__t2"))
    moved = edges.join(a, F.col("from_id") == F.col("__s"), "left").join(b, F.col("to_id") == F.col("__s2"), "left")
    moved = moved.withColumns({"from_id": F.coalesce("__t", "from_id"), "to_id": F.coalesce("__t2", "to_id")}).drop("__s", "__t", "__s2", "__t2").where("from_id <> to_id")
    first = W.partitionBy("kind", "from_id", "to_id", "artifact_id").orderBy("id")
    return moved.withColumn("__rank", F.row_number().over(first)).where("__rank = 1").drop("__rank")


def retracted(entities: DataFrame, sources: DataFrame, edges: DataFrame, artifact: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: (entities, sources, edges) without one artifact.

    Its edges go, except corrected ones. An extracted or inferred entity it touched is re-homed to
    its first other source, else becomes a placeholder when an edge still names it, else goes.
    """
    kept_edges = edges.where((F.col("artifact_id").isNull()) | (F.col("artifact_id") != artifact) | (F.col("origin") == "corrected"))
    kept_sources = sources.where(F.col("artifact_id") != artifact)
    touched = sources.where(F.col("artifact_id") == artifact).select("entity_id").union(entities.where(F.col("artifact_id") == artifact).select("id")).distinct().withColumn("__touched", F.lit(True))
    other = kept_sources.groupBy("entity_id").agg(F.min(F.struct("artifact_id", "line_start", "line_end")).alias("__other"))
    named = kept_edges.select(F.col("from_id").alias("entity_id")).union(kept_edges.select("to_id")).distinct().withColumn("__named", F.lit(True))
    e = entities
    for side in (touched, other, named):
        e = e.join(side.withColumnRenamed("entity_id", "__id"), F.col("id") == F.col("__id"), "left").drop("__id")
    affected = F.coalesce("__touched", F.lit(False)) & F.col("origin").isin("extracted", "inferred")
    home = affected & F.col("__other").isNotNull() & (F.col("artifact_id") == artifact)
    lost = affected & F.col("__other").isNull()
    e = e.where(~(lost & F.col("__named").isNull()))
    where = lambda name: F.when(home, F.col(f"__other.{name}")).when(lost, F.lit(None)).otherwise(F.col(name))
    e = e.withColumns({"origin": F.when(lost, "placeholder").otherwise(F.col("origin")), **{n: where(n) for n in ("artifact_id", "line_start", "line_end")}})
    return e.select(*entities.columns), kept_sources, kept_edges


def replayed(log: DataFrame) -> DataFrame:
    """M6, M7: (target, field, value) after replaying active operations in id order: the last one on a field wins, a delete clears its target."""
    live = log.where("active")
    cleared = live.where("op = 'delete'").groupBy("target").agg(F.max("id").alias("__cleared"))
    sets = live.where("op = 'set'").groupBy("target", "field").agg(F.max_by("value", "id").alias("value"), F.max("id").alias("__at"))
    return sets.join(cleared, "target", "left").where(F.col("__cleared").isNull() | (F.col("__at") > F.col("__cleared"))).select("target", "field", "value")


def replaced_if_unchanged(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """M8: (id, text) after an optimistic replace: a proposal counts only while the text it was made on is still there."""
    met = current.alias("c").join(proposed.alias("p"), F.col("c.id") == F.col("p.id"), "left")
    same = F.sha2("c.text", 256) == F.col("p.base_sha")
    return met.select("c.id", F.when(same, F.col("p.text")).otherwise(F.col("c.text")).alias("text"), F.coalesce(same, F.lit(False)).alias("replaced"))


def renamed(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """M9: names replaced by a (old, new) table."""
    return df.join(names.withColumnRenamed("old", "__old").withColumnRenamed("new", "__new"), F.col(column) == F.col("__old"), "left").withColumn(column, F.coalesce("__new", column)).drop("__old", "__new")


def purged(artifacts: DataFrame, sources: DataFrame, edges: DataFrame, entities: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: (entities, edges) after the files of `names` (name) are purged with all their versions.

    artifacts: id, name; sources: artifact_id, entity_id; edges: id, from_id, to_id, artifact_id. Edges of
    a purged version go, corrected ones as well; an entity goes when every source it has is purged
    (one without any source stays), and with it the edges that name it.
    """
    gone = artifacts.join(names.select("name").distinct(), "name", "left_semi").select(F.col("id").alias("artifact_id"))
    kept_sources = sources.join(gone, "artifact_id", "left_anti").select("entity_id").distinct()
    lost = sources.join(gone, "artifact_id", "left_semi").select("entity_id").distinct().join(kept_sources, "entity_id", "left_anti")
    left = edges.join(gone, "artifact_id", "left_anti")
    for end in ("from_id", "to_id"):
        left = left.join(lost.select(F.col("entity_id").alias(end)), end, "left_anti")
    return entities.join(lost.select(F.col("entity_id").alias("id")), "id", "left_anti"), left.select(*edges.columns)


def undone(log: DataFrame, undo: DataFrame) -> DataFrame:
    """M7: (target, field, value) with the operations of `undo` (id) taken back: the log is replayed without them, so what stood before stands again."""
    return replayed(log.join(undo.select("id"), "id", "left_anti"))


def claimed(items: DataFrame, requests: DataFrame, alive: DataFrame) -> DataFrame:
    """(item, owner): items (item, owner) after a round of claims by requests (owner, at).

    An item whose owner is in `alive` (owner) stays with it; the others are free, and go by item to
    the requests of live owners by time, then owner, one item each. The ranks are those of one
    queue, so free items and requests are numbered in blocks and not in one task.
    """
    live = items.join(alive.select("owner"), "owner", "left_semi")
    free = items.join(alive.select("owner"), "owner", "left_anti").select("item", F.col("owner").alias("was"))
    asking = requests.join(alive.select("owner"), "owner", "left_semi")
    met = numbered(free, ["item"]).join(numbered(asking, ["at", "owner"]).select("number", "owner"), "number", "left")
    return live.select("item", "owner").unionByName(met.select("item", F.coalesce("owner", F.lit(None)).alias("owner")))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with number 1, 2, .. in an order over the whole table: a range sort, then counts per partition."""
    from weftline.staging import stage

    placed = stage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "numbered")
    counts = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    rank = F.row_number().over(W.partitionBy("part").orderBy(*order))
    return placed.join(F.broadcast(before), "part").withColumn("number", F.col("before") + rank).drop("part", "before")
