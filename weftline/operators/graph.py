"""Graph operators (G*) on edges (id, from_id, to_id, kind) and nodes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import discard, stage


def neighbours(edges: DataFrame, node: int, kinds: Iterable[str] | None = None) -> DataFrame:
    """G1: distinct neighbours, both directions."""
    kept = edges if kinds is None else edges.where(F.col("kind").isin(*kinds))
    out = kept.where(F.col("from_id") == node).select(F.col("to_id").alias("node"), F.lit("out").alias("direction"), "kind")
    return out.unionAll(kept.where(F.col("to_id") == node).select(F.col("from_id"), F.lit("in"), "kind")).distinct()


def flows(edges: DataFrame, entries: DataFrame, walk: Iterable[str], terminal: Iterable[str], most_depth: int = 12) -> DataFrame:
    """(entry, target, access, length, path of edge ids): first-visit paths from each entry to terminal edges.

    Breadth first over all entries at once. Every round joins the frontier with the edges, keeps the
    first visit of each (entry, node) by (order of the parent, edge id), and drops what was seen
    before; a round is a written table, so lineage stays short. Edges of one node must not exceed
    what a task sorts; the frontier may be of any size.
    """
    walking, ending = edges.where(F.col("kind").isin(*walk)), edges.where(F.col("kind").isin(*terminal))
    frontier = entries.select(F.col("node").alias("entry"), "node", F.array().cast("array<long>").alias("path"))
    seen = frontier.select("entry", "node")
    found = []
    for _ in range(most_depth):
        hit = frontier.alias("f").join(ending.alias("e"), F.col("f.node") == F.col("e.from_id"))
        found.append(hit.select("f.entry", F.col("e.to_id").alias("target"), F.col("e.kind").alias("access"), F.concat("f.path", F.array("e.id")).alias("path")))
        step = frontier.alias("f").join(walking.alias("e"), F.col("f.node") == F.col("e.from_id")).select("f.entry", F.col("e.to_id").alias("node"), F.concat("f.path", F.array("e.id")).alias("path"))
        fresh = step.join(seen, ["entry", "node"], "left_anti").groupBy("entry", "node").agg(F.min("path").alias("path"))
        frontier = stage(fresh, "frontier")
        if frontier.isEmpty():
            break
        seen = stage(seen.unionAll(frontier.select("entry", "node")), "seen")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out.select("entry", "target", "access", F.size("path").alias("length"), "path")


def dead_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, reason): nodes without a way out, and nodes that nothing leads to."""
    out, into = edges.select(F.col("from_id").alias("node")).distinct(), edges.select(F.col("to_id").alias("node")).distinct()
    stuck = nodes.select("node").join(out, "node", "left_anti").select("node", F.lit("dead end").alias("reason"))
    return stuck.unionAll(nodes.select("node").join(into, "node", "left_anti").select("node", F.lit("orphan").alias("reason")))


def simple_paths(edges: DataFrame, starts: DataFrame, most_depth: int = 10) -> DataFrame:
    """(path, node): all paths without repeats of up to `most_depth` steps that cannot go on, or ended at the bound."""
    path = starts.select(F.array("node").alias("path"), "node")
    done = []
    for depth in range(most_depth):
        step = path.alias("p").join(edges.alias("e"), F.col("p.node") == F.col("e.from_id"), "left")
        new = F.col("e.to_id").isNotNull() & ~F.array_contains("p.path", F.col("e.to_id"))
        onward = step.where(new).select(F.concat("p.path", F.array("e.to_id")).alias("path"), F.col("e.to_id").alias("node"))
        done.append(path.join(onward.select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path")).distinct(), "path", "left_anti"))
        path = stage(onward.distinct(), "paths")
        if path.isEmpty():
            break
    else:
        done.append(path)
    out = done[0]
    for more in done[1:]:
        out = out.unionAll(more)
    return out.select("path", "node")


def canonical(nodes: DataFrame, same_as: DataFrame) -> DataFrame:
    """(node, canonical): one hop along same_as, not its closure; the smallest target where there are several."""
    target = same_as.groupBy("from_id").agg(F.min("to_id").alias("__c"))
    return nodes.join(target, F.col("node") == F.col("from_id"), "left").select("node", F.coalesce("__c", "node").alias("canonical"))


def closure(parents: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth) of all descendants at any depth; safe on cycles: a node is visited once per root."""
    up = parents.select(F.col("parent").alias("of"), F.col("child").alias("under"))
    seen = stage(roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")), "closure")
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(up, F.col("node") == F.col("of")).select("root", F.col("under").alias("node")).distinct()
        reached, frontier = frontier, stage(step.join(seen, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        older, seen = seen, stage(seen.unionByName(frontier), "closure")
        discard(older)
        if reached is not older:
            discard(reached)
    return seen


def nearest_ancestor(parents: DataFrame, kinds: DataFrame, wanted: str) -> DataFrame:
    """(node, ancestor): the nearest ancestors of a kind, at any height; nodes that are of the kind name themselves.

    Safe on cycles: a node climbs through each ancestor once.
    """
    up = parents.select(F.col("child").alias("of"), F.col("parent").alias("above"))
    kind = kinds.select(F.col("node").alias("named"), F.col("kind").alias("k"))
    at = stage(kinds.select("node", F.col("node").alias("at"), F.col("kind").alias("k")), "ancestors")
    seen, found = at.select("node", "at"), at.where(F.col("k") == wanted).select("node", F.col("at").alias("ancestor"))
    while True:
        step = at.where(F.col("k") != wanted).join(up, F.col("at") == F.col("of")).select("node", F.col("above").alias("at")).distinct()
        at = stage(step.join(seen, ["node", "at"], "left_anti").join(kind, F.col("at") == F.col("named")).select("node", "at", "k"), "ancestors")
        if at.isEmpty():
            return found
        found = found.unionAll(at.where(F.col("k") == wanted).select("node", F.col("at").alias("ancestor")))
        seen = stage(seen.unionAll(at.select("node", "at")), "climbed")


def back_edges(edges: DataFrame) -> DataFrame:
    """(from_id, to_id) of the edges that close a cycle: those inside a strongly connected part that do not lead to a larger id.

    Without them every edge inside such a part climbs in id and those between parts have no way
    back, so no cycle is left. Two nodes are in one part when each reaches the other; labels are the
    largest id that reaches a node and that it reaches, and parts whose labels agree are set aside,
    round by round, until no edge is undecided.
    """
    left = stage(edges.select("from_id", "to_id").distinct(), "undecided")
    back = left.where("from_id >= to_id AND from_id = to_id")
    left = stage(left.where("from_id <> to_id"), "undecided")
    while not left.isEmpty():
        down, up = _largest_reaching(left, "from_id", "to_id"), _largest_reaching(left, "to_id", "from_id")
        both = stage(down.hint("merge").join(up.withColumnRenamed("label", "up"), "node").select("node", "label", (F.col("label") == F.col("up")).alias("done")), "labels")
        a, b = both.select(F.col("node").alias("from_id"), F.col("label").alias("la"), F.col("done").alias("da")), both.select(F.col("node").alias("to_id"), F.col("label").alias("lb"), F.col("done").alias("db"))
        judged = stage(left.hint("merge").join(a, "from_id").hint("merge").join(b, "to_id"), "judged")
        back = back.unionAll(judged.where("da AND db AND la = lb AND from_id > to_id").select("from_id", "to_id"))
        left = stage(judged.where("la = lb AND NOT da AND NOT db").select("from_id", "to_id"), "undecided")
    return back


def _largest_reaching(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(node, label): the largest id from which a node is reached along the edges, itself included."""
    nodes = edges.select(F.col(source).alias("node")).union(edges.select(target)).distinct()
    labels = stage(nodes.withColumn("label", F.col("node")), "labels")
    before = None
    while True:
        pushed = edges.hint("merge").join(labels, F.col(source) == F.col("node")).groupBy(F.col(target).alias("node")).agg(F.max("label").alias("pushed"))
        older, labels = labels, stage(labels.hint("merge").join(pushed, "node", "left").select("node", F.greatest("label", "pushed").alias("label")), "labels")
        discard(older)
        state = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if state == before:
            return labels
        before = state


def longest_ranks(edges: DataFrame) -> DataFrame:
    """(node, rank): length of the longest path that ends there, for acyclic edges (see `back_edges`); rounds end when no rank grows."""
    nodes = edges.select(F.col("from_id").alias("node")).union(edges.select("to_id")).distinct()
    ranks = stage(nodes.withColumn("rank", F.lit(0)), "ranks")
    most, before, rounds = ranks.count(), 0, 0
    while True:
        pushed = edges.hint("merge").join(ranks, F.col("from_id") == F.col("node")).groupBy(F.col("to_id").alias("node")).agg((F.max("rank") + 1).alias("pushed"))
        older, ranks = ranks, stage(ranks.hint("merge").join(pushed, "node", "left").select("node", F.greatest("rank", F.coalesce("pushed", F.lit(0))).alias("rank")), "ranks")
        discard(older)
        now, rounds = ranks.agg(F.sum("rank")).first()[0] or 0, rounds + 1
        if now == before:
            return ranks
        if rounds > most:  # no path of an acyclic graph is longer than its nodes are many
            raise ValueError("the edges have a cycle")
        before = now


def ranks_without_cycles(edges: DataFrame) -> DataFrame:
    """(node, rank) after the edges that close a cycle are left out; every node of the edges has a row.

    The joins of its rounds are merges: staged ids are small files, and a broadcast in each round would send all of them through the driver again.
    """
    plain = stage(edges.select("from_id", "to_id").distinct(), "ranked")
    forward = stage(plain.hint("merge").join(back_edges(plain), ["from_id", "to_id"], "left_anti"), "forward")
    nodes = plain.select(F.col("from_id").alias("node")).union(plain.select("to_id")).distinct()
    return nodes.hint("merge").join(longest_ranks(forward), "node", "left").select("node", F.coalesce("rank", F.lit(0)).alias("rank"))


def lifted(edges: DataFrame, owner: DataFrame) -> DataFrame:
    """Edges between owners: (source, target, kinds), self-edges dropped, kinds merged per pair."""
    a, b = owner.select(F.col("node").alias("__a"), F.col("owner").alias("source")), owner.select(F.col("node").alias("__b"), F.col("owner").alias("target"))
    met = edges.join(a, F.col("from_id") == F.col("__a")).join(b, F.col("to_id") == F.col("__b")).where("source <> target")
    return met.groupBy("source", "target").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


def store_lineage(edges: DataFrame) -> DataFrame:
    """Per store the number of distinct writers (in) and readers (out)."""
    writes = edges.where("kind = 'writes'").groupBy(F.col("to_id").alias("store")).agg(F.count_distinct("from_id").alias("n_in"))
    reads = edges.where("kind = 'reads'").groupBy(F.col("to_id").alias("store")).agg(F.count_distinct("from_id").alias("n_out"))
    return writes.join(reads, "store", "full_outer").select("store", F.coalesce("n_in", F.lit(0).cast("long")).alias("n_in"), F.coalesce("n_out", F.lit(0).cast("long")).alias("n_out"))


def sequences(flow: DataFrame) -> DataFrame:
    """Distinct messages of each entry in first-seen order."""
    hops = flow.select("entry", F.posexplode("path").alias("at", "edge"))
    first = hops.groupBy("entry", "edge").agg(F.min("at").alias("at"))
    return first.withColumn("step", F.row_number().over(W.partitionBy("entry").orderBy("at", "edge"))).select("entry", "step", "edge")
