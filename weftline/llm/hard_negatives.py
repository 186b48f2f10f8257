"""Hard negatives by k-means inverted lists.

Scores are integer inner products, higher first, ties by smaller id. An anchor's positives are its
first `positives` other rows of its label. Of the rows of other labels, those whose score is between
`low` and `high` percent of a positive's score are negatives of that positive; the first `negatives`
of them are returned.

Index: k-means centroids, at most LISTS of them, fitted on at most FIT_ROWS rows taken by the hash of
their id. Every row is in the list of its nearest centroid, and a list is stored with its radius, the
largest distance of a member from the centroid. A list is cut in blocks of some BLOCK rows by hash, so
one that holds a third of all rows is spread like any other.

Search: by Cauchy-Schwarz no member of a list scores above a . c + |a| radius, nor below
a . c - |a| radius. Each anchor visits lists by falling upper bound, some more in each round. A list
is left out where its range meets no window, or where its upper bound falls strictly below the
k-th score of each window it meets (strictly, as an equal score with a smaller id would still
count). What is left out stays out, since k-th scores only rise; so the answer is exact, and the
centroids decide only how much is visited. The positives come first, as the same search with one
open window among rows of the same label; the second search has a window for each positive.

A visit is one anchor, sent to one block; in a group, at most PACK anchors meet one block of rows in a
matrix product. Each round's state is a written table, and only ids, scores and the visiting anchors
are shuffled. Broadcast are the centroids: at most LISTS rows.

Edge cases: rows with a null id, label or vector, a null or non-finite component take no part, nor
do vectors of a quantised length of 2^28 or more, a hundred times whose products need not fit a long. Shorter vectors
count as filled up with zeros; an empty one scores 0. Rows that repeat an id are rows of their own,
but none is a partner of an anchor with its id. A row alone with its label has no positives and gives
no rows. An empty table gives an empty result. Only id, vector and label are read, so other columns
cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import column
from weftline.staging import discard, stage

LISTS, FIT_ROWS, BLOCK, PACK, SEED = 1024, 100_000, 2048, 2048, 11
#: Lists an anchor visits in its first round; each later round takes four times as many.
FIRST_VISITS = 8
#: A hundred times the product of two vectors of a quantised length below this fits a long.
LONGEST = 2.0**28
OPEN = 1 << 62


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; null where the vector, or a component, is null or not finite, or where the vector is too long."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))
    squared = F.aggregate(floors, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(sound & F.coalesce(squared < LONGEST**2, F.lit(False)), F.transform(floors, lambda x: x.cast("int")))


def prepared(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256) -> DataFrame:
    """row_no, id, label, q of the rows that take part."""
    read = vectors.select(F.monotonically_increasing_id().alias("row_no"), column(id_col).cast("long").alias("id"), column(label_col).cast("long").alias("label"), quantised(column(vector_col), scale).alias("q"))
    return stage(read.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL"), "vectors")


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    """A list array as rows of doubles, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = np.diff(vectors.offsets.to_numpy())
    values = vectors.flatten().to_numpy().astype(np.float64)
    if len(lengths) and (lengths == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def fit_centroids(rows: DataFrame, n: int, dims: int, lists: int = LISTS, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """At most `lists` centroids, some sqrt(n), fitted on at most some `fit_rows` rows."""
    k = max(1, min(lists, int(np.sqrt(n))))
    if k == 1:
        return np.zeros((1, max(1, dims)))
    share = fit_rows / n
    sample = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    filled = F.transform(F.sequence(F.lit(1), F.lit(max(1, dims))), lambda i: F.coalesce(F.get("q", i - 1), F.lit(0)).cast("double"))
    model = KMeans(k=k, seed=SEED, initMode="random", maxIter=4).fit(sample.select(array_to_vector(filled).alias("features")))
    return np.array(model.clusterCenters())


def listed(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds list and distance, the nearest centroid and how far it is."""

    def run(batches):
        squares = (centroids * centroids).sum(1)
        for batch in batches:
            q = _matrix(batch.column("q"), centroids.shape[1])
            near = np.argmin(squares - 2 * (q @ centroids.T), axis=1) if len(q) else np.zeros(0, np.int64)
            away = np.sqrt(((q - centroids[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(away)], [*batch.schema.names, "list", "distance"])

    return rows.mapInArrow(run, "row_no long, id long, label long, q array<int>, list int, distance double")


class Index:
    """All rows in inverted lists. `rows` has list and block; centroids, radii and numbers of blocks are arrays by list."""

    def __init__(self, rows: DataFrame, lists: int = LISTS, fit_rows: int = FIT_ROWS, block: int = BLOCK) -> None:
        n, dims = rows.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
        self.centroids = fit_centroids(rows, n, dims, lists, fit_rows)
        placed = stage(listed(rows, self.centroids), "listed")
        self.radii, self.blocks = np.full(len(self.centroids), -1.0), np.zeros(len(self.centroids), np.int64)
        for r in placed.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():  # at most `lists` rows
            self.radii[r["list"]], self.blocks[r["list"]] = r["radius"], -(-r["n"] // block)
        self.rows = placed.drop("distance").withColumn("block", F.pmod(F.xxhash64("row_no"), _of_list(self.blocks)).cast("int"))


def _of_list(values: np.ndarray) -> Column:
    """The value of a row's list."""
    return F.get(F.lit(values.tolist()), F.col("list"))


def _choice(index: Index, k: int, visits: int):
    """For a batch of anchors, the lists that each visits next, and the place in its order of lists from which the round after goes on."""
    centroids, radii, filled = index.centroids, index.radii, index.blocks > 0
    lengths = np.sqrt((centroids * centroids).sum(1))

    def run(batches):
        for batch in batches:
            q = _matrix(batch.column("q"), centroids.shape[1])
            middle, norm = q @ centroids.T, np.sqrt((q * q).sum(1))[:, None]
            reach = norm * radii + 1e-9 * norm * (lengths + radii) + 1e-3  # above any rounding of the doubles
            upper, lower = middle + reach, middle - reach
            lists, after = [], []
            for i, (windows, start) in enumerate(zip(batch.column("windows").to_pylist(), batch.column("next").to_pylist(), strict=True)):
                order = np.argsort(-upper[i], kind="stable")[start:]
                needed = np.zeros(len(order), bool)
                for w in windows:
                    needed |= (lower[i, order] <= w["high"]) & (upper[i, order] >= w["low"])
                chosen = np.flatnonzero(needed & filled[order])[:visits]
                lists.append(order[chosen].tolist())
                after.append(start + int(chosen[-1]) + 1 if len(chosen) else len(centroids))
            kept = [batch.column(c) for c in ("row_no", "id", "label", "q", "windows")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(lists, pa.list_(pa.int32())), pa.array(after, pa.int32())], ["row_no", "id", "label", "q", "windows", "lists", "next"])

    return run


def _best(scores: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the columns `at`, which come by id, the first k by score."""
    if len(at) <= k:
        return at
    values = scores[at]
    least = np.partition(values, len(values) - k)[len(values) - k]
    above = at[values > least]
    return np.concatenate([above, at[values == least][: k - len(above)]])


def _scored(dims: int, same_label: bool, k: int):
    """One block of rows against the anchors that visit it: for each of an anchor's windows the best k."""

    def run(held: pa.Table, asking: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if held.num_rows and asking.num_rows:
            held = held.sort_by("id")
            ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
            rows, anchors = _matrix(held["q"], dims), _matrix(asking["q"], dims)
            if np.sqrt((rows * rows).sum(1).max() * (anchors * anchors).sum(1).max()) < 2**52:
                scores = (anchors @ rows.T).astype(np.int64)  # every sum on the way is exact in a double
            else:
                scores = anchors.astype(np.int64) @ rows.astype(np.int64).T
            for i, (no, own, label, windows) in enumerate(zip(*(asking[c].to_pylist() for c in ("row_no", "id", "label", "windows")), strict=True)):
                fits = ((labels == label) == same_label) & (ids != own)
                fits &= (scores[i] >= min(w["low"] for w in windows)) & (scores[i] <= max(w["high"] for w in windows))
                at = np.flatnonzero(fits)
                values = scores[i, at]
                for w in windows:
                    best = _best(scores[i], at[(values >= w["low"]) & (values <= w["high"])], k)
                    out.append((np.full(len(best), no), np.full(len(best), w["w"]), scores[i, best], ids[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["row_no", "w", "score", "id"])

    return run


def search(index: Index, anchors: DataFrame, k: int, same_label: bool, first_visits: int = FIRST_VISITS, pack: int = PACK) -> DataFrame:
    """row_no, w, score, id, nth: the first k rows of each window of each anchor, exactly.

    `anchors`: row_no, id, label, q and windows, an array of (w, low, high) with both ends included.
    """
    best, visits = None, first_visits
    state = anchors.withColumn("next", F.lit(0))
    while True:
        if best is not None:  # a window that is full begins at its k-th score
            full = best.groupBy("row_no", "w").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
            full = full.groupBy("row_no").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
            raised = F.transform("windows", lambda x: F.struct(x["w"].alias("w"), F.greatest(x["low"], F.try_element_at("kth", x["w"])).alias("low"), x["high"].alias("high")))
            state = state.join(full, "row_no", "left").withColumn("windows", raised)
        window = "windows array<struct<w:int,low:long,high:long>>"
        asked = stage(state.select("row_no", "id", "label", "q", "windows", "next").mapInArrow(_choice(index, k, visits), f"row_no long, id long, label long, q array<int>, {window}, lists array<int>, next int"), "asked")
        packs = np.zeros(len(index.blocks), np.int64)
        for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect():  # at most LISTS rows
            packs[r["list"]] = -(-r["count"] // pack)
        if not packs.any():
            return best if best is not None else anchors.sparkSession.createDataFrame([], "row_no long, w int, score long, id long, nth int")
        every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        held = index.rows.where(_of_list(packs) > 0).withColumn("pack", every(_of_list(packs)))
        visiting = asked.select("row_no", "id", "label", "q", "windows", F.explode("lists").alias("list"))
        visiting = visiting.withColumn("pack", F.pmod(F.xxhash64("row_no"), _of_list(packs)).cast("int")).withColumn("block", every(_of_list(index.blocks)))
        key = ["list", "block", "pack"]
        found = held.groupBy(*key).cogroup(visiting.groupBy(*key)).applyInArrow(_scored(index.centroids.shape[1], same_label, k), "row_no long, w int, score long, id long")
        both = found if best is None else found.unionByName(best.drop("nth"))
        nth = F.row_number().over(W.partitionBy("row_no", "w").orderBy(F.desc("score"), "id"))
        older, best = best, stage(both.withColumn("nth", nth).where(F.col("nth") <= k), "best")
        if older is not None:
            discard(older)
        state, visits = asked.drop("lists"), 4 * visits


def mine(rows: DataFrame, anchor_step: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, **index_options: int) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of `prepared` rows; anchors are the rows whose id is divisible by `anchor_step`.

    `low` and `high` are percentages from 0 to 100; a negative positive score has no negatives, as its window is empty.
    """
    index = Index(rows, **index_options)
    anchors = index.rows.where(F.col("id") % anchor_step == 0).select("row_no", "id", "label", "q")
    window = lambda w, a, b: F.struct(w.cast("int").alias("w"), a.cast("long").alias("low"), b.cast("long").alias("high"))
    first = search(index, anchors.withColumn("windows", F.array(window(F.lit(1), F.lit(-OPEN), F.lit(OPEN)))), positives, True)
    first = first.select("row_no", F.col("nth").cast("int").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score")
    share = window(F.col("w"), F.expr(f"CASE WHEN positive_score < 0 THEN 1 ELSE ({low} * positive_score + 99) DIV 100 END"), F.expr(f"CASE WHEN positive_score < 0 THEN 0 ELSE ({high} * positive_score) DIV 100 END"))
    asking = anchors.join(first.where(score >= 0).groupBy("row_no").agg(F.collect_list(share).alias("windows")), "row_no")
    second = search(index, asking, negatives, False).select("row_no", "w", F.col("nth").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = first.join(second, ["row_no", "w"]).join(anchors.select("row_no", F.col("id").alias("anchor_id")), "row_no")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
