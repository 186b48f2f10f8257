"""Mixing of sources to target weights, by words.

Targets: sources are ordered by code point, null last, and weigh 5, 2, 1, repeating. All sources
together keep the words they have. A source's target stops at `max_epochs` times its words; what
that leaves over is shared again among the others by weight, until no target is above its stop.
That fixed point is the water level L at which sum(min(L w, 3 s)) equals the total; it is found in
one sort of the sources by 3 s / w.

Cut: each document has a key, the hash of its id and text. Per source, the hash range is cut into equal
ranges (buckets) of some 512 rows of the table; the words of each bucket are summed with a map-side
combine. Running sums in three levels give the words before a document: over a source's blocks of
buckets, over the buckets of a block, and inside a bucket. With 2^b buckets no level sums more than
some 2^(b/2) rows or one bucket in a task, so a source with a third of all rows is spread like any
other. Whole epochs take every document; the last one takes documents in key order until the
source's budget is met exactly, so the document at the cut gives a part of its words.

Only (id, source, size, key) are shuffled to find the cut, never texts. Keys depend on id and text
alone, so reruns and other layouts agree.

Edge cases: a null text has size 0; rows without id have the key of their text; a null source is
a source of its own, after all others; a source without words has target 0. An empty table gives
an empty result. Repeated rows are taken like different ones. A very long text is counted whole; it
is one document, so it is taken or left as one. Other columns are carried in one struct or not read,
so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import ROW, column, packed, unpacked
from weftline.staging import stage

WEIGHTS, MAX_EPOCHS, SEED = (5, 2, 1), 3, 20
ROWS_PER_BUCKET = 512


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) to source, source_size, target. One row per source, so one task orders them."""
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weighted = ranked.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")))
    every = W.partitionBy()
    before = W.orderBy(F.col("source_size") * max_epochs / F.col("w"), "rank").rowsBetween(W.unboundedPreceding, -1)
    stop = F.col("source_size") * max_epochs
    levelled = (
        weighted.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum(stop).over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", F.col("left") * F.col("w") > stop * F.col("left_w"))
    )
    # Sources fill up in this order; the first that does not, which has the largest left_w of those, gives the level.
    levelled = levelled.withColumn("level", F.max(F.when(~F.col("full"), F.struct("left_w", (F.col("left") / F.col("left_w")).alias("level")))).over(every)["level"])
    return levelled.select("source", "source_size", F.when(F.col("full"), stop.cast("double")).otherwise(F.col("level") * F.col("w")).alias("target"))


def row_key(id_: Column, text: Column) -> Column:
    """The random key of a row; it depends on its id and text alone, so reruns and other layouts agree."""
    return F.xxhash64(F.lit(SEED), id_, F.coalesce(text, F.lit("")))


def group_of(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, group (the source, never null), size, key; written once, the only pass over the texts."""
    source = column(source_col)
    key = row_key(column(id_col), column(text_col))
    return stage(docs.select(column(id_col).alias("doc_id"), source.alias("source"), group_of(source).alias("group"), word_count(column(text_col)).alias("size"), key.alias("key"), F.monotonically_increasing_id().alias("row_no")), "sized")


def _words_before(sums: DataFrame, bits: int) -> DataFrame:
    """Adds before: the words of a source in all earlier buckets."""
    blocked = sums.withColumn("block", F.shiftrightunsigned("bucket", bits // 2))
    earlier = lambda by, order: W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    blocks = blocked.groupBy("group", "block").agg(F.sum("words").alias("in_block"))
    blocks = blocks.select("group", "block", F.coalesce(F.sum("in_block").over(earlier(["group"], "block")), F.lit(0)).alias("before_block"))
    inside = F.coalesce(F.sum("words").over(earlier(["group", "block"], "bucket")), F.lit(0))
    return blocked.withColumn("inside", inside).join(blocks, ["group", "block"]).withColumn("before", F.col("before_block") + F.col("inside"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """What the mix takes of each row of `sized`: doc_id, source, group, key, size, source_size, target, epochs, cut, words_before."""
    bits = max(1, (rows.count() // ROWS_PER_BUCKET).bit_length())
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    sums = stage(rows.groupBy("group", "source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = source_targets(sums.groupBy("group", "source").agg(F.sum("words").alias("source_size")).drop("group"), weights, max_epochs)
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("rest", budget - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "of")
    starts = _words_before(sums, bits).join(targets, F.col("source").eqNullSafe(F.col("of")))
    placed = rows.join(starts.select("group", "bucket", "before", "source_size", "target", "epochs", "rest"), ["group", "bucket"])
    inside = W.partitionBy("group", "bucket").orderBy("key", "doc_id", "size", "row_no").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("words_before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("words_before")))
    return placed.select("doc_id", "source", "group", "key", "size", "source_size", "target", "epochs", cut.alias("cut"), (F.col("words_before") < F.col("rest")).alias("reached"))


def taken(mixed: DataFrame) -> DataFrame:
    """Adds taken, the words the mix takes of the document with all repeats."""
    return mixed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("cut"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus: each document once per epoch that takes it, whole, with the columns of `docs`.

    Here the document at a source's cut stays whole, so a source exceeds its budget by less than
    one document. A row is known by its id and key; rows that repeat id and text are repeated
    alike. A document without words is taken only by whole epochs.
    """
    copies = F.col("epochs") + (F.col("reached") & (F.col("size") > 0)).cast("long")
    decided = mix(sized(docs, id_col, text_col, source_col)).groupBy("doc_id", "key", "group").agg(F.max(copies).alias("copies")).where("copies > 0")
    decided = decided.hint("merge").alias("mixed")  # grows with the input: never broadcast
    held = docs.select(packed(docs), column(id_col).alias("doc_id"), row_key(column(id_col), column(text_col)).alias("key"), group_of(column(source_col)).alias("group")).alias("held")
    same = F.col("held.doc_id").eqNullSafe(F.col("mixed.doc_id")) & (F.col("held.key") == F.col("mixed.key")) & (F.col("held.group") == F.col("mixed.group"))
    repeated = held.join(decided, same).select(ROW, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return unpacked(repeated)
