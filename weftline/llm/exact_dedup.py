"""Exact deduplication with a heavy-hitter split.

Texts are equal when they are identical after each run of ``[\\x20\\x09-\\x0D]`` became one space.
Their SHA-256 stands for them. The plan:

1. one pass over the texts writes (row number, id, digest), some 50 bytes a row; no later step
   touches a text;
2. Misra-Gries: each task summarises its digests in at most ``counters`` counters, the summaries
   are added up, and every digest whose estimate exceeds n / (counters + 1) is a candidate. The
   estimates sum to at most n, so there are at most ``counters`` candidates. A digest with more
   than 2 n / (counters + 1) rows cannot be missed;
3. the candidates are counted exactly (broadcast, then a map-side combined sum); those that keep
   the bound are the verified winners, again at most ``counters`` rows, broadcast to decide all
   their copies on the map side, without a shuffle of the copies;
4. all other digests are grouped with an ordinary shuffle and joined back. No group there has more
   than 2 / (counters + 1) of the rows.

Edge cases: a null text counts as empty; empty texts are equal to one another. A very long text is
hashed whole, in its own task. Null ids are allowed and lose to any other id; rows that repeat both
id and text are copies, of which exactly one stays. An empty table gives an empty result. Other
columns are carried in one struct or not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import column, packed, unpacked
from weftline.staging import stage

#: Counters of a Misra-Gries summary, and so the most rows that are ever broadcast (about 60 bytes each).
COUNTERS = 1024


def normalised(text: Column) -> Column:
    """Null as empty, each white-space run as one space. Runs that are one space already are left alone."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def digest(text: Column) -> Column:
    """The SHA-256 of the normalised text."""
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_no, doc_id, digest (32 bytes). Written to the shared folder, so row_no is stable from then on."""
    return stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            column(id_col).alias("doc_id"),
            digest(column(text_col)).alias("digest"),
        ),
        "digests",
    )


def _shrink(keys: list[bytes], counts: np.ndarray, counters: int) -> tuple[list[bytes], np.ndarray]:
    """Take the (counters + 1)-th largest count from all; those left above zero are a summary."""
    if len(keys) <= counters:
        return keys, counts
    counts = counts - np.partition(counts, -(counters + 1))[-(counters + 1)]
    left = np.flatnonzero(counts > 0)
    return [keys[i] for i in left], counts[left]


def misra_gries(counters: int):
    """Summarise the single binary column of the batches of a task in at most `counters` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        for batch in batches:
            found = pc.value_counts(batch.column(0))
            values, counts = found.field("values"), found.field("counts").to_numpy()
            if len(values) > counters:
                counts = counts - np.partition(counts, -(counters + 1))[-(counters + 1)]
                left = np.flatnonzero(counts > 0)
                values, counts = values.take(pa.array(left)), counts[left]
            for key, count in zip(values.to_pylist(), counts.tolist(), strict=True):
                held[key] = held.get(key, 0) + count
            keys, left_counts = _shrink(list(held), np.fromiter(held.values(), np.int64, len(held)), counters)
            held = dict(zip(keys, left_counts.tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "estimate"])

    return run


def heavy_hitters(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """digest, keep_id, keep_row, group_size of the verified winners; at most `counters` rows."""
    bound = rows.count() / (counters + 1)
    summaries = rows.select("digest").mapInArrow(misra_gries(counters), "digest binary, estimate long")
    candidates = summaries.groupBy("digest").agg(F.sum("estimate").alias("estimate")).where(F.col("estimate") > bound)
    return (
        rows.join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
        .groupBy("digest")
        .agg(*_group())
        .where((F.col("group_size") > bound) & (F.col("group_size") > 1))
        .select("digest", "keep_id", "keep_row", "group_size")
    )


def _group() -> list[Column]:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("row_no").alias("row")))
    return [first["id"].alias("keep_id"), first["row"].alias("keep_row"), F.count("*").alias("group_size")]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per document: row_no, doc_id, keep_id, group_size, kept, digest."""
    rows = digests(docs, id_col, text_col)
    winners = stage(heavy_hitters(rows, counters), "winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = cold.groupBy("digest").agg(*_group())
    decided = hot.unionByName(cold.join(groups, "digest"))
    return decided.select("row_no", "doc_id", "keep_id", "group_size", (F.col("row_no") == F.col("keep_row")).alias("kept"), "digest")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The documents that stay, with all their columns: one row for each distinct text.

    Copies of the winners go on the map side, before any row is shuffled; of the rest, and of rows
    that repeat the id of a winner's keeper, the first of each digest stays, cut down once before
    the exchange and once behind it. Rows that repeat id and text stay as one of them.
    """
    winners = stage(heavy_hitters(digests(docs, id_col, text_col), counters), "winners")
    hot = F.broadcast(winners.select("digest", "keep_id", F.lit(True).alias("hot")))
    held = docs.select(packed(docs), column(id_col).alias("doc_id"), digest(column(text_col)).alias("digest"))
    left = held.join(hot, "digest", "left").where(F.col("hot").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id")))
    nth = F.row_number().over(W.partitionBy("digest").orderBy(F.col("doc_id").asc_nulls_last()))
    return unpacked(left.withColumn("nth", nth).where("nth = 1"))
