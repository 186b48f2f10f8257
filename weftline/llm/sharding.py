"""Sharding into equal byte ranges by histogram sort, with DataFrame operations only.

A document's key is (hash of its text, id), so equal texts are neighbours and share a shard unless
a boundary has to run through their group. The 23 boundaries between 24 shards are searched
together: a round counts, in one map-side combined pass over (key, size), the exact bytes below
4,096 candidate boundaries inside each interval that still holds an unmet target. The interval
around each target shrinks 4,096-fold a round, first over the 64 bits of the hash and then, inside
one text's group of copies, over the bits of the id, until the bytes below a boundary are within
`tolerance` of a shard's share. Each round brings at most 4,096 sums per open boundary to the
driver, whatever the size of the table. With the boundaries known, each row computes its shard by
itself and is exchanged once.

Law ``bytes``: sizes (UTF-8 bytes plus 8) are near equal. Slots: inside a shard rows are dealt to
cells by a hash of (id, text hash); the rows of earlier cells plus the rank in the cell, by key,
give a gapless slot from 0. No task ranks a whole shard.

Edge cases: a null text counts as empty; null ids sort first. Rows that repeat id and text cannot
be told apart, so a boundary never runs between them. An empty table gives an empty result. A very
long text is one row: a shard can exceed its share by that one text. Other columns are carried in
one struct or not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import ROW, column, free_name, packed
from weftline.staging import stage

SHARDS, TOLERANCE, STEP_BITS = 24, 0.001, 12
ROWS_PER_CELL, BYTES_PER_CELL = 2048, 1 << 27
SIGN = 1 << 63


@dataclass(frozen=True)
class Interval:
    """Keys whose first `field` fields equal `fixed` and whose next one, unsigned, starts with `prefix`; `left` bits are open."""

    field: int
    fixed: tuple[int, ...]
    prefix: int
    left: int

    def digit(self, key: tuple[Column, ...]) -> Column:
        step = min(STEP_BITS, self.left)
        return F.shiftrightunsigned(key[self.field], self.left - step).bitwiseAND(F.lit((1 << step) - 1))

    def holds(self, key: tuple[Column, ...]) -> Column:
        found = F.lit(True)
        for column, value in zip(key, self.fixed, strict=False):
            found &= column == F.lit(_signed(value))
        if self.left < 64:
            found &= F.shiftrightunsigned(key[self.field], self.left) == F.lit(_signed(self.prefix))
        return found

    def lower(self, digit: int) -> tuple[int, int]:
        """The smallest key of a digit's part (one past the last digit: of the next interval)."""
        step = min(STEP_BITS, self.left)
        value = ((self.prefix << step) + digit) << (self.left - step)
        return (value, 0) if self.field == 0 else (self.fixed[0], value)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= SIGN else value


def _key(id_: Column, text: Column) -> tuple[Column, Column]:
    flip = F.lit(-SIGN)
    return F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseXOR(flip).alias("h"), F.coalesce(id_.cast("long"), flip).bitwiseXOR(flip).alias("d")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, crc, h and d (hash and id, shifted so that unsigned order is their order); the only pass over the texts."""
    text = F.coalesce(column(text_col), F.lit(""))
    size, crc = (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    return stage(docs.select(column(id_col).cast("long").alias("doc_id"), size, crc, *_key(column(id_col), text)), "keyed")


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """The lower key (unsigned) of each shard but the first."""
    signed = F.lit(-SIGN)
    total, low, high = rows.agg(F.sum("size"), F.min(F.col("d").bitwiseXOR(signed)), F.max(F.col("d").bitwiseXOR(signed))).first()
    if not total:
        return []
    id_bits = max(1, ((low + SIGN) ^ (high + SIGN)).bit_length())
    ids = (id_bits, (low + SIGN) >> id_bits)
    key = (F.col("h"), F.col("d"))
    allowed = tolerance * total / shards
    start = Interval(0, (), 0, 64)
    open_targets: dict[int, tuple[Interval, int]] = {k: (start, 0) for k in range(1, shards)}
    met: dict[int, tuple[int, int]] = {}
    while open_targets:
        intervals = sorted({i for i, _ in open_targets.values()}, key=repr)
        node, digit, any_of = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(False)
        for n, interval in enumerate(intervals):
            inside = interval.holds(key)
            node, digit, any_of = F.when(inside, n).otherwise(node), F.when(inside, interval.digit(key)).otherwise(digit), any_of | inside
        counted = rows.where(any_of).groupBy(node.alias("node"), digit.alias("digit")).agg(F.sum("size").alias("bytes")).collect()
        sums: dict[Interval, list[tuple[int, int]]] = {}
        for row in sorted(counted):
            sums.setdefault(intervals[row["node"]], []).append((row["digit"], row["bytes"]))
        further: dict[int, tuple[Interval, int]] = {}
        for k, (interval, below) in open_targets.items():
            target = k * total / shards
            for digit_value, in_digit in sums[interval]:
                if below + in_digit >= target:
                    break
                below += in_digit
            ends = ((target - below, interval.lower(digit_value)), (below + in_digit - target, interval.lower(digit_value + 1)))
            closest = min(ends)
            finer = _finer(interval, digit_value, ids)
            if closest[0] <= allowed or finer is None:
                met[k] = closest[1]
            else:
                further[k] = (finer, below)
        open_targets = further
    return [met[k] for k in range(1, shards)]


def _finer(interval: Interval, digit: int, ids: tuple[int, int]) -> Interval | None:
    """The part of a digit; after the last bit of the hash the ids of one text; None when the key is used up."""
    step = min(STEP_BITS, interval.left)
    left, prefix = interval.left - step, (interval.prefix << step) + digit
    if left > 0:
        return Interval(interval.field, interval.fixed, prefix, left)
    return Interval(1, (prefix,), ids[1], ids[0]) if interval.field == 0 else None


def shard_of(bounds: list[tuple[int, int]]) -> Column:
    """The shard of a row with columns h and d: how many boundaries are at or below its key."""
    flip = F.lit(-SIGN)
    h, d = F.col("h").bitwiseXOR(flip), F.col("d").bitwiseXOR(flip)
    found = F.lit(0)
    for a, b in bounds:
        found = found + ((h > F.lit(a - SIGN)) | ((h == F.lit(a - SIGN)) & (d >= F.lit(b - SIGN)))).cast("int")
    return found.cast("int")


def _celled(rows: DataFrame, shards: int, tolerance: float, rows_per_cell: int) -> tuple[DataFrame, int]:
    """Adds shard and cell to columns h and d, and how many cells a shard has."""
    cells = max(1, rows.count() // (shards * rows_per_cell))
    return rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance))).withColumn("cell", F.pmod(F.xxhash64("d", "h"), F.lit(cells)).cast("int")), cells


def assign_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, crc, shard, slot: one row per document."""
    placed, _ = _celled(keyed(docs, id_col, text_col), shards, tolerance, ROWS_PER_CELL)
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    rank = F.row_number().over(W.partitionBy("shard", "cell").orderBy("h", "d"))
    return placed.join(starts, ["shard", "cell"]).select("doc_id", "size", "crc", "shard", (F.col("start") + rank - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` and their shard, exchanged once.

    The new column is called `shard`, with underscores in front while that name is taken. With the
    splitters known, each row computes its partition: a shard is a run of partitions (its cells, of
    some 128 MB of text each), and no sample of the texts is taken to find them.
    """
    rows = keyed(docs, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    bounds, cells = splitters(rows, shards, tolerance), max(1, -(-total // (shards * BYTES_PER_CELL)))
    held = docs.select(packed(docs), *_key(column(id_col), column(text_col))).withColumn("shard", shard_of(bounds))
    cell = F.pmod(F.xxhash64("d", "h"), F.lit(cells)).cast("int")
    dealt = held.repartitionById(shards * cells, F.col("shard") * cells + cell).sortWithinPartitions("shard", "h", "d")
    return dealt.select(f"{ROW}.*", F.col("shard").alias(free_name(docs, "shard")))
