"""Training-order materialisation of token ids.

1. Each document is tokenised once, given an end-of-text id and cut into sequences of `LENGTH`
   ids. Sequences are written as unpadded little-endian 16-bit ids, with the number of the task
   that wrote them and their position in it.
2. The number of sequences per writing task, a table of one row per task, gives each task's first
   index by a running sum; index = first index of the task + position. So N sequences have the
   indexes 0 .. N - 1 without a sort or a shuffle of payloads.
3. The slot of a sequence in training order is a keyed permutation of its index: a Feistel network
   on the smallest even number of bits that holds N, walked along its cycle until the value is
   below N. It needs no table, is its own proof of being one to one, and can be inverted: which
   sequence is at slot s is answered without reading anything.
4. One exchange by slot range: a partition holds the slots of a shard (of several, where there are
   very many shards) and writes them in order, as records of a fixed stride (two bytes an id, padded). Slot s is at byte
   (s mod slots per shard) * stride of shard s div slots per shard, so a reader resumes at any slot.

The indexes follow the order in which the scan deals its files to tasks; a run that is repeated on
the same files and settings gives the same slots. `in_key_order` before step 1 makes them depend on
the rows alone, for one more shuffle of the texts. A lost executor re-runs its task only: what step
1 wrote is in the shared folder.

Edge cases: a null or empty text is one sequence that holds the end-of-text id alone. Texts that
spell special tokens are ordinary text. Very long texts become many sequences, dealt over all
shards. Rows may repeat and ids may be null. An empty table gives no shard. Only id and text are
read, so other columns cannot clash. A vocabulary with ids beyond 16 bits is refused.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.llm.rows import column
from weftline.staging import stage

LENGTH, SLOTS_PER_SHARD, KEY, ROUNDS, END = 512, 1 << 14, 20_24, 6, 50_256
#: The most partitions of the last exchange; beyond that many shards a partition writes several.
PARTITIONS = 20_000
SCHEMA = "task int, position long, doc_id long, seq_no int, n_tokens int, ids binary"


def tokenizer(ranks: bytes, pattern: str):
    """A byte-level BPE encoding from the content of a ranks file."""
    import tiktoken

    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _tokenise(shared, pattern: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = tokenizer(shared.value, pattern).encode_to_numpy
        task, position, last = TaskContext.get().partitionId(), 0, np.array([end], "<u2").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[tuple[int | None, int, bytes]] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = encode(text or "", disallowed_special=()).astype("<u2").tobytes() + last
                    rows.extend((doc, k, raw[i : i + 2 * length]) for k, i in enumerate(range(0, len(raw), 2 * length)))
                docs, numbers, payloads = zip(*rows, strict=True)
                columns = [pa.array([task] * len(rows), pa.int32()), pa.array(range(position, position + len(rows)), pa.int64()), pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array([len(p) // 2 for p in payloads], pa.int32()), pa.array(payloads, pa.binary())]
                position += len(rows)
                yield pa.RecordBatch.from_arrays(columns, ["task", "position", "doc_id", "seq_no", "n_tokens", "ids"])

    return run


def in_key_order(docs: DataFrame, partitions: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents dealt to `partitions` by the hash of id and text and sorted by it, so that the slots
    depend on the rows and this number alone, and not on files or scan settings. It shuffles the texts once more."""
    key = F.xxhash64(F.lit(KEY), column(id_col), F.coalesce(column(text_col), F.lit("")))
    pair = docs.select(column(id_col).cast("long").alias(id_col), column(text_col).alias(text_col), key.alias("__key"))
    return pair.repartitionById(partitions, F.pmod("__key", F.lit(partitions)).cast("int")).sortWithinPartitions("__key").drop("__key")


def sequences(docs: DataFrame, ranks: bytes, pattern: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written sequences of all documents."""
    if max(end, tokenizer(ranks, pattern).max_token_value) > 0xFFFF:
        raise ValueError("ids are written in 16 bits, and this vocabulary has larger ones")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    pair = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return stage(pair.mapInArrow(_tokenise(shared, pattern, length, end), SCHEMA), "sequences")


def _mix(values: np.ndarray, key: int, round_no: int) -> np.ndarray:
    """A keyed 64-bit mix (the finaliser of splitmix64)."""
    x = values + np.uint64((key * 0x9E3779B97F4A7C15 + round_no * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(values: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of 0 .. n - 1, or its inverse."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, half_bits = np.uint64((1 << half) - 1), np.uint64(half)
    out = np.asarray(values).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half_bits, out[todo] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_mix(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key, r) & mask)
        out[todo] = (left << half_bits) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def training_order(written: DataFrame, key: int = KEY, length: int = LENGTH, slots_per_shard: int = SLOTS_PER_SHARD) -> DataFrame:
    """shard, slot, byte_offset, doc_id, seq_no, n_tokens, record (padded to the stride) in slot order.

    A partition holds a run of whole shards: one, or as many as keep the partitions at `PARTITIONS`.
    """
    counts = written.groupBy("task").agg(F.count("*").alias("n"))
    total = written.count()
    starts = counts.select("task", (F.sum("n").over(W.orderBy("task")) - F.col("n")).alias("first"))  # one row per writing task

    @F.pandas_udf("long")
    def slot_of(index: pd.Series) -> pd.Series:
        return pd.Series(permute(index.to_numpy(), total, key))

    placed = written.join(F.broadcast(starts), "task").withColumn("slot", slot_of(F.col("first") + F.col("position")))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / slots_per_shard).cast("int"))
    shards = max(1, -(-total // slots_per_shard))
    run = -(-shards // PARTITIONS)
    dealt = placed.select("shard", "slot", "doc_id", "seq_no", "n_tokens", "ids").repartitionById(-(-shards // run), F.floor(F.col("shard") / run).cast("int")).sortWithinPartitions("slot")
    padding = F.lit(bytes(2 * length))
    record = F.substring(F.concat("ids", padding), 1, 2 * length)
    return dealt.select("shard", "slot", (F.col("slot") % slots_per_shard * (2 * length)).alias("byte_offset"), "doc_id", "seq_no", "n_tokens", record.alias("record"))


def write_shards(ordered: DataFrame, path: str, slots_per_shard: int = SLOTS_PER_SHARD) -> None:
    """Write the shards as Parquet, one file a shard, rows in slot order; Spark's commit makes each file whole or absent."""
    ordered.write.option("compression", "zstd").option("maxRecordsPerFile", slots_per_shard).parquet(path)


def read_slots(spark, path: str, first: int, count: int) -> DataFrame:
    """The records of `count` slots from `first` on, in order; other shards' row groups are skipped by their statistics."""
    return spark.read.parquet(path).where(F.col("slot").between(first, first + count - 1)).orderBy("slot")


def export_binary(ordered: DataFrame, folder: str) -> DataFrame:
    """Write raw fixed-stride files shard-00000.bin below `folder`; returns shard, path, bytes.

    `folder` is a path or URI of a file system that all executors share (a mounted folder, HDFS, an
    object store; whatever Arrow reads). A file is written below the folder `_attempts` under a name
    of its own and then moved, so a repeated task leaves one whole file; what lost tasks left goes
    at the end, when the files stand: the frame returned is computed.
    """
    uri = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(uri)
        attempt, done, out, current = TaskContext.get().taskAttemptId(), {}, None, None
        store.create_dir(f"{root}/_attempts", recursive=True)

        def finish() -> None:
            if out is not None:
                out.close()
                store.move(f"{root}/_attempts/{current:05d}.{attempt}", f"{root}/shard-{current:05d}.bin")

        for batch in batches:
            for shard, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if shard != current:
                    finish()
                    current, done[shard] = shard, 0
                    out = store.open_output_stream(f"{root}/_attempts/{shard:05d}.{attempt}")
                out.write(record)
                done[shard] += len(record)
        finish()
        names = [f"{folder.rstrip('/')}/shard-{s:05d}.bin" for s in done]
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array(names, pa.string()), pa.array(list(done.values()), pa.int64())], ["shard", "path", "bytes"])

    written = stage(ordered.select("shard", "record").mapInArrow(run, "shard int, path string, bytes long"), "exported")
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(uri)
    if store.get_file_info(f"{root}/_attempts").type == fs.FileType.Directory:
        store.delete_dir(f"{root}/_attempts")
    return written
