"""Structured Streaming operators (ST*) over event tables.

Event time must be a timestamp with a time zone; sources with timestamp_ntz are cast, the session
time zone being UTC. Every function takes and gives a streaming DataFrame, or a batch one where
nothing in it needs a stream.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.staging import run_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """ST6: Parquet event files as a stream: those of a directory, or one file by its name."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        reader, path = reader.option("pathGlobFilter", where.getName()), path.rsplit("/", 1)[0]
    rows = reader.parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """An addition: counts and sums per event type and window, late rows beyond the watermark dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """ST3: a session of a user ends after `gap` without an event."""
    marked = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return marked.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """ST5, ST2: the first row per key; keys older than the watermark are forgotten, so the state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def changed(events: DataFrame, key: str, value: str, share: float = 0.003) -> DataFrame:
    """ST1: rows whose value differs from the last *kept* one of the key by at least `share` of it; (key, event_id, value, rejected so far)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, rejected = state.get if state.exists else (None, 0)
        out = []
        for frame in frames:
            for row in frame.sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
                if last is None or abs(row.value - last) >= share * abs(last):
                    last = float(row.value)
                    out.append((k[0], row.event_id, last, rejected))
                else:
                    rejected += 1
        state.update((last, rejected))
        yield pd.DataFrame(out, columns=[key, "event_id", "value", "rejected"])

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "ts", F.col(value).cast("double").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long, value double, rejected long", "last double, rejected long", "append", GroupStateTimeout.NoTimeout)


def kept_by_distance(frames_: DataFrame, key: str, value: str, least: int = 4) -> DataFrame:
    """ST2: rows whose 64-bit hash differs in at least `least` bits from the last kept one of the key (distance 3 or less is a near duplicate)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for row in frame.sort_values(["ts", "event_id"], kind="stable").itertuples(index=False):
                if last is None or bin((row.value ^ last) & 0xFFFFFFFFFFFFFFFF).count("1") >= least:
                    last = int(row.value)
                    out.append((k[0], row.event_id))
        state.update((last,))
        yield pd.DataFrame(out, columns=[key, "event_id"])

    kind = frames_.schema[key].dataType.simpleString()
    rows = frames_.select(key, "event_id", "ts", F.col(value).cast("long").alias("value"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id long", "last long", "append", GroupStateTimeout.NoTimeout)


def full_batches(items: list, most: int) -> tuple[list, list]:
    """The items that fill batches of `most`, and those left; each is copied once, however many there are."""
    full = len(items) - len(items) % most
    return items[:full], items[full:]


def batched(stream: DataFrame, key: str, item: str, most: int = 500, quiet_ms: int = 2000) -> DataFrame:
    """ST4: (key, batch, item, reason): items of a key in batches that close when they hold `most` items (full) or when nothing came for `quiet_ms` (quiet).

    The open batch is the state of its key, at most `most` items; a processing-time timer that each arrival
    puts off closes it. Items go in the order of their arrival, those of one micro-batch by value. State and
    output are committed together, so an item is in one batch whatever fails.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        if state.hasTimedOut:
            reason, closed, held, after = "quiet", held, [], number + bool(held)
        else:
            reason, (closed, held) = "full", full_batches(held + sorted(x for frame in frames for x in frame[item].tolist()), most)
            after = number + len(closed) // most
        state.update((held, after))
        if held:
            state.setTimeoutDuration(quiet_ms)
        for at in range(0, len(closed), 50 * most):
            rows = closed[at : at + 50 * most]
            yield pd.DataFrame({key: k[0], "batch": [number + (at + i) // most for i in range(len(rows))], "item": rows, "reason": reason}, columns=[key, "batch", "item", "reason"])

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (key, item)}
    schema = f"{key} {kinds[key]}, batch long, item {kinds[item]}, reason string"
    return stream.select(key, item).groupBy(key).applyInPandasWithState(step, schema, f"held array<{kinds[item]}>, number long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_until(stream: DataFrame, done, feed=None, fail_after: int | None = None, seconds: float = 60) -> DataFrame:
    """Drive a stream with timers into a written table until `done(rows)` holds. `feed(round)` may add input; after micro-batch `fail_after` the query is broken off once and started again on its log."""
    spark = stream.sparkSession
    base = f"{run_folder(spark)}/timed-{uuid.uuid4().hex}"
    failed: list[int] = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch_no={number}")
        if number == fail_after and not failed:
            failed.append(number)
            raise RuntimeError("broken off after the rows were written and before the batch was committed")

    def start():
        return stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(processingTime="2 seconds").start()

    query, end, turn = start(), time.monotonic() + seconds, 0
    try:
        while time.monotonic() < end:
            if query.exception() is not None:
                if failed != [fail_after] or query.isActive:
                    raise query.exception()
                query, fail_after = start(), None
            if feed is not None:
                feed(turn)
            turn += 1
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/rows")
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                rows = spark.read.schema(stream.schema).parquet(f"{base}/rows").select(*stream.columns)
                if done(rows):
                    return rows
            time.sleep(0.3)
        raise TimeoutError("the stream has not come to the asked state in time")
    finally:
        quiet = time.monotonic() + 10
        while query.isActive and query.status["isTriggerActive"] and time.monotonic() < quiet:
            time.sleep(0.02)  # between two micro-batches nothing is broken off
        query.stop()


def queued(stream: DataFrame, key: str, resume_after: int | None = None) -> DataFrame:
    """ST4, ST8, ST6: items appended by micro-batches to a JSON-lines log; a batch that is retried writes nothing twice.

    Each batch goes to a folder named by its number, replaced as a whole, so a repeated batch is the
    same batch. With `resume_after` the query is stopped by a failure in that batch and started again on
    its commit log, which is how an interrupted run goes on.
    """
    spark = stream.sparkSession
    base = f"{run_folder(spark)}/queue-{uuid.uuid4().hex}"
    failed: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{base}/rows/batch_no={number}")
        if number == resume_after and not failed:
            failed.append(number)
            raise RuntimeError("interrupted after the rows were written and before the batch was committed")

    def run() -> None:
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start().awaitTermination()

    if resume_after is None:
        run()
    else:
        try:
            run()
        except Exception:
            if not failed:
                raise
            run()
    return spark.read.schema(f"{key} long, batch int").json(f"{base}/rows")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Drive a stream over all that is there now into a written table; micro-batches and their commit log are Spark's own (ST4, ST8)."""
    spark = stream.sparkSession
    base = f"{run_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows, log = f"{base}/rows", f"{base}/log"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", rows).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(rows)

        query = stream.writeStream.foreachBatch(replace).option("checkpointLocation", log).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(rows)
