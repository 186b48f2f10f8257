"""Queries of the streaming operators (ST*), each run over the events as a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import Registry
from weftline.streaming import events as ev

registry = Registry()
add = registry.add


def _stream(spark: SparkSession, root: str) -> DataFrame:
    return ev.source(spark, f"{root}/events.parquet")


@add("st1_change_detection")
def st1(spark: SparkSession, root: str) -> DataFrame:
    return ev.run_to_end(ev.changed(_stream(spark, root), "user_id", "value", 0.5))


@add("st3_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, count(*) AS n FROM n GROUP BY user_id, k")
def st3(spark: SparkSession, root: str) -> DataFrame:
    return ev.run_to_end(ev.sessions(_stream(spark, root)), "complete").select("user_id", "n")


@add("st5_once", "SELECT DISTINCT user_id, event_type FROM events")
def st5(spark: SparkSession, root: str) -> DataFrame:
    return ev.run_to_end(ev.once(_stream(spark, root), ["user_id", "event_type"], "3650 days")).select("user_id", "event_type")


@add("st_tumbling_addition", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def st_tumbling(spark: SparkSession, root: str) -> DataFrame:
    out = ev.run_to_end(ev.tumbling(_stream(spark, root)), "complete")
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@add("st2_near_frames")
def st2(spark: SparkSession, root: str) -> DataFrame:
    """The hash of a frame is that of its value in steps of ten, so equal steps are near duplicates."""
    frames = _stream(spark, root).withColumn("value", F.xxhash64(F.floor(F.col("value") / 10)))
    return ev.run_to_end(ev.kept_by_distance(frames, "user_id", "value"))


@add("st4_queued_batches", "SELECT event_id FROM events")
def st4(spark: SparkSession, root: str) -> DataFrame:
    return ev.queued(_stream(spark, root).select("event_id"), "event_id").select("event_id")


@add("st8_resumed_run", "SELECT event_id FROM events")
def st8(spark: SparkSession, root: str) -> DataFrame:
    """The run is interrupted behind its first batch's rows and started again: every row comes once."""
    return ev.queued(_stream(spark, root).select("event_id"), "event_id", resume_after=0).select("event_id")


@add("st4_closed_batches", "WITH e AS (SELECT event_type, event_id, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS k FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)) SELECT event_type, i // 70 AS batch, event_id AS item, CASE WHEN (i // 70 + 1) * 70 <= k THEN 'full' ELSE 'quiet' END AS reason FROM e")
def st4_closed(spark: SparkSession, root: str) -> DataFrame:
    """Events in batches of 70 a type; the last batch of each closes after a quiet second."""
    stream = _stream(spark, root)
    total = spark.read.parquet(f"{root}/events.parquet").count()
    return ev.run_until(ev.batched(stream, "event_type", "event_id", 70, 1000), lambda rows: rows.count() == total, seconds=300)
