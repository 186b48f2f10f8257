"""Durable intermediate tables.

An operator that reads an intermediate result more than once, or iterates, writes it as Parquet
below the folder the cluster names in ``spark.checkpoint.dir``. Any executor can be lost
afterwards: the table is read again, nothing upstream is computed again. Only where the setting is
absent, and the master is a plain ``local[..]``, a folder of this process is used instead.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return f"file://{_own_folder}"


def run_folder(spark: SparkSession) -> str:
    """All tables of one application are below this folder."""
    return f"{shared_folder(spark)}/weftline-{spark.sparkContext.applicationId}"


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """`df` by a hash of the columns, in all of the session's shuffle partitions.

    Left to itself Spark merges partitions by their compressed bytes. Where rows then multiply, as texts
    become lines, or compress a hundredfold, a merged one is more than a task's memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def stage(df: DataFrame, label: str, by: str | None = None, here: bool = False) -> DataFrame:
    """Write `df` once and return a frame that reads what was written.

    With `by` the table is in buckets of that column: windows, groups and joins by it read it without an exchange.
    Rows are dealt for that, but with `here`: then each task writes what it has.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if by is not None:
        rows = df if here else dealt(df, by)
        named = f"weftline_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(named)
        staged = spark.table(named)
        spark.sql(f"DROP TABLE {named}")  # the name only: the files stay until they are discarded
        staged.staged_at = path
        return staged
    df.write.option("compression", "zstd").parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(staged: DataFrame) -> None:
    """Delete what `stage` wrote for this frame. Iterations call it for the round before the last, which nothing reads any more."""
    _delete(staged.sparkSession, staged.staged_at)


def drop_staged(spark: SparkSession) -> None:
    """Delete all tables this application staged. Call it when no frame built on them is needed."""
    _delete(spark, run_folder(spark))
