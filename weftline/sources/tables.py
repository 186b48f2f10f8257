"""Loading of the Parquet tables an engine directory holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one table. `root` may be any path that Spark's readers open."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}; known: {', '.join(TABLES)}")
    return spark.read.parquet(f"{root}/{name}.parquet")
