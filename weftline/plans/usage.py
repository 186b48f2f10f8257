"""Usage rollups: the flagship queries (A1, A2, A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.plans.registry import Registry
from weftline.sources.tables import table

registry = Registry()


def dec(column: str | F.Column, scale: int = 4) -> F.Column:
    """Money and measures are summed as decimals: the sum does not depend on the order of rows."""
    return (F.col(column) if isinstance(column, str) else column).cast(f"decimal(18,{scale})")


@registry.add(
    "a1_global_totals",
    """SELECT count(*) AS n, coalesce(sum(cast(l_quantity AS DECIMAL(18,4))), 0)::DECIMAL(28,4)::DOUBLE AS quantity,
       coalesce(sum(cast(l_extendedprice AS DECIMAL(18,4))), 0)::DECIMAL(28,4)::DOUBLE AS price,
       sum(CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END)::BIGINT AS failures FROM lineitem""",
)
def global_totals(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "lineitem").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(dec("l_quantity")), F.lit(0)).cast("double").alias("quantity"),
        F.coalesce(F.sum(dec("l_extendedprice")), F.lit(0)).cast("double").alias("price"),
        F.sum(F.when(F.col("l_returnflag") == "N", 0).otherwise(1)).cast("bigint").alias("failures"),
    )


@registry.add(
    "a2_usage_by_step",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(cast(l_quantity AS DECIMAL(18,4)))::DOUBLE AS quantity,
       sum(cast(l_extendedprice AS DECIMAL(18,4)))::DOUBLE AS cost FROM lineitem
       GROUP BY ALL ORDER BY cost DESC, l_returnflag, l_linestatus""",
)
def usage_by_step(spark: SparkSession, root: str) -> DataFrame:
    return (
        table(spark, root, "lineitem")
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.count("*").alias("n"),
            F.sum(dec("l_quantity")).cast("double").alias("quantity"),
            F.sum(dec("l_extendedprice")).cast("double").alias("cost"),
        )
        .orderBy(F.desc("cost"), "l_returnflag", "l_linestatus")
    )
