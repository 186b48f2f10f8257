"""Sorts, limits, top-k, dedup and set operations (T*, U*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by order. An aggregate over a struct: rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ordered = order + [c for c in rest if c not in order]
    first = F.min(F.struct(*[c for c in ordered if c not in key]))
    return df.groupBy(*key).agg(first.alias("__f")).select(*key, *[F.col(f"__f.{c}").alias(c) for c in rest])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark prunes to k per task before the shuffle."""
    return df.withColumn("__rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__rank") <= k).drop("__rank")


def fair_share(df: DataFrame, by: str, order: list[Column], cap: int, least: int) -> DataFrame:
    """Every group gives max(least, cap // groups) rows first; places left are filled in order over all groups. At most max(cap, first rows)."""
    groups = df.select(by).distinct().count()
    share = max(least, cap // max(1, groups))
    ranked = df.withColumn("__rank", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    first = ranked.where(F.col("__rank") <= share)
    left = max(0, cap - first.count())
    return first.unionByName(ranked.where(F.col("__rank") > share).orderBy(*order).limit(left)).drop("__rank") if left else first.drop("__rank")


def capped_then_restored(df: DataFrame, seriousness: list[Column], cap: int, position: list[str]) -> DataFrame:
    """The `cap` most serious rows, back in their original order."""
    return df.orderBy(*seriousness).limit(cap).orderBy(*position)


def degrees(edges: DataFrame, source: str, target: str) -> DataFrame:
    """Number of edge ends at each node."""
    ends = edges.select(F.col(source).alias("node")).unionAll(edges.select(F.col(target).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def merged_case_variants(df: DataFrame, name: str, row_id: str, priority: Column) -> DataFrame:
    """(row_id, survivor): rows whose names differ in case only; the survivor has the highest priority, then the smallest id."""
    order = W.partitionBy(F.lower(name)).orderBy(priority.desc(), row_id)
    return df.select(row_id, F.first(row_id).over(order).alias("survivor"))


def compared(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change) with change one of added, removed, changed; equal rows are left out."""
    a, b = before.select(F.col(key).alias("ka"), F.col(value).alias("va")), after.select(F.col(key).alias("kb"), F.col(value).alias("vb"))
    met = a.join(b, F.col("ka") == F.col("kb"), "full_outer").where(~(F.col("ka").eqNullSafe(F.col("kb")) & F.col("va").eqNullSafe(F.col("vb"))))
    return met.select(F.coalesce("ka", "kb").alias(key), F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").otherwise("changed").alias("change"))


def all_but_one(df: DataFrame, by: str, value: str, every: list[str]) -> DataFrame:
    """U4: groups that have all of a known set of values except exactly one."""
    found = df.groupBy(by).agg(F.collect_set(F.when(F.col(value).isin(every), F.col(value))).alias("has"))
    missing = F.array_except(F.array(*[F.lit(v) for v in every]), "has")
    return found.where(F.size(missing) == 1).select(by, F.element_at(missing, 1).alias("missing"))
