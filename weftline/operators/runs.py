"""Run, gap and sequence checks on ordered rows (W*)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def versions(df: DataFrame, by: str, order: list[str], row_id: str) -> DataFrame:
    """Version number and the id that each row supersedes."""
    window = W.partitionBy(by).orderBy(*order)
    return df.withColumns({"version": F.row_number().over(window), "supersedes": F.lag(row_id).over(window)})


def sequence_jumps(df: DataFrame, by: list[str], value: str, factor: float = 25, slack: int = 0) -> DataFrame:
    """Steps larger than max(factor * median step, median step + slack)."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(*by).orderBy(value))
    steps = df.select(*by, value, step.alias("step")).where("step IS NOT NULL")
    median = steps.groupBy(*by).agg(F.percentile("step", 0.5).alias("median"))
    return steps.join(median, by).where(F.col("step") > F.greatest(factor * F.col("median"), F.col("median") + slack))


def family_gaps(df: DataFrame, by: list[str], value: str, least: int = 6, most_steps: int = 3) -> DataFrame:
    """Gaps in a numbered family that are a multiple of the median step, of at most `most_steps` steps."""
    order = W.partitionBy(*by).orderBy(value)
    rows = df.select(*by, value).distinct().withColumn("step", F.col(value) - F.lag(value).over(order))
    stats = rows.groupBy(*by).agg(F.count("*").alias("members"), F.percentile("step", 0.5).alias("median")).where(F.col("members") >= least)
    return rows.join(stats, by).where((F.col("step") > F.col("median")) & (F.col("step") % F.col("median") == 0) & (F.col("step") <= most_steps * F.col("median")))


def broken_runs(df: DataFrame, by: list[str], at: str, distance: int = 6, least: int = 20) -> DataFrame:
    """Runs of rows whose neighbours are at most `distance` apart, of `least` rows or more."""
    order = W.partitionBy(*by).orderBy(at)
    fresh = F.coalesce(((F.col(at) - F.lag(at).over(order)) > distance).cast("int"), F.lit(1))
    numbered = df.select(*by, at, fresh.alias("__new")).withColumn("run", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("size")).where(F.col("size") >= least)


def running_budget(df: DataFrame, by: list[str], order: list[str], cost: Column, limit: Column, warn: float = 0.8) -> DataFrame:
    """Spend so far, and whether it warns or exceeds."""
    spent = F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    rows = df.withColumn("spent", spent)
    return rows.withColumn("state", F.when(F.col("spent") > limit, "exceeded").when(F.col("spent") >= warn * limit, "warn").otherwise("ok"))


def shifted_after_deletions(refs: DataFrame, deleted: DataFrame, key: str, line: str) -> DataFrame:
    """Each reference moves up by the deleted lines before it; one union and window, no range join."""
    both = refs.select("*", F.lit(0).alias("__d")).unionByName(deleted.select(key, line, F.lit(1).alias("__d")).distinct(), allowMissingColumns=True)
    before = F.coalesce(F.sum("__d").over(W.partitionBy(key).orderBy(line).rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    return both.withColumn("moved", F.col(line) - before).where("__d = 0").drop("__d")


def batches(df: DataFrame, by: str, order: str, low: str, high: str, size: int = 80, span: int = 1200) -> DataFrame:
    """Consecutive items in batches of at most `size` items and `span` lines; a fold, so one group at a time."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(list(dict.fromkeys((order, low, high))), kind="stable")
        number, count, start, out = 0, 0, None, []
        for a, b in zip(group[low], group[high], strict=True):
            if start is None or count >= size or b - start > span:
                number, count, start = number + (start is not None), 0, a
            count += 1
            out.append(number)
        return group.assign(batch=out)

    rows = df.select(*dict.fromkeys((by, order, low, high)))
    return rows.groupBy(by).applyInPandas(fold, StructType([*rows.schema.fields, StructField("batch", LongType())]))


def repeated_definitions(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n, name): a definition whose name is open already in the same scope; a scope ends at a smaller indent."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        open_scopes: list[tuple[int, set[str]]] = []
        found = []
        for n, line in group.sort_values("n")[["n", "line"]].itertuples(index=False):
            words = line.split()
            if not words:
                continue
            indent = len(line) - len(line.lstrip(" "))
            while open_scopes and open_scopes[-1][0] > indent:
                open_scopes.pop()
            if words[0] in ("def", "class", "function", "sub") and len(words) > 1:
                if not open_scopes or open_scopes[-1][0] < indent:
                    open_scopes.append((indent, set()))
                name = words[1].split("(")[0].rstrip(":")
                if name in open_scopes[-1][1]:
                    found.append((group[key].iloc[0], n, name))
                open_scopes[-1][1].add(name)
        return pd.DataFrame(found, columns=[key, "n", "name"])

    return lines.select(key, "n", "line").groupBy(key).applyInPandas(fold, f"{key} {lines.schema[key].dataType.simpleString()}, n int, name string")


def uncovered(lines: DataFrame, spans: DataFrame, key: str, n: str, low: str, high: str, least: int = 3, bucket: int = 64) -> DataFrame:
    """Runs of `least` or more consecutive lines that no span covers."""
    listed = spans.select(key, low, high, F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))).alias("__b"))
    at = lines.select(key, n, F.floor(F.col(n) / bucket).alias("__b"))
    l, s = at.alias("l"), listed.alias("s")  # noqa: E741
    free = l.join(s, (F.col(f"l.{key}") == F.col(f"s.{key}")) & (F.col("l.__b") == F.col("s.__b")) & F.col(f"l.{n}").between(F.col(f"s.{low}"), F.col(f"s.{high}")), "left_anti").select(key, n)
    marked = free.withColumn("__run", F.col(n) - F.row_number().over(W.partitionBy(key).orderBy(n)))
    return marked.groupBy(key, "__run").agg(F.min(n).alias("from"), F.max(n).alias("to"), F.count("*").alias("size")).where(F.col("size") >= least).drop("__run")
