"""Aggregations with the rules the rollups need: caps, guards, votes, families."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.staging import stage


def capped_score(deductions: DataFrame, by: list[str], rule: str, points: str, cap: str) -> DataFrame:
    """Per rule min(sum of points, cap); 100 minus their sum, floor 0."""
    per_rule = deductions.groupBy(*by, rule).agg(F.sum(points).alias("__p"), F.min(cap).alias("__c"))
    return per_rule.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum(F.least("__p", F.coalesce("__c", F.lit(10**9))))).alias("score"))


def guarded_mean(df: DataFrame, by: list[str], score: str, weight: str, floor: float = 20, guard: int | None = None) -> DataFrame:
    """Mean weighted by max(floor, weight); with a guard never more than `guard` above the worst score."""
    w = F.greatest(F.col(weight).cast("double"), F.lit(float(floor)))
    mean = F.sum(F.col(score) * w) / F.sum(w)
    out = df.groupBy(*by).agg(mean.alias("__mean"), F.min(score).alias("worst"))
    value = F.col("__mean") if guard is None else F.least("__mean", F.col("worst") + F.lit(float(guard)))
    return out.select(*by, F.bround(value).alias("score"), F.bround("__mean").alias("average"), "worst")


def count_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """One column per value, zeros kept."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0)


def shared_targets(edges: DataFrame, writer: str, target: str) -> DataFrame:
    """(writer, target) of targets that more than one distinct writer writes; counts, not lists, so no row grows with the writers."""
    pairs = edges.select(writer, target).distinct()
    shared = pairs.groupBy(target).agg(F.count("*").alias("writers")).where("writers > 1")
    return pairs.join(shared, target)


def width_conflicts(df: DataFrame, concept: str, width: str, file: str, least_files: int = 2) -> DataFrame:
    """Concepts declared with more than one width in two or more files; narrowest and widest declaration."""
    found = df.groupBy(concept).agg(
        F.count_distinct(width).alias("widths"),
        F.count_distinct(file).alias("files"),
        F.min(F.struct(width, file)).alias("__low"),
        F.max(F.struct(F.col(width), (-F.col(file)).alias("f"))).alias("__high"),
    )
    return found.where((F.col("widths") > 1) & (F.col("files") >= least_files)).select(
        concept, "widths", "files", F.col(f"__low.{width}").alias("narrowest"), F.col(f"__low.{file}").alias("narrowest_file"), F.col(f"__high.{width}").alias("widest"), (-F.col("__high.f")).alias("widest_file")
    )


def values_in_several(df: DataFrame, value: str, holder: str, least: int = 2) -> DataFrame:
    """Values that `least` or more holders have."""
    return df.groupBy(value).agg(F.count_distinct(holder).alias("holders"), F.min(holder).alias("first")).where(F.col("holders") >= least)


def plurality(votes: DataFrame, by: list[str], choice: str, weight: Column) -> DataFrame:
    """The choice with at least twice the runner-up's weight and two voters or more."""
    counted = votes.groupBy(*by, choice).agg(F.sum(weight).alias("weight"), F.count("*").alias("voters"))
    order = W.partitionBy(*by).orderBy(F.desc("weight"), choice)
    ranked = counted.withColumns({"rank": F.row_number().over(order), "second": F.lead("weight", 1).over(order)})
    return ranked.where((F.col("rank") == 1) & (F.col("voters") >= 2) & (F.col("weight") >= 2 * F.coalesce("second", F.lit(0)))).select(*by, choice, "weight")


def majority_remainder(df: DataFrame, by: list[str], value: Column, modulus: int = 4, share: float = 0.9) -> DataFrame:
    """The remainder that at least `share` of the values have."""
    counted = df.groupBy(*by, (value % modulus).alias("remainder")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*by))
    return counted.withColumn("total", total).where(F.col("n") >= share * F.col("total")).select(*by, "remainder", "n", "total")


def digit_families(df: DataFrame, name: str, least: int = 4) -> DataFrame:
    """Names that are equal once each run of digits became `nn`, in families of `least` or more."""
    return df.groupBy(F.regexp_replace(name, "[0-9]+", "nn").alias("family")).agg(F.count_distinct(name).alias("members"), F.min(name).alias("first")).where(F.col("members") >= least)


def segment_families(df: DataFrame, name: str, digits_least: int = 4, least: int = 6) -> DataFrame:
    """(name, family, members): names of one digit family, or else of one family with a dotted segment as wildcard.

    Names in a digit family of `digits_least` or more are settled. The wildcard families of the others (names
    of three segments or more) go from the largest to the smallest, each taking the names none before it took,
    if these are `least` or more. Done in rounds: a family whose names are all free of larger undecided
    families is decided, so each round settles every family that is the largest around; families too small
    by now go at once. Each round is a written table; nothing is held by the driver.
    """
    spelled = stage(df.select(F.col(name).alias("name")).where("name <> ''").distinct().withColumn("digits", F.regexp_replace("name", "[0-9]+", "nn")), "names")
    numbered = spelled.where(F.col("name").rlike("[0-9]"))
    settled = numbered.join(numbered.groupBy("digits").agg(F.count("*").alias("members")).where(F.col("members") >= digits_least), "digits").select("name", F.col("digits").alias("family"), "members")
    free = spelled.join(settled.select("name"), "name", "left_anti").withColumn("p", F.split("name", r"\.")).where(F.size("p") >= 3)
    wild = free.select("name", F.explode(F.transform("p", lambda x, i: F.struct(F.array_join(F.transform("p", lambda y, j: F.when(i == j, F.lit("*")).otherwise(y)), ".").alias("family"), i.alias("at")))).alias("w")).select("name", "w.family", "w.at")
    sizes = wild.groupBy("family", "at").agg(F.struct((-F.count("*")).alias("size"), F.min("name").alias("first"), F.first("at").alias("i")).alias("order")).where(-F.col("order.size") >= least)
    left = stage(wild.join(sizes, ["family", "at"]).select("name", "family", "order"), "families")
    found = [settled]
    while True:
        remaining = left.groupBy("family").agg(F.count("*").alias("members")).where(F.col("members") >= least)
        met = left.join(remaining, "family").join(left.join(remaining, "family", "left_semi").groupBy("name").agg(F.min("order").alias("top")), "name")
        ready = met.groupBy("family").agg(F.bool_and(F.col("order") == F.col("top")).alias("ready")).where("ready").select("family")
        taken = stage(met.join(ready, "family", "left_semi").select("name", "family", "members"), "taken")
        if taken.isEmpty():
            break
        found.append(taken)
        left = stage(met.select("name", "family", "order").join(taken.select("name"), "name", "left_anti"), "families")
    return reduce(DataFrame.unionByName, found)


def stamp(df: DataFrame, order: list[str]) -> DataFrame:
    """A digest of a table that does not depend on the order of its rows or tasks: sum and xor of row hashes, and their number."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s"), F.bit_xor(row).alias("x")).select(F.sha2(F.concat_ws("|", "n", "s", "x"), 256).alias("stamp"))


def nearest_rank_median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Exact median."""
    return df.groupBy(*by).agg(F.percentile(value, 0.5).alias("median"))
