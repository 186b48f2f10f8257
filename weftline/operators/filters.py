"""Selections: optional predicates, name look-ups, spans, JSON attributes, grounding."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_only(df: DataFrame, key: str, version: str) -> DataFrame:
    """The newest version of each key; ties by all columns of the row are not broken."""
    newest = df.groupBy(key).agg(F.max(version).alias("__newest"))
    return df.join(newest, key).where(F.col(version) == F.col("__newest")).drop("__newest")


def where_given(df: DataFrame, wanted: Mapping[str, object | None]) -> DataFrame:
    """Equality for each argument that is given; None means no condition."""
    conditions = [F.col(name) == value for name, value in wanted.items() if value is not None]
    return df.where(reduce(lambda a, b: a & b, conditions)) if conditions else df


def among(df: DataFrame, column: str, values: Iterable[object]) -> DataFrame:
    """IN-list. Spark turns long lists into a set look-up and pushes them to the scan."""
    return df.where(F.col(column).isin(list(values)))


def named(df: DataFrame, column: str, name: str) -> DataFrame:
    """ASCII case-insensitive name filter, as NOCASE collation compares."""
    return df.where(F.collate(F.col(column), "UTF8_LCASE") == F.collate(F.lit(name), "UTF8_LCASE"))


def without_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """P5: keep rows whose column does not start with the prefix; null is kept out, as NOT LIKE does."""
    return df.where(~F.col(column).startswith(prefix))


def json_number_at_least(df: DataFrame, column: str, path: str, bound: int) -> DataFrame:
    """An attribute inside open JSON; rows where it is absent or no number do not match."""
    return df.where(F.expr(f"try_cast(get_json_object({column}, '{path}') AS BIGINT)") >= bound)


def json_array_has(df: DataFrame, column: str, path: str, value: str) -> DataFrame:
    """Text prefilter first, then exact membership in the parsed array."""
    parsed = F.from_json(F.get_json_object(F.col(column), path), "array<string>")
    return df.where(F.col(column).contains(value) & F.array_contains(parsed, value))


def not_runtime_names(df: DataFrame, column: str, names: DataFrame, prefixes: Iterable[str]) -> DataFrame:
    """Drop names of a dimension table (one column, `name`) and names with one of a few prefixes."""
    kept = df.where(~reduce(lambda a, b: a | b, [F.lower(column).startswith(p) for p in prefixes], F.lit(False)))
    return kept.join(names.select(F.lower("name").alias("__runtime")), F.lower(column) == F.col("__runtime"), "left_anti")


def grounded(names: DataFrame, texts: DataFrame, key: str, name: str, text: str) -> DataFrame:
    """P10: keep an extracted name only where its last segment occurs in the text it came from."""
    last = F.lower(F.element_at(F.split(F.col(name), r"[.:]"), -1))
    return names.join(texts.select(key, F.lower(text).alias("__text")), key).where(F.col("__text").contains(last)).drop("__text")


def inside(value: Column, low: Column, high: Column) -> Column:
    """Line inside a span; an open end reaches to the last line."""
    return (value >= low) & (high.isNull() | (value <= high))


def is_blank_or_comment(line: Column) -> Column:
    """Blank, bracket-only or comment line."""
    return line.rlike(r"^\s*$") | line.rlike(r"^\s*[{}();\[\]]+\s*$") | line.rlike(r"^\s*(//|#|\*|--)")


def validated(df: DataFrame, kind: str, allowed: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of a known kind, quarantined rows)."""
    known = F.coalesce(F.col(kind).isin(list(allowed)), F.lit(False))
    return df.where(known), df.where(~known)
