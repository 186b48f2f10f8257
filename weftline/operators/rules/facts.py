"""Entities and relations that extractors find in texts.

entities: doc, kind, name, parent, n (first line), last_n, attrs. relations: doc, kind, source, target,
n, attrs. attrs are maps of strings without null or empty values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY = ["doc", "kind", "name", "parent", "n", "last_n", "attrs"]
RELATION = ["doc", "kind", "source", "target", "n", "attrs"]


def attrs(**values: Column) -> Column:
    """A map of the values that are there, as strings."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["value"] != "", F.lit(False))))


def relation(rows: DataFrame, kind, source, target: Column, told: Column | None = None) -> DataFrame:
    kind, source = (F.lit(kind) if isinstance(kind, str) else kind), (F.col(source) if isinstance(source, str) else source)
    return rows.select("doc", kind.alias("kind"), source.alias("source"), target.alias("target"), "n", (attrs(none=F.lit("")) if told is None else told).alias("attrs"))


def united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def first_of(relations: DataFrame) -> DataFrame:
    """One row for each kind, source, target and line."""
    return relations.groupBy("doc", "kind", "source", "target", "n").agg(F.min_by("attrs", F.map_entries("attrs").cast("string")).alias("attrs")).select(*RELATION)
