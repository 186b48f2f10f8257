"""Column helpers on arrays, JVM-side only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix sums are built in blocks of this many values, so that their cost stays near linear.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is evaluated once however often `body` mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column) -> Column:
    """0, v1, v1 + v2, ... of a short array of longs."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def sums_before(values: Column) -> Column:
    """For each value of an array of longs, the sum of those before it."""

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: _running(F.slice(v, b * BLOCK + 1, BLOCK)))
        return let(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(_running(F.transform(bs, lambda b: F.element_at(b, -1))), 1, F.size(bs)), lambda b, base: F.transform(F.slice(b, 1, F.size(b) - 1), lambda x: x + base))))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<long>")).otherwise(of(v)))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start: long, end: long, hit: string>> of the leftmost non-overlapping matches, in code points, end exclusive.

    The pieces between the matches and the matches alternate; their lengths give the positions.
    The pattern must not match the empty string.
    """

    def of(both: Column) -> Column:
        lengths = F.transform(both, lambda x: (F.length(x["piece"]) + F.length(x["hit"])).cast("long"))
        return F.zip_with(both, sums_before(lengths), lambda x, before: F.struct((before + F.length(x["piece"])).alias("start"), (before + F.length(x["piece"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))

    none = F.array().cast("array<struct<start:long,end:long,hit:string>>")
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), lambda hit, piece: F.struct(hit.alias("hit"), piece.alias("piece")))
    return F.when(text.rlike(pattern), let(F.filter(found, lambda x: x["hit"].isNotNull()), of)).otherwise(none)
