"""Rows whose column names are the caller's own.

Operators that return the rows they are given carry each row in one struct, and name nothing but that
struct and their own columns; so no name of a table can clash with one of theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW = "row"


def column(name: str) -> Column:
    """The top-level column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame) -> Column:
    """The whole row as one struct."""
    return F.struct(*[column(c) for c in docs.columns]).alias(ROW)


def unpacked(held: DataFrame) -> DataFrame:
    """The rows as they were."""
    return held.select(f"{ROW}.*")


def free_name(docs: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores in front for as long as a column has that name in any case."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
