"""Documents as lines (D4): exploding, normal forms, islands, owners, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What str.splitlines cuts at, besides \n: CR LF, CR, VT, FF, FS, GS, RS, NEL and the two Unicode separators.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): split at \\n only, so a final line end gives an empty last line. n starts at 1."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n"))).select(key, (F.col("pos") + 1).alias("n"), F.col("col").alias("line"))


def split_lines_of(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, line): every kind of line end, no empty last line."""
    keys = [key] if isinstance(key, str) else key
    body = F.regexp_replace(F.col(text), f"({LINE_END})$", "")
    cut = docs.where(F.length(text) > 0).select(*keys, F.posexplode(F.split(body, LINE_END)))
    return cut.select(*keys, (F.col("pos") + 1).alias("n"), F.col("col").alias("line"))


def squeezed(text: Column) -> Column:
    """runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def islands(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of consecutive distinct integers as (by, low, high, size).

    Rows are sorted once; repeated values are passed over there, and the last row of a run tells of it. A sort
    spills where hash tables of all values, and of all runs, took a task's memory.
    """
    order = W.partitionBy(*by).orderBy(value)
    joined = lambda a, b: a.eqNullSafe(b) | F.coalesce(a >= b - 1, F.lit(False))
    there = lambda move: move(F.lit(True)).over(order).isNotNull()
    here, before, after = F.col(value), F.lag(value).over(order), F.lead(value).over(order)
    rows = df.select(*by, value).withColumns({"__first": ~(there(F.lag) & joined(before, here)), "__last": ~(there(F.lead) & joined(here, after))})
    low = F.last(F.when(F.col("__first"), here), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    size = F.coalesce(here.cast("long") - F.col("low") + 1, F.lit(1))
    return rows.withColumn("low", low).where("__last").select(*by, "low", here.alias("high"), size.alias("size"))


def gaps(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """W3, the other way round: missing ranges between present integers as (by, low, high)."""
    rows = df.select(*by, value).distinct()
    after = rows.withColumn("__next", F.lead(value).over(W.partitionBy(*by).orderBy(value)))
    return after.where(F.col("__next") > F.col(value) + 1).select(*by, (F.col(value) + 1).alias("low"), (F.col("__next") - 1).alias("high"))


def carried_down(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row."""
    window = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(window))


def folded(df: DataFrame, by: list[str], order: str, text: str, continues: Column, joiner: str = " ") -> DataFrame:
    """Physical rows to statements. `continues` says that the row goes on in the next one."""
    window = W.partitionBy(*by).orderBy(order)
    opened = df.withColumn("__new", F.coalesce(~F.lag(continues).over(window), F.lit(True)).cast("int"))
    numbered = opened.withColumn("statement", F.sum("__new").over(window.rowsBetween(W.unboundedPreceding, 0)))
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return numbered.groupBy(*by, "statement").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(F.transform(pieces, lambda p: p["t"]), joiner).alias("text"))


def chunks(lines: DataFrame, by: list[str], n: str, size: int, overlap: int) -> DataFrame:
    """Moving windows of `size` rows that overlap; each row once per window it is in."""
    step = size - overlap
    last = F.floor((F.col(n) - 1) / step)
    first = F.greatest(F.lit(0), F.ceil((F.col(n) - size) / step))
    return lines.select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("window"))


def signatures(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(before, norm, after) of each line, and whether the line is the only one of its document with that norm."""
    normed = lines.withColumn("norm", squeezed(F.col("line")))
    order = W.partitionBy(key).orderBy("n")
    around = normed.withColumns({"before": F.coalesce(F.lag("norm").over(order), F.lit("")), "after": F.coalesce(F.lead("norm").over(order), F.lit(""))})
    return around.withColumn("unique", F.count("*").over(W.partitionBy(key, "norm")) == 1)
