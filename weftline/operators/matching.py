"""Matching of lines and pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions.text import ratio
from weftline.operators.joins import alike_candidates
from weftline.operators.lines import carried_down, folded, squeezed
from weftline.staging import stage


def fuzzy_lines(left: DataFrame, right: DataFrame, left_id: str, right_id: str, line: str, least: float = 0.8) -> DataFrame:
    """Pairs of lines with the same digits that are alike by the exact ratio, no pair left out.

    Distinct lines of the same digits meet by a prefix filter on their characters (`alike_candidates`), equal
    ones by equality; the exact ratio, which depends on the order of the two, decides.
    """
    body = squeezed(F.col(line))
    a = left.select(F.col(left_id).alias("x_id"), body.alias("x")).where(F.length("x") > 0)
    b = right.select(F.col(right_id).alias("y_id"), body.alias("y")).where(F.length("y") > 0)
    digits = F.concat_ws(" ", F.regexp_extract_all("t", F.lit("[0-9]+"), F.lit(0)))
    texts = a.select(F.col("x").alias("t")).unionByName(b.select(F.col("y").alias("t"))).distinct().withColumn("k", digits)
    met = alike_candidates(texts, least)
    both = met.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(met.select(F.col("b").alias("x"), F.col("a").alias("y")))
    asked = both.join(a.select("x").distinct(), "x", "left_semi").join(b.select("y").distinct(), "y", "left_semi")
    alike = asked.select("x", "y", ratio("x", "y").alias("ratio")).where(F.col("ratio") >= least)
    same = a.select("x").distinct().join(b.select(F.col("y").alias("x")).distinct(), "x", "left_semi").select("x", F.col("x").alias("y"), F.lit(1.0).alias("ratio"))
    return a.join(alike.unionByName(same), "x").join(b, "y").select(F.col("x_id").alias(left_id), F.col("y_id").alias(right_id), "ratio")


def positioned(source: DataFrame, reading: DataFrame, n: str = "n", line: str = "line", widest: int = 12) -> DataFrame:
    """(reading_n, source_n): each read line at the only source line with the same neighbours within the smallest radius that is unique."""

    def around(df: DataFrame, radius: int, name: str) -> DataFrame:
        order = W.orderBy(n) if "doc" not in df.columns else W.partitionBy("doc").orderBy(n)
        near = [F.coalesce(F.lag(line, k).over(order) if k > 0 else F.lead(line, -k).over(order) if k < 0 else F.col(line), F.lit("\x00")) for k in range(-radius, radius + 1)]
        return df.select(*(["doc"] if "doc" in df.columns else []), F.col(n).alias(name), F.xxhash64(*near).alias("sig"))

    by = ["doc"] if "doc" in source.columns else []
    found, left = None, reading.select(*by, F.col(n).alias("reading_n"))
    for radius in (0, 1, 2, 4, 8, widest):
        only = around(source, radius, "source_n").groupBy(*by, "sig").agg(F.min("source_n").alias("source_n"), F.count("*").alias("k")).where("k = 1").drop("k")
        met = around(reading, radius, "reading_n").join(left, [*by, "reading_n"]).join(only, [*by, "sig"]).select(*by, "reading_n", "source_n")
        found = met if found is None else found.unionAll(met)
        left = left.join(met.select(*by, "reading_n"), [*by, "reading_n"], "left_anti")
    return found


def piece_holders(pieces: DataFrame, lines: DataFrame, piece: str, line_id: str, line: str, gram: int = 8) -> DataFrame:
    """(piece, line_id) of lines that hold a piece of `gram` characters or more.

    Of each distinct line only every k-th character window is listed, and of a piece the k windows of its
    beginning: wherever it stands, one of these is on the line's grid. Windows and k grow with the
    length of pieces, in four steps an octave, and only steps that pieces have are listed. The line itself
    is fetched for the pairs that meet, and decides.
    """
    steps = sorted({gram * 2**octave * quarter // 4 for octave in range(28) for quarter in range(4, 8)})
    asked = pieces.select(F.col(piece).alias("piece")).where(F.length("piece") >= gram).distinct()
    step = F.array_max(F.filter(F.array(*[F.lit(x) for x in steps if x < 2**31]), lambda x: x <= F.length("piece")))
    asked = stage(asked.select("piece", step.alias("step")), "pieces")
    body = lines.select(F.col(line_id).alias("id"), F.col(line).alias("body")).where(F.length("body") >= gram)
    distinct = body.select("body").distinct()

    def windows(text: str, step: int, wide: int, apart: int) -> Column:
        """Hashes of the windows that begin `apart` characters from one another, in one pass over the text."""
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{wide}}})).{{1,{apart}}}"), F.lit(1)), lambda w: F.xxhash64(F.lit(step), w))

    asked_by, listed = [], []
    for row in asked.select("step").distinct().collect():  # at most four an octave
        wide = max(gram, row.step * 3 // 5)
        apart = row.step - wide + 1
        asked_by.append(F.when(F.col("step") == row.step, F.array_distinct(F.slice(windows("piece", row.step, wide, 1), 1, apart))))
        listed.append(F.array_distinct(windows("body", row.step, wide, apart)))
    if not listed:
        return asked.join(body, F.col("piece") == F.col("body")).select(F.col("piece").alias(piece), F.col("id").alias(line_id))
    index = distinct.select(F.xxhash64("body").alias("h"), F.explode(F.flatten(F.array(*listed))).alias("g"))
    met = asked.select("piece", F.explode(F.coalesce(*asked_by)).alias("g")).join(index, "g").select("piece", "h").distinct()
    held = met.join(body.withColumn("h", F.xxhash64("body")), "h").where(F.contains("body", "piece"))
    return held.select(F.col("piece").alias(piece), F.col("id").alias(line_id)).distinct()


def collapsed_doubles(lines: DataFrame, fragments: DataFrame, key: str = "doc_id", least: int = 6) -> DataFrame:
    """Lines without those equal to the line before, unless a fragment shows the pair (key, line) itself."""
    order = W.partitionBy(key).orderBy("n")
    doubled = lines.withColumn("__same", F.coalesce((F.col("line") == F.lag("line").over(order)) & (F.length("line") >= least), F.lit(False)))
    proven = fragments.select(key, "line", F.lit(True).alias("__proven")).distinct()
    return doubled.join(proven, [key, "line"], "left").where(~F.col("__same") | F.col("__proven")).select(key, "n", "line")


def built_statements(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """R2: (key, first, last) of statements, folded over lines that end open, that join SQL text with a name."""
    statements = folded(lines, [key], "n", "line", F.col("line").rlike(r"[&+,_(]\s*$"))
    return statements.where(F.col("text").rlike(r"""(?i)"[^"]*\b(select\s|insert\s+into|update\s+\w+\s+set|delete\s+from|where\s)[^"]*"\s*[&+]\s*[a-z_]""")).select(key, "first", "last")


def rereads(rows: DataFrame, by: str, order: list[str], step: Column, dataset: str, least: int = 4) -> DataFrame:
    """(by, dataset, steps): data that `least` or more steps of one job read; the current step is carried down."""
    placed = carried_down(rows, [by], order, step, "__step").where("__step IS NOT NULL")
    return placed.groupBy(by, dataset).agg(F.count_distinct("__step").alias("steps")).where(F.col("steps") >= least)


def checked_facts(facts: DataFrame, lines: DataFrame, bucket: int = 1) -> DataFrame:
    """Facts (doc_id, fact_id, quote, cited) with the line where the quote stands and why a fact does not count.

    Quotes meet lines of their own document only; the nearest occurrence to the cited line wins.
    """
    body = squeezed(F.col("line"))
    met = facts.join(lines, "doc_id").where(F.contains(body, squeezed(F.col("quote"))) & (F.length(squeezed(F.col("quote"))) > 0))
    at = met.groupBy("doc_id", "fact_id").agg(F.min_by("n", F.struct(F.abs(F.col("n") - F.col("cited")).alias("d"), "n")).alias("found"))
    out = facts.join(at, ["doc_id", "fact_id"], "left")
    return out.withColumn("reason", F.when(F.length(F.trim("quote")) < 3, "quote too short").when(F.col("found").isNull(), "quote not in the file").when(F.col("found") != F.col("cited"), "line corrected").otherwise("holds"))


def version_numbers(version: Column) -> Column:
    """All numbers of a version; arrays compare as versions do."""
    numbers = F.transform(F.regexp_extract_all(version, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long"))
    return F.when(F.size(numbers) == 0, F.array(F.lit(0).cast("long"))).otherwise(numbers)


def vulnerable(products: DataFrame, advisories: DataFrame) -> DataFrame:
    """Products (product, version) below an advisory's fixed version; an unknown version counts, unconfirmed."""
    met = products.join(advisories, "product")
    hit = version_numbers(F.col("version")) < version_numbers(F.col("fixed"))
    return met.where(F.col("version").isNull() | hit).withColumn("confirmed", F.col("version").isNotNull())


def technologies(docs: DataFrame, signs: dict[str, str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, technologies) by a table of patterns."""
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in sorted(signs.items())]))
    return docs.select(key, found.alias("technologies"))


def missing_headers(responses: DataFrame, key: str, headers: str, wanted: tuple[str, ...]) -> DataFrame:
    """(key, header) of security headers a response lacks; names compare without case."""
    have = F.transform(F.map_keys(headers), F.lower)
    return responses.select(key, F.explode(F.array_except(F.array(*[F.lit(w.lower()) for w in wanted]), have)).alias("header"))


def screen_issues(screens: DataFrame, key: str = "screen_id", body: str = "body") -> DataFrame:
    """(key, issue) of stored screens (JSON with title, fields of label and type, actions)."""
    s = F.from_json(F.col(body), "title string, fields array<struct<label:string,type:string>>, actions array<string>")
    unnamed = F.exists(F.coalesce(s["fields"], F.array().cast("array<struct<label:string,type:string>>")), lambda f: F.coalesce(F.trim(f["label"]), F.lit("")) == "")
    issues = F.array_compact(
        F.array(
            F.when(F.coalesce(F.trim(s["title"]), F.lit("")) == "", F.lit("no title")),
            F.when(unnamed, F.lit("field without label")),
            F.when(F.coalesce(F.size(s["actions"]), F.lit(0)) <= 0, F.lit("no action")),
        )
    )
    return screens.select(key, F.explode(issues).alias("issue"))
