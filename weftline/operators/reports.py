"""Relational operators behind reports (N*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators.joins import tokens
from weftline.operators.lines import islands
from weftline.staging import stage


def labelled_elsewhere(labels: DataFrame, pages: DataFrame, key: str, html: str, least: int = 3, share: float = 0.75) -> DataFrame:
    """(key, holder): the first other page that shows at least `least` and `share` of a page's labels as element texts.

    The element texts of all pages are exploded once; those that are somebody's label meet labels by
    equality. Pages that show the same labels are one class, known by its first two pages, and pages that
    ask for the same labels are one question. A class that answers a question shows one of its
    rarest labels, of which there are as many as may be missing and one more; only by these they meet.
    """
    asked = stage(labels.where(F.size("labels") >= least).select(key, F.array_sort("labels").alias("labels")), "asked")
    questions = asked.select("labels").distinct()
    wanted = questions.select(F.explode("labels").alias("label")).distinct()
    texts = F.array_distinct(F.regexp_extract_all(html, F.lit(">([^<>]*)(?=<)"), F.lit(1)))
    shown = pages.select(F.col(key).alias("holder"), F.explode(texts).alias("label")).join(wanted, "label", "left_semi")
    sets = shown.groupBy("holder").agg(F.array_sort(F.collect_list("label")).alias("shown")).where(F.size("shown") >= least)
    placed = sets.withColumn("place", F.row_number().over(W.partitionBy("shown").orderBy("holder"))).where("place <= 2")
    classes = stage(placed.groupBy("shown").agg(F.min("holder").alias("first"), F.array_sort(F.collect_list("holder")).alias("holders")), "classes")
    by_label = classes.select("first", F.explode("shown").alias("label"))
    rarity = by_label.groupBy("label").agg(F.count("*").alias("f"))
    need = F.greatest(F.lit(least), F.ceil(F.lit(share) * F.size("labels") - 1e-9).cast("int"))
    each = questions.select("labels", F.explode("labels").alias("label")).join(rarity, "label", "left")
    rarest = each.groupBy("labels").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("f", F.lit(0)).alias("f"), "label"))).alias("by_rarity"))
    probes = rarest.select("labels", F.explode(F.slice("by_rarity", F.lit(1), F.size("labels") - need + 1)).alias("p")).select("labels", "p.label")
    met = probes.join(by_label, "label").select("labels", "first").distinct().join(classes, "first").where(F.size(F.array_intersect("labels", "shown")) >= need)
    answers = met.select("labels", F.explode("holders").alias("holder")).withColumn("place", F.row_number().over(W.partitionBy("labels").orderBy("holder"))).where("place <= 2")
    return asked.join(answers, "labels").where(F.col(key) != F.col("holder")).groupBy(key).agg(F.min("holder").alias("holder"))


def reviewed_levels(findings: DataFrame, facts: DataFrame, key: str, bucket: int = 64) -> DataFrame:
    """Findings (file, line, level) one level down where a span of facts disproves them (verdict F), one up where one confirms (verdict O).

    Only distinct lines and distinct spans meet in buckets; each line's verdicts then go to its findings.
    """
    spans = facts.groupBy("file", "lo", "hi").agg(F.bool_or(F.col("verdict") == "F").alias("f"), F.bool_or(F.col("verdict") == "O").alias("o"))
    listed = spans.select("file", "lo", "hi", "f", "o", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor(F.col("hi") / bucket))).alias("b"))
    at = findings.select("file", "line").distinct().withColumn("b", F.floor(F.col("line") / bucket))
    met = at.join(listed, ["file", "b"]).where(F.col("line").between(F.col("lo"), F.col("hi")))
    verdicts = met.groupBy("file", "line").agg(F.bool_or("f").alias("disproved"), F.bool_or("o").alias("confirmed"))
    shift = F.when(F.col("disproved"), -1).when(F.col("confirmed"), 1).otherwise(0)
    return findings.join(verdicts, ["file", "line"], "left").select(key, F.col("level").alias("from_level"), F.greatest(F.lit(0), F.least(F.lit(4), F.col("level") + shift)).alias("level"))


def level_parents(rows: DataFrame, by: str, order: str, level: str, most_levels: int) -> DataFrame:
    """(by, order, parent): the nearest earlier row with a smaller level. One window per level instead of a stack or a self join."""
    before = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col(level) == k, F.col(order))).over(before) for k in range(1, most_levels)]
    seen = rows.withColumn("__last", F.array(*last))
    return seen.select(by, order, F.array_max(F.slice("__last", F.lit(1), F.greatest(F.lit(0), F.col(level) - 1))).alias("parent"))


def assigned(items: DataFrame, windows: DataFrame, item: str, window: str, text: str, k: int, common: int = 1024) -> DataFrame:
    """The k windows that share the rarest words with an item; weights are integers, so sums do not depend on order.

    Exact in two steps. Words of more than `common` windows weigh next to nothing and would bring every
    item to every window, so items first meet windows by their rarer words alone. An item's k-th best
    score there is a floor; what all its common words together can add is a bound. Where they
    cannot change the order, only the windows already met are scored in full; the other items (those
    with few rare words) meet all their windows.
    """
    words = windows.select(F.col(window).alias("win"), F.explode(tokens(F.col(text))).alias("tok"))
    asked = items.select(F.col(item).alias("it"), F.explode(tokens(F.col(text))).alias("tok"))
    rarity = words.join(asked.select("tok").distinct(), "tok", "left_semi").groupBy("tok").agg(F.floor(1_000_000 / F.count("*")).alias("w"), F.count("*").alias("n"))
    weighed = stage(asked.join(rarity, "tok"), "weighed")
    rare = F.col("n") <= common
    by_rare = stage(weighed.where(rare).join(words, "tok").groupBy("it", "win").agg(F.sum("w").alias("score")), "rare")
    extra = weighed.groupBy("it").agg(F.coalesce(F.sum(F.when(~rare, F.col("w"))), F.lit(0)).alias("more"))
    order = W.partitionBy("it").orderBy(F.desc("score"), "win")
    kth = by_rare.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("it", F.col("score").alias("floor"))
    sure = extra.join(kth, "it").where((F.col("more") == 0) | (F.col("floor") > F.col("more")))
    # A window that shares no rare word scores at most `more`, so it is not among the k best of a sure item.
    candidates = by_rare.join(sure.select("it"), "it", "left_semi")
    added = candidates.select("it", "win").join(weighed.where(~rare).select("it", "tok", "w"), "it").join(words, ["tok", "win"]).groupBy("it", "win").agg(F.sum("w").alias("plus"))
    full = candidates.join(added, ["it", "win"], "left").select("it", "win", (F.col("score") + F.coalesce("plus", F.lit(0))).alias("score"))
    rest = weighed.join(sure.select("it"), "it", "left_anti").join(words, "tok").groupBy("it", "win").agg(F.sum("w").alias("score"))
    best = full.unionByName(rest).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return best.select(F.col("it").alias(item), F.col("win").alias(window), "score")


# Doubts about drawing only, and doubts that ask for another capture.
STYLE_ONLY = ("glyph", "banner", "debris", "prose")
RESCAN = ("cut", "break", "rows", "mismatch", "partial", "model")


def capture_quality(docs: DataFrame, flags: DataFrame, concerns: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, status, issues array<struct<kind, lines>>, bad_lines array<int>) of each document.

    `docs` has key, text, verified, exact; `flags` key, line, kind, literal; `concerns` key, line. Joins and
    edits count as mismatch, a mismatch inside a literal as prose; lines that show the cut mark are `cut`, a
    concern is `model`. Exact documents are good whatever is said of them. Ranges are written low-high;
    an issue without lines has none. Flags without a document give nothing.
    """
    kind = F.when(F.col("kind").isin("wrapped", "edited"), "mismatch").otherwise(F.col("kind"))
    kind = F.when((kind == "mismatch") & F.coalesce("literal", F.lit(False)), "prose").otherwise(kind)
    cut = docs.select(key, F.posexplode(F.split(text, "\n"))).where(F.contains("col", F.lit("[CUT OFF]"))).select(key, (F.col("pos") + 1).alias("line"), F.lit("cut").alias("kind"))
    said = concerns.select(key, F.col("line").cast("int").alias("line"), F.lit("model").alias("kind"))
    every = flags.select(key, F.col("line").cast("int").alias("line"), kind.alias("kind")).unionByName(cut).unionByName(said)
    every = every.join(docs.select(key).distinct(), key, "left_semi")
    runs = islands(every.where("line > 0"), [key, "kind"], "line")
    spelled = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", F.col("low").cast("string"), F.col("high").cast("string")))
    ranges = F.array_sort(F.collect_list(F.struct("low", spelled.alias("range"))))
    lines = runs.groupBy(key, "kind").agg(F.array_join(F.transform(ranges, lambda r: r["range"]), ",").alias("lines"))
    issues = every.select(key, "kind").distinct().join(lines, [key, "kind"], "left")
    issues = issues.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("kind", F.coalesce("lines", F.lit("")).alias("lines")))).alias("issues"))
    of = docs.select(key, "verified", "exact", F.size(F.split(F.coalesce(text, F.lit("")), "\n")).alias("n_lines"))
    doubted = every.where(~F.col("kind").isin(*STYLE_ONLY) & (F.col("line") > 0)).join(of.select(key, "n_lines"), key).where("kind <> 'model' OR line <= n_lines")
    bad = doubted.groupBy(key).agg(F.array_sort(F.collect_set("line")).alias("bad_lines"))
    found = of.join(issues, key, "left").join(bad, key, "left")
    rescan = F.arrays_overlap(F.coalesce(F.col("issues.kind"), F.array()), F.array(*[F.lit(k) for k in RESCAN]))
    exact = F.coalesce("exact", F.lit(False))
    status = F.when(exact, "good").when(rescan, "rescan").when(~F.coalesce("verified", F.lit(False)), "unchecked").otherwise("good")
    unless_exact = lambda c, kind: F.when(exact | F.col(c).isNull(), F.array().cast(kind)).otherwise(F.col(c)).alias(c)
    return found.select(key, status.alias("status"), unless_exact("issues", "array<struct<kind:string,lines:string>>"), unless_exact("bad_lines", "array<int>"))
