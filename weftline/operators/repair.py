"""Repairs of a merged text by the readings it came from: doubled, skipped and garbled lines (Q7), clipped pieces beside each other (Q5), and spacing (Q15).

`finals` are lines (key, n, line) of merged texts, `readings` lines (key, ord, n, line, rank) of the
fragments; rank tells how far a line's reading is to be trusted (`sequence.RANK`), 5 and more is proven.
Each repair asks what the readings show at one place, a line between its neighbours: places are windows
of neighbouring lines, and readings meet them by equality. No text is held in one piece, but by Q5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from weftline.operators import sideways
from weftline.staging import discard, stage

PROVEN, LONG_LINE, MIN_VOTES, LEAST_ALNUM = 5, 12, 2, 12
EDIT = ["key", "n", "action", "line"]


def _indent(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line))


def _told(rows: DataFrame) -> DataFrame:
    """Adds what the repairs ask of a line, so that its text stays where it is: digests of the stripped line (k) and of the line but for blanks at its end (said), the stripped line's size, the indent, and of readings whether it is proven."""
    if "k" in rows.columns:
        return rows
    bare = F.trim("line")
    told = rows.withColumns({"k": F.when(bare.isNotNull(), F.xxhash64(bare)), "said": F.xxhash64(F.rtrim("line")), "size": F.length(bare), "indent": _indent(F.col("line"))})
    return told.withColumn("proven", F.col("rank") >= PROVEN).drop("rank") if "rank" in rows.columns else told


def _windows(rows: DataFrame, by: list[str], size: int, at: int = 0) -> DataFrame:
    """Adds w, z, the digests and lengths of the `size` rows of which this is row `at`, p, whether each is proven, and i, their indents; only rows with all of them.

    Rows are dealt by key alone, so all that is asked of a text's windows afterwards is answered where they are.
    """
    order = W.partitionBy(*by).orderBy("n")
    move = lambda column, i: F.lead(column, i - at).over(order) if i > at else F.lag(column, at - i).over(order) if i < at else F.col(column)
    column = lambda name: F.array(*[move(name, i) for i in range(size)])
    wide = rows.repartition("key").withColumns({"w": column("k"), "z": column("size"), "i": column("indent")})
    if "proven" in rows.columns:
        wide = wide.withColumn("p", column("proven"))
    return wide.where(~F.exists("w", lambda x: x.isNull()))


def _counted(places: DataFrame, seen: DataFrame, name: str) -> DataFrame:
    """How often readings show the lines in the column `name` of each place; seen: key, w, weight."""
    total = seen.groupBy("key", "w").agg(F.sum("weight").alias(f"{name}_seen"))
    return places.join(total.withColumnRenamed("w", name), ["key", name], "left").withColumn(f"{name}_seen", F.coalesce(f"{name}_seen", F.lit(0)))


def _weight(first: int, last: int) -> Column:
    """A place whose inner lines are all proven counts double."""
    return F.when(F.forall(F.slice("p", first + 1, last - first), lambda x: F.coalesce(x, F.lit(False))), 2).otherwise(1)


def _spelled(found: DataFrame, readings: DataFrame, names: list[str]) -> DataFrame:
    """Adds, for each column of digests, the stripped line behind it as <name>_text."""
    asked = stage(found, "asked")
    wanted = asked.select("key", F.explode(F.array(*names)).alias("k")).distinct()
    texts = stage(readings.select("key", "k", "line").join(wanted, ["key", "k"], "left_semi").groupBy("key", "k").agg(F.min(F.trim("line")).alias("t")), "texts")
    for name in names:
        asked = asked.join(texts.select("key", F.col("k").alias(name), F.col("t").alias(f"{name}_text")), ["key", name])
    return asked


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Runs of equal stripped lines: x (the digest), long (its length), size, last (its n), before and after (the lines around), before_long, solid (all proven)."""
    order = W.partitionBy(*by).orderBy("n")
    numbered = rows.repartition("key").withColumn("fresh", F.coalesce(F.lag("k").over(order) != F.col("k"), F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(order))
    solid = F.min(F.col("proven").cast("int")) if "proven" in rows.columns else F.lit(0)
    runs = numbered.groupBy(*by, "run").agg(F.first("k").alias("x"), F.first("size").alias("long"), F.count("*").alias("size"), F.max("n").alias("last"), solid.alias("solid"))
    around = W.partitionBy(*by).orderBy("run")
    return runs.withColumns({"before": F.lag("x").over(around), "before_long": F.lag("long").over(around), "after": F.lead("x").over(around)})


def doubled_lines(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Edits that drop one copy of a line that stands in a row, where more readings show one copy fewer.

    Of a short line, or one that a reading shows as often, twice as many and two more must.
    """
    finals, readings = _told(finals), _told(readings)
    places = _runs(finals, ["key"]).where("size >= 2 AND long > 0 AND before_long > 0 AND after IS NOT NULL").select("key", "x", "long", "size", "last", "before", "after")
    seen = _runs(readings, ["key", "ord"]).where("before IS NOT NULL AND after IS NOT NULL").groupBy("key", "x", "before", "after", F.col("size").alias("shown")).agg(F.sum(1 + F.col("solid")).alias("weight"))
    met = places.join(seen, ["key", "x", "before", "after"]).groupBy("key", "x", "long", "size", "last").agg(F.coalesce(F.sum(F.when(F.col("shown") == F.col("size"), F.col("weight"))), F.lit(0)).alias("twice"), F.coalesce(F.sum(F.when(F.col("shown") == F.col("size") - 1, F.col("weight"))), F.lit(0)).alias("once"))
    met = met.where((F.col("once") > F.col("twice")) & ((F.col("long") >= LONG_LINE) | (F.col("twice") == 0) | (F.col("once") >= 2 * F.col("twice") + 2)))
    return met.select("key", F.col("last").alias("n"), F.lit("drop").alias("action"), F.lit(None).cast("string").alias("line"))


def doubled_pairs(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Edits that drop the second copy of two lines that stand twice, where readings clearly show them once."""
    finals, readings = _told(finals), _told(readings)
    get, long = lambda i: F.get("w", i), lambda i: F.get("z", i)
    places = _windows(finals, ["key"], 6, 1).where((get(1) == get(3)) & (get(2) == get(4)) & (get(1) != get(2)) & (long(0) > 0) & (long(1) > 0) & (long(2) > 0) & (get(0) != get(2)) & (get(5) != get(1)))
    places = places.select("key", "n", F.col("w").alias("twice"), F.array(get(0), get(1), get(2), get(5)).alias("once"))
    places = _counted(places, _windows(readings, ["key", "ord"], 6).select("key", "w", _weight(1, 5).alias("weight")), "twice")
    places = _counted(places, _windows(readings, ["key", "ord"], 4).select("key", "w", _weight(1, 3).alias("weight")), "once")
    gone = places.where("once_seen >= 2 * twice_seen + 2").select("key", F.explode(F.array(F.col("n") + 2, F.col("n") + 3)).alias("n"))
    return gone.select("key", "n", F.lit("drop").alias("action"), F.lit(None).cast("string").alias("line"))


def copied_lines(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Edits that replace one of two equal neighbours by the line that enough readings show in its place.

    Two readings, and more than show the pair; an assignment, which hardly ever repeats, needs one and no
    fewer. The line keeps the indent it has there against its neighbour.
    """
    finals, readings = _told(finals), _told(readings)
    get, long = lambda i: F.get("w", i), lambda i: F.get("z", i)
    places = _windows(finals, ["key"], 4, 1).where((get(1) == get(2)) & (long(1) >= 5) & (long(0) > 0) & (long(3) > 0) & (get(0) != get(1)) & (get(3) != get(1)))
    places = places.select("key", "n", F.col("w").alias("pair"), get(0).alias("before"), get(1).alias("x"), get(3).alias("after"), F.col("indent").alias("own"))
    shown = _windows(readings, ["key", "ord"], 4).select("key", "w", "z", "i")
    places = _counted(places, shown.select("key", "w", F.lit(1).alias("weight")), "pair")
    slots = F.array(
        F.when((long(2) > 0) & (get(2) != get(1)), F.struct(F.lit(1).alias("slot"), get(1).alias("x"), get(2).alias("y"), (F.get("i", 2) - F.get("i", 1)).alias("d"))),
        F.when((long(1) > 0) & (get(1) != get(2)), F.struct(F.lit(0).alias("slot"), get(2).alias("x"), get(1).alias("y"), (F.get("i", 1) - F.get("i", 2)).alias("d"))),
    )
    offered = shown.select("key", get(0).alias("before"), get(3).alias("after"), F.explode(F.array_compact(slots)).alias("s")).select("key", "before", "after", "s.*")
    offered = offered.groupBy("key", "before", "after", "x", "slot", "y", "d").agg(F.count("*").alias("c"))
    met = places.join(offered, ["key", "before", "after", "x"])
    votes = met.groupBy("key", "n", "own", "x", "pair_seen", "slot", "y").agg(F.sum("c").alias("votes"), F.max(F.struct("c", (-F.col("d")).alias("d"))).alias("best"))
    votes = _spelled(votes, readings, ["x", "y"]).where(F.length(F.regexp_replace("x_text", r"[\s)}\]>/;,<]", "")) >= 4)
    first = F.row_number().over(W.partitionBy("key", "n").orderBy(F.desc("votes"), F.desc("slot"), F.desc("y_text")))
    assignment = F.col("x_text").rlike(r"^[A-Za-z_][\w.]*\s*[:=]\s*\S").cast("int")
    sure = votes.withColumn("r", first).where((F.col("r") == 1) & (F.col("votes") >= MIN_VOTES - assignment) & (F.col("votes") >= F.col("pair_seen") + 1 - assignment))
    line = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("own") - F.col("best.d"))), "y_text")
    return sure.select("key", (F.col("n") + F.col("slot")).alias("n"), F.lit("replace").alias("action"), line.alias("line"))


def skipped_lines(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Edits that insert (after n) the one line that at least two readings show between the same two lines above and below, more than show these closed up."""
    finals, readings = _told(finals), _told(readings)
    get, long = lambda i: F.get("w", i), lambda i: F.get("z", i)
    places = _windows(finals, ["key"], 4, 1).where((long(1) >= 3) & (long(2) >= 3) & (long(0) > 0) & (long(3) > 0))
    places = places.select("key", "n", F.col("w").alias("closed"), F.col("indent").alias("own"))
    between = _windows(readings, ["key", "ord"], 5).select("key", F.array(get(0), get(1), get(3), get(4)).alias("closed"), get(2).alias("y"), long(2).alias("long"), (F.get("i", 2) - F.get("i", 1)).alias("d"))
    between = between.where((F.col("long") > 0) & (F.col("y") != F.get("closed", 1)) & (F.col("y") != F.get("closed", 2)))
    counted = between.groupBy("key", "closed", "y", "d").agg(F.count("*").alias("c")).groupBy("key", "closed", "y").agg(F.sum("c").alias("votes"), F.max(F.struct("c", (-F.col("d")).alias("d"))).alias("best"))
    met = _counted(places.join(counted, ["key", "closed"]), _windows(readings, ["key", "ord"], 4).select("key", "w", F.lit(1).alias("weight")), "closed")
    met = _spelled(met.withColumn("below", F.get("closed", 2)), readings, ["y", "below"])
    met = met.where((F.length(F.regexp_replace("y_text", r"[\s)}\]>/;,]", "")) >= 2) & ~F.contains(F.replace("y_text", F.lit(" ")), F.replace("below_text", F.lit(" "))))
    first = F.row_number().over(W.partitionBy("key", "n").orderBy(F.desc("votes"), "y_text"))
    sure = met.withColumn("r", first).where((F.col("r") == 1) & (F.col("votes") >= MIN_VOTES) & (F.col("votes") > F.col("closed_seen")))
    line = F.concat(F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("own") - F.col("best.d"))), "y_text")
    return sure.select("key", "n", F.lit("insert").alias("action"), line.alias("line"))


def garbled_twins(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Edits that drop, of two neighbours that differ in punctuation and spacing alone, the one no reading proves, if one proves the other."""
    finals, readings = _told(finals), _told(readings)
    order = W.partitionBy("key").orderBy("n")
    enough = F.col("line").rlike(rf"(?:[A-Za-z0-9][^A-Za-z0-9]*+){{{LEAST_ALNUM}}}")
    letters = F.when(enough, F.xxhash64(F.regexp_replace("line", "[^A-Za-z0-9]", "")))
    pair = finals.select("key", "n", "k", "size", "said", letters.alias("letters")).repartition("key").withColumns({"next": F.lead("k").over(order), "next_n": F.lead("n").over(order), "next_said": F.lead("said").over(order), "next_letters": F.lead("letters").over(order), "next_size": F.lead("size").over(order)})
    alike = stage(pair.where((F.col("size") > 0) & (F.col("next_size") > 0) & (F.col("k") != F.col("next")) & (F.col("letters") == F.col("next_letters"))).select("key", "n", "said", "next_n", "next_said"), "twins")
    proven = readings.where("proven").select("key", "said").join(alike.select("key", F.explode(F.array("said", "next_said")).alias("said")).distinct(), ["key", "said"], "left_semi").distinct()
    good = lambda said, name: proven.select("key", F.col("said").alias(said), F.lit(True).alias(name))
    twins = alike.join(good("said", "good"), ["key", "said"], "left").join(good("next_said", "next_good"), ["key", "next_said"], "left")
    twins = twins.select("key", "n", "next_n", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "next_good")]).where(F.col("good") != F.col("next_good"))
    return twins.select("key", F.when(F.col("good"), F.col("next_n")).otherwise(F.col("n")).alias("n"), F.lit("drop").alias("action"), F.lit(None).cast("string").alias("line")).distinct()


def applied(finals: DataFrame, edits: DataFrame) -> DataFrame:
    """Lines (key, n, line) after edits, numbered anew from 1."""
    changed = edits.where("action <> 'insert'").groupBy("key", "n").agg(F.min_by("action", "action").alias("action"), F.min_by("line", "action").alias("new"))
    kept = finals.select("key", "n", "line").join(changed, ["key", "n"], "left").where("action IS NULL OR action <> 'drop'").select("key", "n", F.lit(0).alias("after"), F.when(F.col("action") == "replace", F.col("new")).otherwise(F.col("line")).alias("line"))
    added = edits.where("action = 'insert'").select("key", "n", F.lit(1).alias("after"), "line")
    return kept.unionByName(added).withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("n", "after"))).select("key", "n", "line")


REPAIRS = (("copied", copied_lines), ("doubled", doubled_lines), ("pairs", doubled_pairs), ("skipped", skipped_lines), ("twins", garbled_twins))


def repaired(finals: DataFrame, readings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q7: (lines, log): the repairs one after another; the log has (key, n, action, line, repair), n as the lines were numbered before that repair."""
    readings, log = stage(_told(readings.select("key", "ord", "n", "line", "rank")), "readings"), None
    lines, numbered = stage(_told(finals.select("key", "n", "line")), "finals"), False
    for name, repair in REPAIRS:
        edits = stage(repair(lines, readings).select(*EDIT), "edits")
        log = (lambda df: df if log is None else log.unionByName(df))(edits.withColumn("repair", F.lit(name)))
        if numbered and edits.isEmpty():
            continue
        older, lines, numbered = lines, stage(_told(applied(lines, edits)), "finals"), True
        discard(older)
    return lines.select("key", "n", "line"), log


def text_of(lines: DataFrame) -> DataFrame:
    """(key, text)."""
    rows = F.array_sort(F.collect_list(F.struct("n", "line")))
    return lines.groupBy("key").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"))


def placed_lines(finals: DataFrame, readings: DataFrame, radii: tuple[int, ...] = (1, 3, 8)) -> DataFrame:
    """(key, ord, n, final_n): each read line at the only place of the merged text where it and its neighbours stand, blanks aside.

    Neighbours are those on both sides, or on one side where a fragment begins or ends. A wider radius
    is asked for what a smaller one leaves open. What is dealt is a digest of each line, by key alone.
    """
    squeezed = F.trim(F.regexp_replace("line", r"\s+", " "))
    told = lambda rows, by: stage(rows.where(squeezed != "").select(*by, "n", F.xxhash64(squeezed).alias("k")), "told")

    def signed(rows: DataFrame, by: list[str], radius: int) -> DataFrame:
        order = W.partitionBy(*by).orderBy("n")
        at = lambda i: F.lead("k", i).over(order) if i > 0 else F.lag("k", -i).over(order) if i < 0 else F.col("k")
        neighbours = F.array(*[at(i) for i in range(-2 * radius, 2 * radius + 1)])
        rows = rows.repartition("key").withColumn("near", neighbours)
        kinds = [F.slice("near", first, 2 * radius + 1) for first in (radius + 1, 2 * radius + 1, 1)]
        signs = F.array(*[F.when(~F.exists(k, lambda x: x.isNull()), F.struct(F.lit(j).alias("kind"), F.xxhash64(k).alias("sig"))) for j, k in enumerate(kinds)])
        return rows.withColumn("signs", F.array_compact(signs))

    each = lambda rows, by: rows.select(*by, "n", F.explode("signs").alias("s")).select(*by, "n", "s.kind", "s.sig")
    texts, read, found = told(finals, ["key"]), told(readings, ["key", "ord"]).withColumn("open", F.lit(True)), None
    for radius in radii:
        only = each(signed(texts, ["key"], radius), ["key"]).groupBy("key", "kind", "sig").agg(F.min("n").alias("final_n"), F.count("*").alias("c")).where("c = 1").drop("c")
        met = each(signed(read, ["key", "ord"], radius).where("open"), ["key", "ord"]).join(only, ["key", "kind", "sig"]).groupBy("key", "ord", "n").agg(F.min("final_n").alias("final_n"), F.max("final_n").alias("other")).where("final_n = other").drop("other")
        met = stage(met, "placed")
        found = met if found is None else found.unionByName(met)
        if radius == radii[-1]:
            break
        # texts of which all read lines have a place are done
        done = met.select("key", "ord", "n", F.lit(False).alias("still"))
        read = read.repartition("key").join(done.repartition("key"), ["key", "ord", "n"], "left").withColumn("open", F.col("open") & F.coalesce("still", F.lit(True))).drop("still")
        read = stage(read.withColumn("left", F.max("open").over(W.partitionBy("key"))).where("left").drop("left"), "told")
        if read.isEmpty():
            break
        texts = texts.join(read.select("key").distinct(), "key", "left_semi")
    return found


def respaced(finals: DataFrame, readings: DataFrame) -> DataFrame:
    """Q15: (key, n, line, state): each line with the blanks that its readings agree on.

    The words of a line are those of the merged text; each gap before a word, the indent too, is voted on
    by the readings placed there: the only width read, or one that two readings give and twice as many as any
    other. state: measured (all gaps decided), conflict (some are not; those stay as they were), unmeasured
    (no reading placed), empty for lines without words. Lines with tabs are left alone. Of a reading its
    gaps and a digest of its words are dealt, of a merged line the same; its text is read again at the end.
    """
    words = lambda line: F.filter(F.split(F.trim(line), " +"), lambda w: w != "")
    gaps = lambda line: F.transform(F.slice(F.split(line, r"[^ ]+", -1), F.lit(1), F.size(words(line))), F.length)
    finals, readings = stage(finals.select("key", "n", "line"), "finals"), stage(readings.select("key", "ord", "n", "line"), "readings")
    no_tab, said = ~F.contains("line", F.lit("\t")), F.xxhash64(words(F.col("line")))
    spaced = finals.where(no_tab).select("key", "n", said.alias("words"))
    read = readings.where(no_tab).select("key", "ord", "n", said.alias("said"), gaps(F.col("line")).alias("gaps")).repartition("key").join(placed_lines(finals, readings).repartition("key"), ["key", "ord", "n"])
    votes = read.select("key", F.col("final_n").alias("n"), "said", "gaps").join(spaced.repartition("key"), ["key", "n"]).where(F.col("said") == F.col("words"))
    votes = votes.select("key", "n", F.posexplode("gaps").alias("at", "width")).groupBy("key", "n", "at", "width").agg(F.count("*").alias("c"))
    ranked = votes.groupBy("key", "n", "at").agg(F.reverse(F.array_sort(F.collect_list(F.struct("c", (-F.col("width")).alias("w"))))).alias("v"))
    top, second = F.get("v", 0), F.get("v", 1)
    picked = ranked.select("key", "n", "at", F.when((F.size("v") == 1) | ((top["c"] >= 2) & (top["c"] >= 2 * second["c"])), -top["w"]).alias("width"))
    of_line = picked.groupBy("key", "n").agg(F.map_from_entries(F.collect_list(F.struct("at", "width"))).alias("widths"), F.bool_or(F.col("width").isNull()).alias("open"))
    joined = finals.repartition("key").join(of_line, ["key", "n"], "left").withColumns({"words": F.when(no_tab, words(F.col("line"))), "own": gaps(F.col("line"))})
    width = lambda i: F.coalesce(F.try_element_at("widths", i), F.get("own", i))
    rebuilt = F.array_join(F.transform("words", lambda w, i: F.concat(F.repeat(F.lit(" "), width(i)), w)), "")
    state = F.when(F.trim("line") == "", "").when(F.col("widths").isNull(), "unmeasured").when(F.col("open"), "conflict").otherwise("measured")
    return joined.select("key", "n", F.when(F.col("widths").isNotNull(), rebuilt).otherwise(F.col("line")).alias("line"), state.alias("state"))


def joined_sideways(finals: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q5: (lines, places): lines grown by pieces (key, ord, n, line) that show the same rows further to one side.

    A piece is placed by stems: runs of GRAM characters that stand once in the text and once in the
    piece. Each votes for a shift of rows and columns; the shift that LEAST_ROWS rows or more agree on, and
    twice as many as on any other, places the piece. Its rows then go over the lines at that column, where
    what both show is equal; where it is not, the line stays and counts as a conflict. Rounds, as a piece
    may meet the text only after another has made it wider. Where too few rows have a stem of their own,
    stems that stand up to MOST_PLACES times vote as well; a shift that LEAST_ROWS rows agree on and no row that
    it covers contradicts then places the piece, if there is just one. places: key, ord, rows, columns, conflicts.
    Rows are sent once, to the task of their text, which holds it whole (`sideways`); stems are never sent. Both
    tables returned are in buckets of the key.
    """
    number = finals.schema["n"].dataType if finals.schema["n"].dataType == pieces.schema["n"].dataType else LongType()
    key, order = finals.schema["key"].dataType, pieces.schema["ord"].dataType
    side = lambda rows, order_, part: rows.select("key", order_.alias("ord"), F.col("n").cast(number).alias("n"), "line", F.lit(part).alias("part"))
    rows = side(finals, F.lit(None).cast(order), False).unionByName(side(pieces, F.col("ord"), True))
    # a window asks for the rows of a text in one task, in order; where they are so already, nothing is exchanged
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("key").orderBy("part", "ord", "n")))
    names = (key, number, StringType(), BooleanType(), order, number, IntegerType(), LongType())
    result = StructType([StructField(c, kind) for c, kind in zip(("key", "n", "line", "placed", "ord", "rows", "columns", "conflicts"), names, strict=True)])
    of_arrow = [to_arrow_type(x) for x in (key, order, number)]
    told = stage(rows.mapInArrow(sideways.fold(*of_arrow), result), "sideways", "key", here=True)
    return told.where("NOT placed").select("key", "n", "line"), told.where("placed").select("key", "ord", "rows", "columns", "conflicts")
