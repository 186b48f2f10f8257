"""Queries of the sequence merge (Q*) and the order-dependent dedups (T7, T9), on fragments cut from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import lines, repair, sequence
from weftline.plans.registry import Registry
from weftline.sources.tables import table
from weftline.staging import dealt

registry = Registry()
add = registry.add


@add("q1_alignment")
def q1(spark: SparkSession, root: str) -> DataFrame:
    """Each turn against the next turn of its conversation."""
    turns = table(spark, root, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = turns.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", "next")
    return sequence.alignment(pairs, "id", "text", "next")


def _certain(backwards: bool) -> str:
    """SQL: documents in windows of 12 lines, every eighth; whether each window has one place beside the one before it, and the text's digest if so.

    A place is an offset at which the window shares three rows or more with the one before and agrees
    with all rows of the text so far (the document up to there, or from there on) that it covers.
    """
    order, so_far, taken = ("w + 1", "0", "p.a + len(p.l)") if not backwards else ("w - 1", "p.a", "len(p.k)")
    return f"""
    WITH d AS (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))) AS k FROM documents WHERE text IS NOT NULL),
         f AS (SELECT doc_id, k, w, w * 8 AS a, list_slice(k, w * 8 + 1, w * 8 + 12) AS l FROM d, LATERAL (SELECT unnest(range(0, 1 + greatest(0, ceil((len(k) - 12) / 8.0)::BIGINT))) AS w)),
         s AS (SELECT p.doc_id, p.w, p.k, {so_far} AS low, {taken} AS high, n.l, unnest(range(p.a - len(n.l) + 3, p.a + len(p.l) - 2)) AS o FROM f p JOIN f n ON p.doc_id = n.doc_id AND n.w = p.{order} WHERE n.l <> ['']),
         c AS (SELECT doc_id, w, count(*) FILTER (list_slice(k, greatest(low, o) + 1, least(high, o + len(l))) = list_slice(l, greatest(low, o) - o + 1, least(high, o + len(l)) - o)) AS places FROM s GROUP BY ALL),
         u AS (SELECT doc_id, bool_and(places = 1) AS certain FROM c GROUP BY 1)
    SELECT doc_id, coalesce(certain, true) AS certain, CASE WHEN coalesce(certain, true) THEN sha256(text) END AS h FROM d LEFT JOIN u USING (doc_id)"""


def _told(merged: DataFrame) -> DataFrame:
    """The digest of each text whose seams are all certain; the others record what was not."""
    certain = (F.col("breaks") == 0) & (F.col("ambiguous") == 0)
    return merged.select(F.col("artifact_id").alias("doc_id"), certain.alias("certain"), F.when(certain, F.sha2("text", 256)).alias("h"))


@add("q2_overlap_stitch", _certain(False))
def q2(spark: SparkSession, root: str) -> DataFrame:
    """All documents, cut in windows and stitched back: a text comes out as it was, or says where it may not."""
    return _told(sequence.stitched(sequence.fragments_of(table(spark, root, "documents"), 12, 8)))


@add("q2_overlap_stitch_all")
def q2_all(spark: SparkSession, root: str) -> DataFrame:
    """All documents: how often a break or an ambiguous seam was recorded, how the fragments were joined, and the text."""
    merged = sequence.stitched(sequence.fragments_of(table(spark, root, "documents"), 12, 8))
    return merged.select(F.col("artifact_id").alias("doc_id"), F.sha2("text", 256).alias("h"), "breaks", "ambiguous", "joins")


@add("q2_long_stitch", "SELECT l_suppkey AS artifact_id, sha256(string_agg('       MOVE ITEM-' || l_partkey || ' TO OUT-' || l_orderkey || '-' || l_linenumber, chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey)) AS h, 0::BIGINT AS breaks FROM lineitem GROUP BY 1")
def q2_long(spark: SparkSession, root: str) -> DataFrame:
    """Texts of hundreds of alike lines, cut in windows of 45 lines at every 35th."""
    line = F.format_string("       MOVE ITEM-%d TO OUT-%d-%d", "l_partkey", "l_orderkey", "l_linenumber")
    rows = table(spark, root, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", line.alias("line")))).alias("r"))
    texts = rows.select(F.col("l_suppkey").alias("doc_id"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"))
    merged = sequence.stitched(sequence.fragments_of(texts, 45, 35))
    return merged.select("artifact_id", F.sha2("text", 256).alias("h"), "breaks")


@add("q3_fallback_chain", _certain(True))
def q3(spark: SparkSession, root: str) -> DataFrame:
    """The fragments of all documents come last first: each goes in front of the text so far."""
    parts = sequence.fragments_of(table(spark, root, "documents"), 12, 8).withColumn("ord", -F.col("ord"))
    return _told(sequence.stitched(parts))


def _turns(spark: SparkSession, root: str) -> DataFrame:
    """Each turn's words as lines, against those of the next turn."""
    turns = table(spark, root, "conversations").select("conv_id", "turn", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"))
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(after, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text", "next")


@add("q10_certain_rows")
def q10(spark: SparkSession, root: str) -> DataFrame:
    return sequence.aligned_rows(_turns(spark, root), "id", "text", "next")


@add("j19_line_correspondence")
def j19(spark: SparkSession, root: str) -> DataFrame:
    return sequence.corresponding_lines(_turns(spark, root), "id", "text", "next")


@add(
    "q14_edge_evidence",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents), e AS (SELECT doc_id, l[1] AS head, l[len(l)] AS tail FROM w)
    SELECT doc_id, coalesce(doc_id % 2 = 0 OR (regexp_matches(head, '^\S') AND NOT regexp_matches(head, '^[)\]},;.]')), false) AS first_proved, coalesce((doc_id % 2 = 0 AND trim(regexp_replace(tail, '\s+', ' ', 'g')) = trim(regexp_replace(head, '\s+', ' ', 'g'))) OR regexp_matches(tail, '(?i)(?:[.)\]};]|(?:^|[ ;])end[;.a-z-]*)[ ;]*$'), false) AS last_proved FROM e""",
)
def q14(spark: SparkSession, root: str) -> DataFrame:
    """The first lines of even documents are confirmed."""
    docs = table(spark, root, "documents")
    first = F.get(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 0)
    return sequence.edge_evidence(docs, docs.where("doc_id % 2 = 0").select("doc_id", first.alias("signature")))


@add(
    "q4_merge_by_numbers",
    "WITH r AS (SELECT user_id, event_id % 20 AS n, event_type || (event_id % 3)::VARCHAR AS text, CASE event_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS rank FROM events) SELECT user_id, n, arg_min(text, (-rank, text)) AS text FROM r GROUP BY ALL",
)
def q4(spark: SparkSession, root: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(s) for s in ("verified", "edited", "mismatch", "cut")]), (F.col("event_id") % 4 + 1).cast("int"))
    readings = table(spark, root, "events").select("user_id", (F.col("event_id") % 20).alias("n"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("text"), status.alias("status"))
    return sequence.merged_by_numbers(readings, "user_id", "n", "text", "status")[0]


@add("q6_combined_readings")
def q6(spark: SparkSession, root: str) -> DataFrame:
    """Each document against a reading that lacks its third line; the combination must have all lines."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    cut = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: i != 2), "\n")
    return sequence.combined(docs.withColumn("second", cut), "doc_id", "text", "second").select("doc_id", F.sha2("text", 256).alias("h"), F.size("agreed").alias("agreed"), F.size("conflicts").alias("conflicts"), "added", "dropped")


@add(
    "q7_voted_lines",
    """WITH r AS (SELECT user_id, event_id % 30 AS n, event_type AS text, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 1 END AS w FROM events), v AS (SELECT user_id, n, text, sum(w) AS weight, count(*) AS voters FROM r GROUP BY ALL)
    SELECT user_id, n, text, weight::BIGINT AS weight FROM (SELECT *, row_number() OVER x AS rn, lead(weight) OVER x AS second FROM v WINDOW x AS (PARTITION BY user_id, n ORDER BY weight DESC, text)) WHERE rn = 1 AND voters >= 2 AND weight >= 2 * coalesce(second, 0)""",
)
def q7(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("event_id") % 5 == 0, "verified").otherwise("unchecked")
    readings = table(spark, root, "events").select("user_id", (F.col("event_id") % 30).alias("n"), F.col("event_type").alias("text"), status.alias("status"))
    return sequence.voted(readings, ["user_id", "n"], "text", "status")


def _texts(orders: DataFrame) -> DataFrame:
    """(key, n, line): one text a customer with six orders or more, one line an order."""
    line = F.concat(F.repeat(F.lit(" "), (F.col("o_orderkey") % 3).cast("int") * 4), F.sha1(F.col("o_orderkey").cast("string")), F.lit(" "), F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]+", "x"), F.lit(" "), F.sha1(F.col("o_custkey").cast("string")), F.lit(" "), F.sha1((-F.col("o_orderkey")).cast("string")))
    order = W.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = orders.select(F.col("o_custkey").alias("key"), F.row_number().over(order).alias("n"), F.count("*").over(W.partitionBy("o_custkey")).alias("of"), line.alias("line"))
    return rows.where("of >= 6")


SPELLED = """WITH t AS (SELECT o_custkey AS key, string_agg(repeat(' ', ((o_orderkey % 3) * 4)::INTEGER) || sha1(o_orderkey::VARCHAR) || ' ' || regexp_replace(lower(o_orderpriority), '[^a-z]+', 'x', 'g') || ' ' || sha1(o_custkey::VARCHAR) || ' ' || sha1((-o_orderkey)::VARCHAR), chr(10) ORDER BY o_orderkey) AS text, count(*) AS k FROM orders GROUP BY 1 HAVING count(*) >= 6)"""


def _readings(lines: DataFrame) -> DataFrame:
    """Each text read three times, from its second, first and first line on, the last time without its last line."""
    starts = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("low"), F.lit(b).alias("cut")) for o, a, b in ((1, 2, 0), (2, 1, 0), (3, 1, 1))]))
    return lines.select("key", "n", "of", "line", starts.alias("s")).where("n >= s.low AND n <= of - s.cut").select("key", F.col("s.ord").alias("ord"), "n", "line", F.lit(2).alias("rank"))


@add("q7_repaired_texts", f"{SPELLED} SELECT key, sha256(text) AS h, CASE WHEN key % 4 = 3 THEN 0 ELSE 1 END::BIGINT AS edits FROM t")
def q7_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Texts whose third line was doubled, skipped, or read like the second, by customer, come back as they were."""
    lines = _texts(table(spark, root, "orders"))
    above = F.lag("line").over(W.partitionBy("key").orderBy("n"))
    kind = F.col("key") % 4
    copies = F.when((F.col("n") == 3) & (kind == 0), 2).when((F.col("n") == 3) & (kind == 1), 0).otherwise(1)
    broken = lines.withColumn("line", F.when((F.col("n") == 3) & (kind == 2), above).otherwise(F.col("line"))).withColumn("copy", F.explode(F.array_repeat(F.lit(0), copies)))
    broken = broken.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("n", "copy"))).select("key", "n", "line")
    whole, log = repair.repaired(broken, _readings(lines))
    told = log.groupBy("key").agg(F.count("*").alias("edits"))
    return repair.text_of(whole).join(told, "key", "left").select("key", F.sha2("text", 256).alias("h"), F.coalesce("edits", F.lit(0)).cast("long").alias("edits"))


@add("q15_respaced_texts", f"{SPELLED} SELECT key, sha256(text) AS h, k::BIGINT AS measured FROM t")
def q15(spark: SparkSession, root: str) -> DataFrame:
    """Each reading has one gap too wide in some lines, the merged text in others: the votes give the true ones."""
    lines = _texts(table(spark, root, "orders"))
    wider = lambda when: F.when(when, F.regexp_replace("line", r"(\S) (\S)", "$1   $2")).otherwise(F.col("line"))
    finals = lines.select("key", "n", wider(F.col("n") % 2 == 0).alias("line"))
    readings = _readings(lines).withColumn("line", wider((F.col("n") % 5 == F.col("ord")) & (F.col("n") > 1) & (F.col("n") < 4)))
    found = repair.respaced(finals, readings)
    told = found.groupBy("key").agg(F.count_if(F.col("state") == "measured").alias("measured"))
    return repair.text_of(found).join(told, "key").select("key", F.sha2("text", 256).alias("h"), "measured")


@add("q5_joined_sideways", f"{SPELLED} SELECT key, sha256(text) AS h, 2::BIGINT AS pieces FROM t")
def q5(spark: SparkSession, root: str) -> DataFrame:
    """Of each text the columns 1 to 60 are at hand, 31 to 100 and 81 to the end come as pieces, the latter first."""
    # orders are dealt by customer before they are lines, so lines and pieces are where their text is
    lines = _texts(dealt(table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_custkey"))
    pieces = lines.withColumn("s", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(a).alias("at"), F.lit(n).alias("wide")) for o, a, n in ((1, 81, 1000), (2, 31, 70))])))
    pieces = pieces.select("key", F.col("s.ord").alias("ord"), "n", F.expr("substring(line, s.at, s.wide)").alias("line"))
    whole, places = repair.joined_sideways(lines.select("key", "n", F.substring("line", 1, 60).alias("line")), pieces)
    told = places.groupBy("key").agg(F.count("*").alias("pieces"))
    return repair.text_of(whole).join(told, "key").select("key", F.sha2("text", 256).alias("h"), "pieces")


@add("q8_equalised_offsets", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n, min(length(line) - length(ltrim(line, ' '))) FILTER (trim(line, ' ') <> '') * 0 AS margin FROM l GROUP BY 1")
def q8(spark: SparkSession, root: str) -> DataFrame:
    shifted = lines.lines_of(table(spark, root, "documents")).withColumn("line", F.concat(F.repeat(F.lit(" "), (F.col("doc_id") % 5).cast("int")), "line"))
    indent = F.length("line") - F.length(F.ltrim("line"))
    return sequence.equalised_offsets(shifted, "doc_id", "line").groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(F.trim("line") != "", indent)).cast("long").alias("margin"))


@add("q11_best_shift")
def q11(spark: SparkSession, root: str) -> DataFrame:
    """Each vector against itself moved by three places: the shift must be found."""
    vectors = table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    moved = F.slice("a", F.lit(4), F.size("a") - 3)
    return sequence.best_shift(vectors.withColumn("b", moved), "vec_id", "a", "b", 5)


@add("q12_verification_summary", "SELECT user_id, count(*) AS lines, count(*) FILTER (event_type = 'purchase') AS proven, count(*) FILTER (event_type = 'error') AS flagged, count(*) FILTER (event_type NOT IN ('purchase', 'error', 'view')) AS cut, count(*) FILTER (event_type = 'purchase') / count(*) AS share FROM events GROUP BY 1")
def q12(spark: SparkSession, root: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "verified").when(F.col("event_type") == "error", "mismatch").when(F.col("event_type") == "view", "unchecked").otherwise("cut")
    return sequence.verification_summary(table(spark, root, "events").select("user_id", status.alias("status")), "user_id", "status")


@add(
    "q13_completeness",
    r"""SELECT doc_id, list_filter([CASE WHEN length(text) - length(replace(text, '{', '')) <> length(text) - length(replace(text, '}', '')) THEN 'braces do not balance' END, CASE WHEN length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) THEN 'parentheses do not balance' END,
    CASE WHEN regexp_matches(text, '^[ \t]+\S') THEN 'starts inside a block' END, CASE WHEN regexp_matches(text, '[,(+]\s*$') THEN 'ends in an open statement' END], lambda x: x IS NOT NULL) AS reasons FROM documents""",
)
def q13(spark: SparkSession, root: str) -> DataFrame:
    return sequence.completeness(table(spark, root, "documents"))


@add("t7_near_duplicates_dropped")
def t7(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part").select("p_brand", "p_partkey", "p_retailprice", "p_name")
    return sequence.near_duplicates_dropped(part, "p_brand", "p_partkey", "p_retailprice", "p_name")


@add("t9_paragraph_dedup")
def t9(spark: SparkSession, root: str) -> DataFrame:
    kept = sequence.paragraphs_deduplicated(lines.lines_of(table(spark, root, "documents")))
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"))
