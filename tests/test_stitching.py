"""The stitcher on repeated blocks, doubtful rows, gaps and better copies; and two readings combined by rank."""

import random

import pytest

from weftline.operators import sequence
from weftline.operators.sequence import Stitcher, stitched, usual_advance


def checks(n, limit):
    """A paragraph whose inner rows stand in every other paragraph too."""
    return [
        f"  {n:02d}00-CHECK-{n:02d}.",
        f"    * RULE {n:02d} OF THE OLD ROUTE",
        f"    IF AMOUNT > {limit}",
        "      MOVE HOLD TO RESULT",
        "    END-IF",
        "    IF AMOUNT < ZERO",
        "      MOVE REVERSE TO RESULT",
        "    END-IF",
        "    IF AMOUNT = ZERO",
        "      MOVE IGNORE TO RESULT",
        "    END-IF.",
    ]


def screens(rows, height, step):
    return [rows[top : top + height] for top in range(0, len(rows) - height + step, step)]


def merged(pieces, **options):
    stitcher = Stitcher(usual_advance(pieces))
    how = [stitcher.add(p, after) for p, after in zip(pieces, [*pieces[1:], None], strict=True)]
    return stitcher, how


SOURCE = [row for n in range(1, 13) for row in checks(n, 1000 + 275 * n)]


@pytest.mark.parametrize(("height", "step"), [(24, 14), (30, 18), (17, 11), (40, 9)])
def test_repeated_paragraphs_come_back_exactly(height, step):
    pieces = screens(SOURCE, height, step)
    stitcher, how = merged(pieces)
    assert stitcher.lines == SOURCE and "break" not in how
    stitcher, how = merged(pieces[::-1])
    assert stitcher.lines == SOURCE and "break" not in how


@pytest.mark.parametrize("junk", ["    END-IF", "    ~~ ? ~~"])
def test_a_misread_last_row_of_each_screen_is_let_go(junk):
    pieces = [p if len(p) < 30 else [*p[:-1], junk] for p in screens(SOURCE, 30, 18)]
    stitcher, how = merged(pieces)
    heads = [row for row in stitcher.lines if "-CHECK-" in row]
    assert heads == [row for row in SOURCE if "-CHECK-" in row]
    assert stitcher.lines[:-1] == SOURCE[: len(stitcher.lines) - 1] and how.count("trimmed") >= 5
    assert all(junk in pair for pair in stitcher.conflicts)


def test_a_block_that_repeats_is_kept_and_a_look_back_is_not():
    block = [f"row {i} of the block" for i in range(10)]
    start, middle, end = ([f"{w} {i}" for i in range(10)] for w in ("start", "middle", "end"))
    stitcher, how = merged([start + block, block[-4:] + middle, block, [*block[-5:], *end]])
    assert how == ["first", "exact", "break", "exact"] and stitcher.lines == start + block + middle + block + end
    text = start + block + middle
    stitcher, how = merged([text[:15], text[10:30], text[4:14], text[11:21], text[18:30] + end])
    assert stitcher.lines == text + end and "break" not in how and how.count("contained") == 2


def test_rows_that_are_all_alike_are_never_lost_in_silence():
    for n in (20, 47, 101):
        rows = ["the same row"] * n
        pieces = screens(rows, 12, 8)
        stitcher, how = merged(pieces)
        assert len(stitcher.lines) >= n and stitcher.ambiguous == len(pieces) - 1
    rows = [f"row {i}" for i in range(30)] + ["the same row"] * 20 + [f"tail {i}" for i in range(30)]
    stitcher, how = merged(screens(rows, 12, 8))
    assert stitcher.lines == rows and stitcher.ambiguous > 0  # by the usual advance


def test_a_later_fragment_closes_a_gap():
    rows = [f"line {i} says {i * i}" for i in range(60)]
    stitcher, how = merged([rows[:20], rows[30:50], rows[15:35], rows[45:]])
    assert how == ["first", "break", "bridged", "exact"] and stitcher.lines == rows and stitcher.gaps == []
    stitcher, how = merged([rows[:20], rows[30:50], [*rows[15:19], "another line", *rows[19:22]]])
    assert how[-1] in ("alike", "anchored", "break") and stitcher.gaps  # shows one side only


def test_a_better_copy_of_a_row_replaces_it_and_differences_are_told():
    rows = [f"   MOVE FIELD-{i} TO OUTPUT-AREA-{i}" for i in range(30)]
    worse = [*rows[:18], rows[18].replace("MOVE", "M0VE"), rows[19]]
    stitcher = Stitcher()
    stitcher.add(worse, ranks=[2] * 20)
    stitcher.add(rows[12:], ranks=[5] * 18)
    assert stitcher.lines == rows and (rows[18], worse[18]) in stitcher.conflicts
    stitcher = Stitcher()
    stitcher.add(rows[:20], ranks=[5] * 20)
    stitcher.add([*rows[12:15], "   M0VE FIELD-15 TO OUTPUT-AREA-15", *rows[16:]], ranks=[2] * 18)
    assert stitcher.lines == rows and stitcher.conflicts == [(rows[15], "   M0VE FIELD-15 TO OUTPUT-AREA-15")]


def test_random_texts_are_whole_or_say_so():
    rng = random.Random(8)
    for _ in range(400):
        rows = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        size, step = rng.choice([(6, 3), (8, 5), (12, 8), (5, 2)])
        pieces = [rows[i : i + size] for i in range(0, max(1, len(rows) - size + step), step)]
        for order in (pieces, pieces[::-1]):
            stitcher, how = merged(order)
            assert stitcher.lines == rows or stitcher.ambiguous or "break" in how


def test_fragments_through_spark(spark):
    rows = [(1, i, "\n".join(p), [3] * len(p)) for i, p in enumerate(screens(SOURCE, 24, 14))] + [(2, 0, "", [0]), (2, 1, "x", [1]), (3, 0, None, None)]
    frame = spark.createDataFrame(rows, "artifact_id long, ord int, text string, rank array<int>").repartition(3)
    got = {r.artifact_id: r for r in sequence.stitched(frame, ranks="rank").collect()}
    assert got[1].text == "\n".join(SOURCE) and (got[1].breaks, got[1].conflicts) == (0, [])
    assert got[2].text == "x" and got[3].text == ""


def combined(spark, a, b, first, second):
    frame = spark.createDataFrame([(1, "\n".join(a), "\n".join(b), first, second)], "id long, a string, b string, ra array<int>, rb array<int>")
    (row,) = sequence.combined(frame, "id", "a", "b", "ra", "rb").collect()
    return row


def test_ranks_decide_between_equal_lines_too(spark):
    row = combined(spark, ["a  b", "c", "x1"], ["a b", "c", "x2"], [1, 1, 5], [5, 1, 1])
    assert row.text == "a b\nc\nx1" and row.conflicts == [3] and row.agreed == [1, 2]
    row = combined(spark, ["  a", "b"], [" a", "b"], [1, 1], [5, 0])
    assert row.text == " a\nb" and row.conflicts == [1]


def test_what_one_reading_alone_has_at_an_edge_is_no_conflict(spark):
    lines = [f"line number {i}" for i in range(12)]
    assert combined(spark, lines, lines[3:], None, None).conflicts == []
    assert combined(spark, lines[:9], lines, None, None).conflicts == []
    assert combined(spark, lines[:4] + lines[6:], lines, None, None).conflicts == [5, 6]


def test_artifacts_are_dealt_over_all_partitions_as_plain_rows(spark):
    """Spark would merge the few bytes to one partition, and read each artifact as a pandas group of its own."""
    texts = {k: [f"row {k} {i}" for i in range(40)] for k in range(60)}
    parts = [(k, -w, "\n".join(t[8 * w : 8 * w + 12])) for k, t in texts.items() for w in range(5)] + [(60, 0, None), (None, 0, "x")]
    merged = stitched(spark.createDataFrame(parts, "artifact_id long, ord int, text string"))
    assert {(r.artifact_id, r.text, r.breaks) for r in merged.collect()} == {(k, "\n".join(t), 0) for k, t in texts.items()} | {(60, "", 0), (None, "x", 0)}
    assert merged.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().toString()
