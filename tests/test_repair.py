"""Repairs of merged texts on hand-made places, and on random texts that were disturbed in known ways."""

import random

from weftline.operators import repair


def frames(spark, finals, readings):
    """finals: {key: lines}; readings: [(key, lines, rank or ranks)]."""
    f = [(k, i + 1, line) for k, lines in finals.items() for i, line in enumerate(lines)]
    r = [(k, o, i + 1, line, rank if isinstance(rank, int) else rank[i]) for o, (k, lines, rank) in enumerate(readings) for i, line in enumerate(lines)]
    return spark.createDataFrame(f, "key string, n int, line string").repartition(2), spark.createDataFrame(r, "key string, ord int, n int, line string, rank int").repartition(3)


def result(spark, finals, readings):
    lines, log = repair.repaired(*frames(spark, finals, readings))
    return {r.key: r.text.split("\n") for r in repair.text_of(lines).collect()}, {(r.key, r.repair, r.n) for r in log.collect()}


ROWS = [f"  STATUS_{n} = {n} + OFFSET;" for n in range(1, 10)]
TWICE = ROWS[:4] + [ROWS[3]] + ROWS[4:]


def test_a_line_one_reading_doubled_goes_and_one_that_repeats_stays(spark):
    finals = {"once": TWICE, "repeats": TWICE, "short": ["a;", "};", "};", "b;", "c;"], "short sure": ["a;", "};", "};", "b;", "c;"]}
    readings = [("once", ROWS[:6], 2), ("once", ROWS[2:], 2), ("once", ROWS[1:7], 2), ("once", TWICE[1:8], 2), ("repeats", TWICE[:6], 2), ("repeats", TWICE[2:], 2), ("repeats", TWICE[1:8], 2)]
    readings += [("short", ["a;", "};", "b;"], 2), ("short", ["a;", "};", "};", "b;"], 2)] + [("short sure", ["a;", "};", "b;"], 5)] * 2 + [("short sure", ["a;", "};", "};", "b;"], 2)]
    got, log = result(spark, finals, readings)
    assert got["once"] == ROWS and got["repeats"] == TWICE and got["short"] == finals["short"] and got["short sure"] == ["a;", "};", "b;", "c;"]
    assert log == {("once", "doubled", 5), ("short sure", "doubled", 3)}


def test_two_lines_stitched_in_twice(spark):
    pair = ROWS[:4] + ROWS[2:]
    got, log = result(spark, {"k": pair, "real": pair}, [("k", ROWS[:7], 2), ("k", ROWS[1:], 2), ("real", pair[:8], 2), ("real", pair[1:], 2), ("real", ROWS, 2)])
    assert got == {"k": ROWS, "real": pair} and log == {("k", "pairs", 5), ("k", "pairs", 6)}


def test_a_copy_in_the_place_of_another_line(spark):
    above, below = "INSERT INTO T VALUES (1, 'LAKE');", "INSERT INTO T VALUES (9, 'MILL');"
    x, y = "INSERT INTO T VALUES (4, 'ROAD');", "  INSERT INTO T VALUES (5, 'TOWN');"
    finals = {"votes": [above, x, x, below], "one vote": [above, x, x, below], "setting": ["[a]", "  size = 4", "  size = 4", "[b]"], "nested": ["<p>", "</div>", "</div>", "<q>"]}
    readings = [("votes", [above, x, y, below], 2)] * 2 + [("votes", [above, x, x, below], 2), ("one vote", [above, x, y, below], 2), ("one vote", [above, x, x, below], 2)]
    readings += [("setting", ["[a]", "  name = 4", "  size = 4", "[b]"], 2), ("setting", ["[a]", "  size = 4", "  size = 4", "[b]"], 2), ("nested", ["<p>", "</div>", "<hr>", "<q>"], 2), ("nested", ["<p>", "</div>", "</div>", "<q>"], 2)]
    got, log = result(spark, finals, readings)
    assert got["votes"] == [above, x, y, below] and got["one vote"] == finals["one vote"] and got["setting"] == ["[a]", "  name = 4", "  size = 4", "[b]"] and got["nested"] == finals["nested"]
    assert log == {("votes", "copied", 3), ("setting", "copied", 2)}


def test_a_line_that_was_skipped_comes_back(spark):
    without = ROWS[:4] + ROWS[5:]
    got, log = result(spark, {"back": without, "split": without}, [("back", ROWS[1:8], 2), ("back", ROWS[2:], 2), ("back", without, 2), ("split", ROWS, 2), ("split", without, 2), ("split", without[1:], 2)])
    assert got == {"back": ROWS, "split": without} and log == {("back", "skipped", 4)}


def test_garbled_twins(spark):
    good, bad = "    return self.decision(value)", "    return self decision(value"
    finals = {"twin": ["a", bad, good, "b"], "both": ["a", bad, good, "b"], "none": ["a", bad, good, "b"], "after": ["a", good, bad, "b"]}
    readings = [("twin", [good], 5), ("twin", [bad], 2), ("both", [good, bad], 5), ("none", [good, bad], 2), ("after", ["a", good], 5)]
    got, log = result(spark, finals, readings)
    assert got == {"twin": ["a", good, "b"], "both": finals["both"], "none": finals["none"], "after": ["a", good, "b"]}
    assert log == {("twin", "twins", 2), ("after", "twins", 3)}


def test_random_texts_lose_no_line_of_their_own(spark):
    rng = random.Random(3)
    finals, readings, want = {}, [], {}
    for k in range(40):
        rows = [" " * rng.randint(0, 6) + f"statement {k} {i} {rng.randrange(10**6)};" for i in range(rng.randint(14, 30))]
        at = rng.randint(4, len(rows) - 5)
        kind = rng.choice(["doubled", "skipped", "copied", "none"])
        broken = {"doubled": rows[: at + 1] + rows[at:], "skipped": rows[:at] + rows[at + 1 :], "copied": [*rows[:at], rows[at - 1], *rows[at + 1 :]], "none": rows}[kind]
        finals[str(k)], want[str(k)] = broken, rows
        readings += [(str(k), rows[max(0, at - s) : at + 9], 2) for s in (8, 6, 5)] + [(str(k), broken[at - 3 : at + 4], 2)]
    got, log = result(spark, finals, readings)
    assert got == want and len(log) == sum(finals[k] != want[k] for k in want)


def brute_spacing(final, readings):
    """Each line's gaps by the readings that hold the very same words at the line's only place (all lines differ here)."""
    out = []
    for line in final:
        same = [r for reading in readings for r in reading if r.split() == line.split()]
        gaps = [[len(g) for g in __import__("re").split(r"[^ ]+", x)[:-1]] for x in [line, *same]]
        new, words = "", line.split()
        for i, w in enumerate(words):
            widths = sorted({g[i] for g in gaps[1:]}, key=lambda v: -sum(g[i] == v for g in gaps[1:]))
            counts = [sum(g[i] == v for g in gaps[1:]) for v in widths]
            sure = len(widths) == 1 or (widths and counts[0] >= 2 and counts[0] >= 2 * counts[1])
            new += " " * (widths[0] if sure else gaps[0][i]) + w
        out.append(new)
    return out


def test_spacing_is_voted_gap_by_gap(spark):
    rng = random.Random(15)
    finals, readings, want = {}, [], {}

    def disturbed(line):
        return "".join(c + " " * (c == " " and rng.random() < 0.15) for c in line)

    for k in range(12):
        rows = [" " * rng.choice([0, 4, 8]) + f"MOVE FIELD-{i}  TO   AREA-{rng.randrange(10**6)} OF REC-{k}" for i in range(20)]
        own = [[disturbed(r) for r in rows[a : a + 12]] for a in (0, 0, 4, 4, 8, 8)]
        finals[str(k)] = [disturbed(r) for r in rows]
        readings += [(str(k), p, 2) for p in own]
        want[str(k)] = brute_spacing(finals[str(k)], own)
    lines = repair.respaced(*frames(spark, finals, readings))
    got = {r.key: r.text.split("\n") for r in repair.text_of(lines).collect()}
    assert got == want
    states = {r.state for r in lines.collect()}
    assert states >= {"measured", "conflict"}
    one = repair.respaced(*frames(spark, {"a": ["x", "", "y\tz", "w"]}, [("a", ["q"], 1)])).collect()
    assert {(r.n, r.line, r.state) for r in one} == {(1, "x", "unmeasured"), (2, "", ""), (3, "y\tz", "unmeasured"), (4, "w", "unmeasured")}


def sideways(spark, finals, pieces):
    f = [(k, i + 1, line) for k, lines in finals.items() for i, line in enumerate(lines)]
    p = [(k, o, i + 1, line) for o, (k, lines) in enumerate(pieces) for i, line in enumerate(lines)]
    lines, places = repair.joined_sideways(spark.createDataFrame(f, "key string, n int, line string").repartition(2), spark.createDataFrame(p, "key string, ord int, n int, line string").repartition(2))
    return {r.key: r.text.split("\n") for r in repair.text_of(lines).collect()}, {(r.key, r.ord): (r.rows, r.columns, r.conflicts) for r in places.collect()}


def test_clipped_pieces_are_joined_again(spark):
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n))
    finals, pieces, want = {}, [], {}
    for k in range(6):
        rows = [(" " * rng.choice([0, 4]) + words(rng.choice([3, 16, 22, 28]))).rstrip() for _ in range(24)]
        cut = lambda a, b, lo=0, hi=24: [r[a:b].rstrip() for r in rows[lo:hi]]  # noqa: B023, E731
        if k == 0:  # the text holds the middle; what stands left and right of it comes as pieces
            finals["0"] = cut(30, 90)
            pieces += [("0", cut(0, 60)), ("0", cut(70, 400))]
        else:  # two steps to the right, the first of fewer rows
            finals[str(k)] = cut(0, 60)
            pieces += [(str(k), cut(80, 400)), (str(k), cut(40, 110, 0, 24))]
        want[str(k)] = rows
    got, places = sideways(spark, finals, pieces)
    assert got == want
    assert all(conflicts == 0 for _, _, conflicts in places.values()) and len(places) == 12


def test_pieces_without_a_place_and_rows_that_differ(spark):
    rows = [f"{i:02d} some statement number {i * 7919} goes on {i * 104729} and on {i * 1299709}" for i in range(10)]
    right = [r[20:] for r in rows]
    right[4] = "XX" + right[4][2:]
    got, places = sideways(spark, {"a": [r[:36] for r in rows], "b": ["short"] * 5}, [("a", right), ("b", rows)])
    assert got["a"] == [r[:36].rstrip() if i == 4 else r for i, r in enumerate(rows)] and got["b"] == ["short"] * 5
    assert places == {("a", 0): (0, 20, 1)}


def test_a_piece_is_placed_by_what_rows_have_in_common(spark):
    """Where the text and the piece meet, all rows show the same word at different columns; only one shift is contradicted by no row."""
    word, rng = "abcdefghijklmnopqrstuvwxyz0123456789ABCD", random.Random(9)
    rows = ["".join(rng.choice("0123456789") for _ in range(at)) + word + "".join(rng.choice("0123456789") for _ in range(60)) for at in (48, 52, 48, 56, 52, 60)]
    got, places = sideways(spark, {"a": [r[:80] for r in rows], "b": [word] * 6}, [("a", [r[60:] for r in rows]), ("b", [word[9:] + "x"] * 4)])
    assert got == {"a": rows, "b": [word] * 6} and places == {("a", 0): (0, 60, 0)}
