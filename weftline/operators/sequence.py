"""Merging of ordered text fragments (Q*): folds per artifact, in parallel over artifacts.

A fold needs its artifact's fragments in order in one task; that is its unit of work, and its size
is bounded by one document, not by the table.
"""

from __future__ import annotations

import difflib
import re
from bisect import insort
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from weftline.operators.lines import carried_down
from weftline.staging import dealt

# How far a line's reading is to be trusted.
RANK = {"verified": 5, "reread": 5, "confirmed": 4, "joined": 3, "unchecked": 2, "edited": 2, "mismatch": 1, "rows": 1, "wrapped": 1, "cut": 0}
LONGEST_OVERLAP, LINE_LIKE, MEAN_LIKE, MOST_TRIMMED = 60, 0.7, 0.8, 2
#: Rows that two fragments must share for a seam.
SEAM = 3


def rank_of(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair]), status), F.lit(0))


def alignment(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Q1: (key, tag, left_from, left_to, right_from, right_to): how the lines of one text become those of the other."""

    def run(frames):
        for frame in frames:
            rows = []
            for k, a, b in frame.itertuples(index=False):
                matcher = difflib.SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n"), autojunk=False)
                rows.extend((k, *op) for op in matcher.get_opcodes())
            yield pd.DataFrame(rows, columns=["key", "tag", "left_from", "left_to", "right_from", "right_to"])

    kind = pairs.schema[key].dataType.simpleString()
    found = pairs.select(key, left, right).mapInPandas(run, f"key {kind}, tag string, left_from int, left_to int, right_from int, right_to int")
    return found.withColumnRenamed("key", key)


def line_likeness(x: str, y: str) -> float:
    """1 for equal lines up to spaces; 0 when their digits differ; else the ratio."""
    a, b = " ".join(x.split()), " ".join(y.split())
    if a == b:
        return 1.0
    if re.findall(r"\d+", a) != re.findall(r"\d+", b):
        return 0.0
    if 2 * min(len(a), len(b)) < LINE_LIKE * (len(a) + len(b)):
        return 0.0
    return difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


class Stitcher:
    """Q2, Q3: the text so far, its lines as keys, where each key stands, and which rows the latest fragment took.

    A fragment is expected to overlap the one before it. It may lie at any place where it has `SEAM`
    rows or more in common with that one and agrees with every row of the text that it covers. With
    one such place, that is it. With several, as where rows repeat, no text can tell which is true: the
    artifact's usual advance decides, if it is among them, else the place that adds most rows, so that none
    is lost; such a seam counts as ambiguous. Rows that differ at a shared place are conflicts.
    """

    def __init__(self, usual: int | Callable[[], int | None] | None = None) -> None:
        self.lines: list[str] = []
        self.keys: list[str] = []
        self.ranks: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.shift = 0  # positions in `at` count from here, so that lines put in front move nothing
        self.usual = usual
        self.span = (0, 0)
        self.gaps: list[int] = []  # where a break stands, counted like `at`
        self.ambiguous = 0
        self.conflicts: list[tuple[str, str]] = []

    def _push(self, lines: list[str], ranks: list[int] | None = None) -> None:
        for line in lines:
            key = _key(line)
            self.at.setdefault(key, []).append(len(self.keys) + self.shift)
            self.lines.append(line)
            self.keys.append(key)
        self.ranks += ranks or [0] * len(lines)

    def _pop(self, n: int) -> None:
        for _ in range(n):
            self.at[self.keys.pop()].pop()
            self.lines.pop()
            self.ranks.pop()

    def _put_before(self, lines: list[str], ranks: list[int]) -> None:
        keys = [_key(line) for line in lines]
        self.shift -= len(lines)
        found: dict[str, list[int]] = {}
        for i, key in enumerate(keys):
            found.setdefault(key, []).append(self.shift + i)
        for key, places in found.items():
            self.at[key] = places + self.at.get(key, [])
        self.lines[:0], self.keys[:0], self.ranks[:0] = lines, keys, ranks

    def _insert(self, at: int, lines: list[str], ranks: list[int]) -> None:
        self.lines[at:at], self.keys[at:at], self.ranks[at:at] = lines, [_key(x) for x in lines], ranks
        self.gaps = [g + len(lines) * (g - self.shift > at) for g in self.gaps]
        self.at = {}
        for i, key in enumerate(self.keys):
            self.at.setdefault(key, []).append(i + self.shift)

    def _agrees(self, new: list[str], offset: int) -> bool:
        low, high = max(0, offset), min(len(self.keys), offset + len(new))
        return self.keys[low] == new[low - offset] and self.keys[low:high] == new[low - offset : high - offset]

    def places(self, new: list[str], span: tuple[int, int]) -> list[int]:
        """All offsets at which `new` shares SEAM rows with `span`, or lies inside it, and agrees with all rows it covers."""
        (start, end), n = span, len(new)
        least = min(SEAM, n) if n < SEAM else SEAM
        offsets = range(start - n + least, end - least + 1) if n >= SEAM else range(start, end - n + 1)
        return [o for o in offsets if self._agrees(new, o)]

    def _telling(self, new: list[str], pairs: list[tuple[int, int]]) -> int:
        """How many of the (row of the text, row of the fragment) pairs are of rows that both have once."""
        counts = Counter(new)
        return sum(new[j] != "" and counts[new[j]] == 1 and len(self.at.get(new[j], ())) == 1 for _, j in pairs)

    def _trimmed(self, new: list[str]) -> tuple[int, int, int, int] | None:
        """(telling rows, offset, cut, drop) of a seam that lets go of a few doubtful rows at the end of the text or the start of the fragment; fewest of them first, then most telling rows."""
        keys, options = self.keys, []
        for cut in range(MOST_TRIMMED + 1):
            for drop in range(MOST_TRIMMED + 1):
                end, head = len(keys) - cut, new[drop:]
                for k in range(min(len(head), end - self.span[0]), SEAM - 1, -1) if cut or drop else ():
                    if keys[end - k] == head[0] and keys[end - k : end] == head[:k] and any(head[:k]):
                        telling = self._telling(new, [(end - k + i, drop + i) for i in range(k)])
                        options.append((-(cut + drop), telling, k, end - k - drop, cut, drop))
        if not options:
            return None
        _, telling, _, offset, cut, drop = max(options)
        return telling, offset, cut, drop

    def _alike(self, new: list[str]) -> int | None:
        """The offset of the longest seam at the end of the text whose rows are alike, each and on average."""
        keys = self.keys
        for k in range(min(LONGEST_OVERLAP, len(keys) - self.span[0], len(new)), SEAM - 1, -1):
            likeness = []
            for a, b in zip(keys[-k:], new[:k], strict=True):
                value = line_likeness(a, b)
                if value < LINE_LIKE:
                    break
                likeness.append(value)
            if len(likeness) == k and sum(likeness) / k >= MEAN_LIKE and sum(bool(x) for x in new[:k]) >= 2:
                return len(keys) - k
        return None

    def _bridge(self, new: list[str]) -> tuple[int, int, int] | None:
        """(row at which a break stands, rows before it, rows after it) where the fragment shows both sides of it."""
        for gap in self.gaps:
            at = gap - self.shift
            before = next((i for i in range(min(at, len(new) - 2), 1, -1) if new[:i] == self.keys[at - i : at]), 0)
            after = next((j for j in range(min(len(self.keys) - at, len(new) - before), 1, -1) if new[-j:] == self.keys[at : at + j]), 0)
            if before and after:
                return at, before, after
        return None

    def _standing(self, new: list[str]) -> list[int]:
        """Where the whole fragment stands in the text."""
        rarest = min(range(len(new)), key=lambda i: (len(self.at.get(new[i], ())), i))
        starts = (p - self.shift - rarest for p in self.at.get(new[rarest], ()))
        return [s for s in starts if s >= 0 and self.keys[s : s + len(new)] == new]

    def _goes_on(self, new: list[str], following: list[str], start: int) -> bool:
        """False where the following fragment continues this one, but not the text at the place where this one stands: then it is another copy."""
        alone = Stitcher()
        alone._append(new, [0] * len(new))
        return not alone.places(following, alone.span) or bool(self.places(following, (start, start + len(new))))

    def _anchor(self, new: list[str]) -> int | None:
        """Where the fragment begins by the rows that both have once: three or more that agree on it, and most of all such rows."""
        counts = Counter(new)
        votes = Counter(self.at[key][0] - self.shift - i for i, key in enumerate(new) if key and counts[key] == 1 and len(self.at.get(key, ())) == 1)
        if not votes:
            return None
        best = max(votes, key=lambda o: (votes[o], -abs(o)))
        return best if votes[best] >= 3 and 2 * votes[best] > sum(votes.values()) else None

    def _place(self, incoming: list[str], ranks: list[int], offset: int, drop: int = 0) -> None:
        """Lay the fragment at an offset. Of two readings of a row the higher rank stays, the text's among equals; readings that differ are a conflict."""
        n, front = len(incoming), max(0, -offset)
        for j in range(drop, n):
            i = offset + j
            if 0 <= i < len(self.lines):
                other = _key(incoming[j])
                if other != self.keys[i]:
                    better = ranks[j] > self.ranks[i]
                    self.conflicts.append((incoming[j], self.lines[i]) if better else (self.lines[i], incoming[j]))
                    if better:
                        self.at[self.keys[i]].remove(i + self.shift)
                        insort(self.at.setdefault(other, []), i + self.shift)
                        self.keys[i] = other
                if ranks[j] > self.ranks[i]:
                    self.lines[i], self.ranks[i] = incoming[j], ranks[j]
        beyond = len(self.lines) - offset
        if beyond < n:
            self._push(incoming[beyond:], ranks[beyond:])
        if front:
            self._put_before(incoming[:front], ranks[:front])
        self.span = (offset + front, offset + front + n)

    def _append(self, incoming: list[str], ranks: list[int]) -> str:
        if self.lines:
            self.gaps.append(len(self.lines) + self.shift)
        self._push(incoming, ranks)
        self.span = (len(self.lines) - len(incoming), len(self.lines))
        return "break"

    def add(self, incoming: list[str], following: list[str] | None = None, ranks: list[int] | None = None) -> str:
        """Join one fragment and say how: first, blank, contained, exact, prepended, ambiguous, bridged, trimmed, alike, anchored or break.

        One that adds nothing at its place, while the `following` fragment continues it but not the text
        there, is another copy and follows after a break. Without an exact place beside the fragment before it, a fragment may show both sides of an earlier
        break, let go of up to two doubtful rows at the seam, or read alike. One that stands as a whole
        elsewhere in the text is a look back only if the `following` fragment goes on from there; else it
        is a block that repeats, and follows after a break. Rows that both have once may place it.
        What has no place follows after a break.
        """
        ranks = list(ranks) if ranks is not None and len(ranks) == len(incoming) else [0] * len(incoming)
        if incoming == [""]:
            return "blank"
        if not self.lines:
            self._append(incoming, ranks)
            return "first"
        new = [_key(x) for x in incoming]
        found = self.places(new, self.span)
        at_end = self.span[1] == len(self.lines)
        if found:
            offset, how = found[0], "exact"
            covered = [(i, i - offset) for i in range(max(0, offset), min(len(self.keys), offset + len(new)))]
            if len(found) == 1 and at_end and not self._telling(new, covered):
                better = self._trimmed(new)  # a seam of common rows alone gives way to a longer one of telling rows
                if better and better[0] >= SEAM:
                    found = []
            if len(found) > 1:
                self.ambiguous += 1
                if callable(self.usual):
                    self.usual = self.usual()
                expected = None if self.usual is None else self.span[0] + self.usual
                offset, how = (expected, "ambiguous") if expected in found else (max(found, key=lambda o: (max(0, -o) + max(0, o + len(new) - len(self.keys)), o)), "ambiguous")
            if found:
                if how == "exact" and offset < 0:
                    how = "prepended"
                elif how == "exact" and offset + len(new) <= len(self.lines):
                    how = "contained"
                    if following and not self._goes_on(new, [_key(x) for x in following], offset):
                        return self._append(incoming, ranks)
                self._place(incoming, ranks, offset)
                return how
        bridge = self._bridge(new)
        if bridge:
            at, before, after = bridge
            self.gaps.remove(at + self.shift)
            self._insert(at, incoming[before : len(new) - after], ranks[before : len(new) - after])
            moved = (len(new) - before - after) * (self.span[0] >= at)  # the next fragment is expected where it was
            self.span = (self.span[0] + moved, self.span[1] + moved)
            return "bridged"
        trimmed = self._trimmed(new) if at_end else None
        if trimmed:
            _, offset, cut, drop = trimmed
            for i in range(len(self.lines) - cut, len(self.lines)):
                if i - offset < len(new):
                    self.conflicts.append((incoming[i - offset], self.lines[i]))
            self.conflicts += [(self.lines[offset + j], incoming[j]) for j in range(drop) if 0 <= offset + j < len(self.lines)]
            if len(self.lines) - cut - offset < len(new):
                self._pop(cut)
            self._place(incoming, ranks, offset, drop)
            return "trimmed"
        alike = self._alike(new) if at_end else None
        if alike is not None:
            self._place(incoming, ranks, alike)
            return "alike"
        for start in self._standing(new):
            after = [_key(x) for x in following or []]
            if after and self.places(after, (start, start + len(new))):
                self.span = (start, start + len(new))
                return "contained"
            return self._append(incoming, ranks)
        offset = self._anchor(new)
        if offset is not None:
            self._place(incoming, ranks, offset)
            return "anchored"
        return self._append(incoming, ranks)


def _key(line: str) -> str:
    return " ".join(line.split())


def usual_advance(pieces: list[list[str]]) -> int | None:
    """By how many rows fragments most often move on from the one before, of those whose seam is certain; the smallest of equals."""
    found: Counter[int] = Counter()
    for a, b in zip(pieces, pieces[1:], strict=False):
        pair = Stitcher()
        pair._append(a, [0] * len(a))
        places = pair.places([_key(x) for x in b], pair.span)
        if len(places) == 1:
            found[places[0]] += 1
    return min(found, key=lambda o: (-found[o], abs(o), o)) if found else None


def stitch_two(merged: list[str], incoming: list[str]) -> tuple[list[str], str]:
    """Q2: two texts as one, and how they were joined."""
    stitcher = Stitcher()
    stitcher._append(merged, [0] * len(merged))
    stitcher.gaps = []
    how = stitcher.add(incoming)
    return stitcher.lines, how


def stitched(fragments: DataFrame, key: str = "artifact_id", order: str = "ord", text: str = "text", ranks: str | None = None) -> DataFrame:
    """Q2, Q3: (key, text, breaks, ambiguous, joins, conflicts): each artifact's fragments merged in order.

    breaks counts fragments without a place, ambiguous those with several; conflicts lists the readings
    (kept, other) that differ at a shared place. `ranks` names a column with a rank for each line.
    """
    result = f"{key} {fragments.schema[key].dataType.simpleString()}, text string, breaks long, ambiguous long, joins string, conflicts array<struct<kept:string,other:string>>"

    def fold(of, group: list[tuple]) -> tuple:
        group = sorted((g for g in group if g[1] is not None), key=lambda g: (g[0] is None, g[0] or 0, g[1]))
        pieces = [g[1].split("\n") for g in group]
        stitcher = Stitcher(lambda: usual_advance(pieces))  # counted only where a seam is ambiguous
        trust = [g[2] for g in group] if ranks else [None] * len(pieces)
        how = [stitcher.add(piece, after, rank) for piece, after, rank in zip(pieces, [*pieces[1:], None], trust, strict=False)]
        conflicts = [{"kept": a, "other": b} for a, b in stitcher.conflicts]
        return of, "\n".join(stitcher.lines), how.count("break"), stitcher.ambiguous, ",".join(how), conflicts

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One artifact after another, as their rows come; a batch for each that was read."""
        of, group, kind = None, [], None
        reading = pa.list_(pa.struct([("kept", pa.string()), ("other", pa.string())]))
        table_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (kind, pa.string(), pa.int64(), pa.int64(), pa.string(), reading), strict=True)], [key, "text", "breaks", "ambiguous", "joins", "conflicts"])
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for this, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if group and this != of:
                    done.append(fold(of, group))
                    group = []
                of = this
                group.append(row)
            if done:
                yield table_of(done)
        if group:
            yield table_of([fold(of, group)])

    rows = fragments.select(key, order, text, *([ranks] if ranks else []))
    return dealt(rows, key).sortWithinPartitions(key).mapInArrow(merged, result)


def merged_by_numbers(lines: DataFrame, key: str, n: str, text: str, status: str) -> tuple[DataFrame, DataFrame]:
    """Q4: (merged lines, conflicts): lines placed by their own number; the best-ranked reading wins, then the smallest text.

    Plain aggregates, so an artifact may have any number of readings.
    """
    best = F.min(F.struct((-rank_of(F.col(status))).alias("r"), F.col(text).alias("t")))
    grouped = lines.groupBy(key, n).agg(best["t"].alias(text), F.count_distinct(text).alias("readings"))
    return grouped.select(key, n, text), grouped.where("readings > 1").select(key, n, "readings")


def combined(pairs: DataFrame, key: str, first: str, second: str, first_ranks: str | None = None, second_ranks: str | None = None) -> DataFrame:
    """Q6: (key, text, agreed, conflicts, added, dropped): two readings of each artifact as one.

    The alignment (Q1) gives blocks; everything else is decided per block by column expressions and
    put together in order. Lines that both have are agreed if indented alike. Where both have a
    line, the reading with the higher rank is kept (columns of ranks, one for each line; the first
    reading without them and among equals); of blocks that differ in length the one with more text
    is. Readings that differ are conflicts, and so are blocks inside the first reading that one
    reading alone has (at its start or end the other may just begin later or end sooner). Such a
    block stays, unless it is a copy: it
    stands twice in its own reading, or most of its longer lines stand in the other reading, away
    from the place where the block would be (as far as the block is long).
    """
    ranks = [(F.col(r) if r else F.array().cast("array<int>")).alias(name) for r, name in ((first_ranks, "ra"), (second_ranks, "rb"))]
    read = pairs.select(key, *ranks, F.split(F.coalesce(first, F.lit("")), "\n").alias("a"), F.split(F.coalesce(second, F.lit("")), "\n").alias("b"))
    keyed = read.withColumns({"ka": _line_keys("a"), "kb": _line_keys("b")})
    joined = keyed.select("*", F.array_join("ka", "\n").alias("ta"), F.array_join("kb", "\n").alias("tb"))
    blocks = alignment(joined.select(key, "ta", "tb"), key, "ta", "tb").join(joined, key)
    part = lambda of, side: F.slice(of, F.col(f"{side}_from") + 1, F.col(f"{side}_to") - F.col(f"{side}_from"))
    blocks = blocks.withColumns({"xs": part("a", "left"), "ys": part("b", "right"), "rx": part("ra", "left"), "ry": part("rb", "right")})
    mine = F.when(F.col("tag") == "delete", part("ka", "left")).otherwise(part("kb", "right"))
    blocks = blocks.withColumn("keys", mine)
    own = F.when(F.col("tag") == "delete", F.col("ta")).otherwise(F.col("tb"))
    away = lambda of, side: F.concat(F.slice(of, F.lit(1), F.greatest(F.lit(0), F.col(f"{side}_from") - F.size("keys"))), F.slice(of, F.col(f"{side}_to") + F.size("keys") + 1, F.size(of)))
    other = F.when(F.col("tag") == "delete", away("kb", "right")).otherwise(away("ka", "left"))
    bordered = F.concat(F.lit("\n"), F.replace(own, F.lit("\n"), F.lit("\n\n")), F.lit("\n"))  # each line has both its borders
    spelled = F.concat(F.lit("\n"), F.array_join("keys", "\n\n"), F.lit("\n"))
    telling = F.filter("keys", lambda k: F.length(k) >= 6)
    elsewhere = F.size(F.filter(telling, lambda k: F.array_contains(other, k)))
    twice = (F.size("keys") >= 3) & (F.length(bordered) - F.length(F.replace(bordered, spelled, F.lit(""))) >= 2 * F.length(spelled))
    copy = F.col("tag").isin("delete", "insert") & (twice | ((F.size(telling) >= 3) & (elsewhere >= 0.8 * F.size(telling))))
    state = lambda line, name: F.struct(line.alias("line"), F.when(F.trim(line) == "", "").otherwise(name).alias("state"))
    indent = lambda line: F.length(line) - F.length(F.ltrim(line))
    written = lambda side: F.size(F.filter(side, lambda x: F.trim(x) != ""))
    rank = lambda side, i: F.coalesce(F.get(side, i), F.lit(0))
    better = lambda x, i: F.when(rank("ry", i) > rank("rx", i), F.get("ys", i)).otherwise(x)
    inside = F.when((F.col("left_from") > 0) & (F.col("left_to") < F.size("a")), "conflict").otherwise("edge")
    kept = (
        F.when(F.col("tag") == "equal", F.transform("xs", lambda x, i: state(better(x, i), F.when(indent(x) == indent(F.get("ys", i)), "agreed").otherwise("conflict"))))
        .when(copy, F.array().cast("array<struct<line:string,state:string>>"))
        .when(F.col("tag") == "delete", F.transform("xs", lambda x: state(x, inside)))
        .when(F.col("tag") == "insert", F.transform("ys", lambda y: state(y, inside)))
        .when(F.size("xs") == F.size("ys"), F.transform("xs", lambda x, i: state(better(x, i), F.lit("conflict"))))
        .when(written("xs") >= written("ys"), F.transform("xs", lambda x: state(x, F.lit("conflict"))))
        .otherwise(F.transform("ys", lambda y: state(y, F.lit("conflict"))))
    )
    decided = blocks.select(key, "left_from", "right_from", kept.alias("kept"), F.when(copy, F.size("keys")).otherwise(0).alias("lost"), F.when((F.col("tag") == "insert") & ~copy, F.size("keys")).otherwise(0).alias("new"))
    ordered = F.array_sort(F.collect_list(F.struct("left_from", "right_from", "kept")))
    whole = decided.groupBy(key).agg(F.flatten(F.transform(ordered, lambda o: o["kept"])).alias("l"), F.sum("new").cast("int").alias("added"), F.sum("lost").cast("int").alias("dropped"))
    at = lambda name: F.filter(F.transform("l", lambda x, i: F.when(x["state"] == name, i + 1)), lambda i: i.isNotNull())
    return whole.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), at("agreed").alias("agreed"), at("conflict").alias("conflicts"), "added", "dropped")


def _line_keys(lines: str) -> Column:
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(F.replace(x, F.lit("[CUT OFF]"), F.lit("")), r"\s+", " ")))


def voted(readings: DataFrame, by: list[str], text: str, status: str) -> DataFrame:
    """Q7: the line with at least twice the votes of the next; verified readings count double."""
    from weftline.operators.aggregates import plurality

    return plurality(readings, by, text, F.when(rank_of(F.col(status)) >= 5, 2).otherwise(1))


def equalised_offsets(lines: DataFrame, fragment: str, line: str) -> DataFrame:
    """Q8: each fragment shifted left by its most frequent indent among its least ones (the mode of the minimum per fragment)."""
    indent = F.length(line) - F.length(F.ltrim(F.col(line)))
    least = lines.where(F.trim(F.col(line)) != "").groupBy(fragment).agg(F.min(indent).alias("__margin"))
    moved = lines.join(least, fragment, "left")
    return moved.withColumn(line, F.expr(f"substring({line}, coalesce(__margin, 0) + 1)")).drop("__margin")


def certain_rows(a: list[str], b: list[str], least_run: int = 3) -> list[tuple[int, int]]:
    """Q10: pairs of rows that every longest common subsequence has, in runs of three or more."""
    n, m = len(a), len(b)
    ahead, back = np.zeros((n + 1, m + 1), int), np.zeros((n + 1, m + 1), int)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            ahead[i, j] = ahead[i + 1, j + 1] + 1 if a[i] == b[j] else max(ahead[i + 1, j], ahead[i, j + 1])
    for i in range(n):
        for j in range(m):
            back[i + 1, j + 1] = back[i, j] + 1 if a[i] == b[j] else max(back[i, j + 1], back[i + 1, j])
    on = [(i, j) for i in range(n) for j in range(m) if a[i] == b[j] and back[i, j] + 1 + ahead[i + 1, j + 1] == ahead[0, 0]]
    alone = [(i, j) for i, j in on if sum(x == i for x, _ in on) == 1 and sum(y == j for _, y in on) == 1]
    sure, run = [], []
    for pair in alone:
        if run and (pair[0] - run[-1][0], pair[1] - run[-1][1]) != (1, 1):
            sure += run if len(run) >= least_run else []
            run = []
        run.append(pair)
    return sure + (run if len(run) >= least_run else [])


def best_shift(pairs: DataFrame, key: str, a: str, b: str, most: int) -> DataFrame:
    """Q11: the offset of vector b against a with the smallest mean distance; array functions only."""

    def at(shift: Column) -> Column:
        x = F.slice(F.col(a), F.greatest(F.lit(1), shift + 1), F.greatest(F.size(a), F.size(b)))
        y = F.slice(F.col(b), F.greatest(F.lit(1), 1 - shift), F.greatest(F.size(a), F.size(b)))
        n = F.least(F.size(x), F.size(y))
        total = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: F.abs(p - q).cast("double")), F.lit(0.0), lambda s, v: s + v)
        return F.struct((total / n).alias("distance"), shift.alias("shift"))

    best = F.array_min(F.transform(F.sequence(F.lit(-most), F.lit(most)), at))
    return pairs.select(key, best["shift"].alias("shift"), best["distance"].alias("distance"))


def verification_summary(lines: DataFrame, key: str, status: str) -> DataFrame:
    """Q12: counts of line states per artifact and the share of proven lines."""
    rank = rank_of(F.col(status))
    out = lines.groupBy(key).agg(F.count("*").alias("lines"), F.count_if(rank >= 4).alias("proven"), F.count_if(rank == 1).alias("flagged"), F.count_if(rank == 0).alias("cut"))
    return out.withColumn("share", F.col("proven") / F.col("lines"))


def completeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Q13, Q14: reasons to think that a text is cut: unbalanced brackets, an open last line, an indented first line."""
    count = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    reasons = F.array_compact(
        F.array(
            F.when(count("{") != count("}"), F.lit("braces do not balance")),
            F.when(count("(") != count(")"), F.lit("parentheses do not balance")),
            F.when(F.col(text).rlike(r"^[ \t]+\S"), F.lit("starts inside a block")),
            F.when(F.col(text).rlike(r"[,(+]\s*$"), F.lit("ends in an open statement")),
        )
    )
    return docs.select(key, reasons.alias("reasons"))


def aligned_rows(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Q10: (key, left_n, right_n): rows (from 1) that every longest common subsequence of the two texts pairs, in runs of three or more."""

    def run(frames):
        for frame in frames:
            rows = [(k, i + 1, j + 1) for k, a, b in frame.itertuples(index=False) for i, j in certain_rows((a or "").split("\n"), (b or "").split("\n"))]
            yield pd.DataFrame(rows, columns=["key", "left_n", "right_n"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, left, right).mapInPandas(run, f"key {kind}, left_n int, right_n int").withColumnRenamed("key", key)


def corresponding_lines(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(key, left_n, right_n, equal): lines (from 1) of two texts that the alignment puts side by side: equal ones, and those of replaced blocks of one length."""
    blocks = alignment(pairs, key, left, right).where("tag = 'equal' OR (tag = 'replace' AND left_to - left_from = right_to - right_from)")
    each = blocks.select(key, "tag", "left_from", "right_from", F.explode(F.sequence(F.lit(1), F.col("left_to") - F.col("left_from"))).alias("i"))
    return each.select(key, (F.col("left_from") + F.col("i")).alias("left_n"), (F.col("right_from") + F.col("i")).alias("right_n"), (F.col("tag") == "equal").alias("equal"))


def edge_evidence(docs: DataFrame, confirmed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Q14: (key, first_proved, last_proved): whether the first and last written line are confirmed (key, signature) or show by form that nothing is missing.

    The signature of a line is its squeezed text; a first line without indent that opens nothing
    halfway, and a last line that closes (a full stop, a bracket, END), prove themselves.
    """
    plain = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    written = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    ends = docs.select(F.col(key), F.get(written, 0).alias("head"), F.get(written, F.size(written) - 1).alias("tail"))
    marks = confirmed.select(F.col(key).alias("of"), plain("signature").alias("sig")).distinct()
    for name, column in (("first_seen", "head"), ("last_seen", "tail")):
        met = marks.select(F.col("of").alias(f"{name}_of"), F.col("sig").alias(f"{name}_sig"), F.lit(True).alias(name))
        ends = ends.join(met, (F.col(key) == F.col(f"{name}_of")) & (plain(F.col(column)) == F.col(f"{name}_sig")), "left").drop(f"{name}_of", f"{name}_sig")
    no = F.lit(False)
    first = F.coalesce("first_seen", no) | F.coalesce(F.col("head").rlike(r"^\S") & ~F.col("head").rlike(r"^[)\]},;.]"), no)
    last = F.coalesce("last_seen", no) | F.coalesce(F.col("tail").rlike(r"(?i)(?:[.)\]};]|(?:^|[ ;])end[;.a-z-]*)[ ;]*$"), no)
    return ends.select(key, first.alias("first_proved"), last.alias("last_proved"))


@F.pandas_udf(DoubleType())
def _agreement(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Share of the shorter text's written lines that stand in order in the longer one."""
    for left, right in frames:
        out = []
        for a, b in zip(left, right, strict=True):
            x, y = sorted(([v.strip() for v in t.split("\n") if v.strip()] for t in (a, b)), key=len)
            same = difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
            out.append(sum(m.size for m in same) / len(x) if x else 1.0)
        yield pd.Series(out, dtype="float64")


def paragraphs_deduplicated(lines: DataFrame, key: str = "doc_id", agreement: float = 0.8) -> DataFrame:
    """Lines (key, n, line) without repeated paragraphs.

    A paragraph is a header line (a name and a full stop alone) and what follows, found by carrying
    the header's line number down. Of the copies of a name the one with most written lines stays,
    the first of equals; the others go when each agrees with it, else all stay.
    """
    header = F.when(F.col("line").rlike(r"^ {0,10}[A-Za-z0-9][A-Za-z0-9-]*\s*[.]\s*$") & ~F.col("line").rlike(r"^\s*[0-9]+\s*[.]"), F.col("n"))
    placed = carried_down(lines, [key], ["n"], header, "start")
    body = F.array_sort(F.collect_list(F.struct("n", "line")))
    parts = placed.where("start IS NOT NULL").groupBy(key, "start").agg(body.alias("b"))
    name = F.upper(F.regexp_extract(F.get("b", 0)["line"], r"([A-Za-z0-9-]+)", 1))
    inner = F.transform(F.slice("b", F.lit(2), F.greatest(F.size("b") - 1, F.lit(0))), lambda x: x["line"])
    parts = parts.select(key, "start", name.alias("name"), F.array_join(inner, "\n").alias("text"), F.size(F.filter(inner, lambda x: F.trim(x) != "")).alias("written"))
    order = W.partitionBy(key, "name").orderBy(F.desc("written"), "start")
    copies = parts.withColumns({"rank": F.row_number().over(order), "best": F.first("text").over(order)}).where("rank > 1")
    judged = copies.withColumn("like", _agreement("text", "best"))
    alike = judged.groupBy(key, "name").agg(F.min("like").alias("least")).where(F.col("least") >= agreement)
    gone = judged.join(alike, [key, "name"]).select(key, "start")
    return placed.join(gone, [key, "start"], "left_anti").select(key, "n", "line")


def near_duplicates_dropped(items: DataFrame, block: str, item: str, score: str, text: str, floor: float = 0.8) -> DataFrame:
    """Per block the best-scored items, without later ones alike; different numbers make items different."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        kept: list[tuple[set[str], list[str]]] = []
        out = []
        for row in group.sort_values([score, item], ascending=[False, True], kind="stable").itertuples(index=False):
            body = getattr(row, text) or ""
            words, numbers = set(re.findall(r"[a-z0-9]+", body.lower())), re.findall(r"\d+", body)
            if all(n != numbers or len(w & words) < floor * max(1, len(w | words)) for w, n in kept):
                kept.append((words, numbers))
                out.append(row)
        return pd.DataFrame(out, columns=group.columns)

    rows = items.select(block, item, score, text)
    return rows.groupBy(block).applyInPandas(fold, rows.schema)


def fragments_of(docs: DataFrame, size: int = 45, step: int = 35, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(artifact_id, ord, text): documents cut in overlapping windows of lines, the inverse that stitching is tested on."""
    lines = F.split(F.col(text), "\n")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((F.size(lines) - size) / step)).cast("int"))
    return docs.select(F.col(key).alias("artifact_id"), lines.alias("l"), F.posexplode(starts).alias("ord", "w")).select("artifact_id", "ord", F.array_join(F.slice("l", F.col("w") * step + 1, F.lit(size)), "\n").alias("text"))
