"""Quality rules: fixed base rules and a learned decision list, with DataFrame operations only.

Statistics come from the whole text in one expression, without a shuffle: word windows are hashed
and counted inside the row. The decision list is learned by sequential covering from the
statistics of labelled documents: a conjunction of thresholds is grown by information gain on two
thirds of them from each of the `SEEDS` best first conditions, pruned on the rest while its worth
(p - n) / (p + n) does not fall, and taken when it is right about at least `PRECISION` of the
held-back documents it covers, of which at least `LEAST_HELD` are bad; of several, the one that
catches most is taken. The documents it covers are then set aside. The list becomes an ordered conditional expression, so applying it is a
projection of the scan.

Learning uses at most `SAMPLE_ROWS` labelled documents, those with the smallest hashes of their
ids: their ids (16 bytes each) are broadcast, their statistics (a dozen numbers each) come to the
driver. Everything else covers all documents.

Edge cases: a null text has no words; a document without words is rejected by the base rules.
Without usable labels (no table rows, one class only) the list is empty and the base rules decide.
Labels that are null or disagree for one id are not used; of rows that share a labelled id one is
learned from. Rows may repeat; ids may be null; an empty table gives an empty result. A very long
text is counted whole, in its own row. Nothing is added to the table's own columns, so names cannot
clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import let
from weftline.llm.rows import column

WS, BLANKS, WINDOW = r"[\x20\x09-\x0D]+", " \t\n\x0b\f\r", 5
SAMPLE_ROWS, PRECISION, LEAST_COVERED, LEAST_HELD, MAX_RULES, MAX_CONDITIONS, SEEDS = 20_000, 0.95, 8, 3, 12, 4, 8
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20

#: name: (numerator, denominator) of the ratios that rules are learned on.
RATIOS = {
    "symbols_per_char": ("n_symbols", "word_chars"),
    "pipes_per_word": ("n_pipes", "n_words"),
    "shouts_per_word": ("n_shouts", "n_words"),
    "capitals_per_char": ("n_capitals", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "repeated_per_word": ("n_repeat_words", "n_words"),
    "distinct_per_word": ("n_distinct_words", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "chars_per_word": ("word_chars", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


def _repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, the first occurrence included."""

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of(o: Column) -> Column:
            repeated = F.filter(o, lambda x, k: (F.get(o, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(o, k + 1)["h"].eqNullSafe(x["h"])))
            starts = F.array_sort(F.transform(repeated, lambda x: x["i"]))
            begin = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(starts, begin, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")))["n"]

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, of))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))


def statistics(text: Column) -> Column:
    """A struct of counts of one whole text; null counts as empty."""

    def of(t: Column) -> Column:
        body = F.trim(t, F.lit(BLANKS))
        without = lambda column, char: F.length(column) - F.length(F.replace(column, F.lit(char), F.lit("")))
        lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(x, F.lit(BLANKS))) > 0)

        def counted(x: Column) -> Column:
            words, rows = x["words"], x["rows"]
            chars = F.length(F.array_join(words, "")).cast("long")
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                chars.alias("word_chars"),
                (F.length(t) - F.length(F.regexp_replace(t, "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
                (F.size(rows) - F.size(F.array_distinct(rows))).cast("long").alias("n_dup_lines"),
                _repeated_words(words).alias("n_repeat_words"),
                F.size(rows).cast("long").alias("n_lines"),
                F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
                without(t, "|").cast("long").alias("n_pipes"),
                without(t, "!").cast("long").alias("n_shouts"),
                F.length(F.regexp_replace(t, "[^A-Z]+", "")).cast("long").alias("n_capitals"),
                F.length(F.regexp_replace(t, "[^0-9]+", "")).cast("long").alias("n_digits"),
            )

        words = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS))
        return let(F.struct(words.alias("words"), lines.alias("rows")), counted)

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(stats: Column) -> Column:
    return (stats["n_words"] < MIN_WORDS) | (100 * stats["n_repeat_words"] > MAX_REPEATED_PERCENT * stats["n_words"])


def ratio(stats: Column, name: str) -> Column:
    up, down = RATIOS[name]
    return stats[up] / F.greatest(stats[down], F.lit(1))


@dataclass(frozen=True)
class Condition:
    """ratio >= bound, or ratio < bound."""

    name: str
    at_least: bool
    bound: float

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        return values[self.name] >= self.bound if self.at_least else values[self.name] < self.bound

    def column(self, stats: Column) -> Column:
        value = ratio(stats, self.name)
        return value >= self.bound if self.at_least else value < self.bound

    def __str__(self) -> str:
        return f"{self.name} {'>=' if self.at_least else '<'} {self.bound:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, values: dict[str, np.ndarray], n: int) -> np.ndarray:
    found = np.ones(n, bool)
    for condition in rule:
        found &= condition.holds(values)
    return found


def _conditions(values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> list[Condition]:
    """The threshold with the largest FOIL gain of each ratio and direction among the rows inside, best first."""
    p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
    if not p0 or not n0:
        return []
    base, found = math.log2(p0 / (p0 + n0)), []
    for name in RATIOS:
        inner, label = values[name][inside], bad[inside]
        order = np.argsort(inner, kind="stable")
        v, y = inner[order], label[order]
        edges = np.flatnonzero(v[1:] > v[:-1]) + 1
        if not len(edges):
            continue
        p_below = np.concatenate([[0], np.cumsum(y)])[edges]
        n_below = edges - p_below
        for at_least, p, n in ((True, p0 - p_below, n0 - n_below), (False, p_below, n_below)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - base), -1.0)
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                found.append((float(gain[k]), Condition(name, at_least, float((v[edges[k] - 1] + v[edges[k]]) / 2))))
    return [condition for _, condition in sorted(found, key=lambda x: -x[0])]


def _grown(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, inside: np.ndarray) -> Rule:
    """Conditions are added while they gain and good documents are left inside."""
    inside = inside & _covers(rule, values, len(bad))
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        conditions = _conditions(values, bad, inside)
        if not conditions:
            break
        rule += (conditions[0],)
        inside &= conditions[0].holds(values)
    return rule


def _hits(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, among: np.ndarray) -> tuple[int, int]:
    """Bad and good documents among those that the rule covers."""
    hit = among & _covers(rule, values, len(bad))
    return int(bad[hit].sum()), int((~bad[hit]).sum())


def _pruned(rule: Rule, values: dict[str, np.ndarray], bad: np.ndarray, check: np.ndarray) -> Rule:
    """The condition whose loss does the least harm goes while the worth does not fall."""

    def worth(r: Rule) -> float:
        p, n = _hits(r, values, bad, check)
        return (p - n) / (p + n) if p + n else -1.0

    while len(rule) > 1:
        shorter = max((rule[:k] + rule[k + 1 :] for k in range(len(rule))), key=worth)
        if worth(shorter) < worth(rule):
            break
        rule = shorter
    return rule


def learn(values: dict[str, np.ndarray], bad: np.ndarray, held_back: np.ndarray) -> list[Rule]:
    """Sequential covering of the bad documents. `held_back` marks the rows for pruning.

    A rule is grown and pruned from each of the best first conditions; of those that are right often
    enough on the rows held back, the one that catches most of them is taken.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < MAX_RULES and bad[left & ~held_back].sum() >= LEAST_COVERED:
        grow, check = left & ~held_back, left & held_back
        found: list[tuple[int, Rule]] = []
        for first in _conditions(values, bad, grow)[:SEEDS]:
            rule = _pruned(_grown((first,), values, bad, grow), values, bad, check)
            p, n = _hits(rule, values, bad, check)
            if p >= LEAST_HELD and p >= PRECISION * (p + n):
                found.append((p, rule))
        if not found:
            break
        rules.append(max(found, key=lambda x: x[0])[1])
        left &= ~_covers(rules[-1], values, len(bad))
    return rules


def report(rules: list[Rule], values: dict[str, np.ndarray], bad: np.ndarray) -> list[tuple[str, int, float]]:
    """Per rule, in order: its text, the documents it is the first to cover, and the share of bad ones among them."""
    found, left = [], np.ones(len(bad), bool)
    for rule in rules:
        p, n = _hits(rule, values, bad, left)
        found.append((" and ".join(map(str, rule)), p + n, p / max(1, p + n)))
        left &= ~_covers(rule, values, len(bad))
    return found


def labelled_statistics(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, quality and statistics of at most `rows` labelled documents (by the hash of the id)."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    chosen = usable.where("quality = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("int").alias("label"))
    pair = docs.select(column(id_col).alias("id"), column(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("labelled_id"))
    return pair.select("id", "label", statistics(F.col("text")).alias("s"))


def training_values(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Ratios, whether bad, and whether held back, of the labelled documents that the base rules keep.

    One row for each labelled id comes to the driver, so at most `rows`; what the base rules reject is left
    out there and not by a filter in the plan, which Spark would apply to all documents before the join.
    """
    sample = labelled_statistics(docs, labels, rows, id_col, text_col)
    sample = sample.select("id", "label", base_failed(F.col("s")).alias("base_failed"), F.xxhash64(F.lit(1), "id").alias("h"), *[ratio(F.col("s"), name).alias(name) for name in RATIOS])
    sample = sample.groupBy("id").agg(F.min(F.struct("label", "base_failed", "h", *RATIOS)).alias("r")).select("id", "r.*")
    got = sample.toPandas().sort_values(["h", "id"], kind="stable")
    got = got[~got["base_failed"].astype(bool)]
    return {name: got[name].to_numpy(np.float64) for name in RATIOS}, (got["label"] == 0).to_numpy(bool), (got["h"].to_numpy(np.int64) % 3 == 0)


def learn_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """The decision list for these documents and labels (columns doc_id, quality)."""
    values, bad, held_back = training_values(docs, labels, rows, id_col, text_col)
    return learn(values, bad, held_back) if len(bad) else []


def rejected_by(rules: list[Rule], stats: Column) -> Column:
    """Which rule of the list rejects first, from 1; 0 when none does."""
    chain = None
    for number, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for condition in rule:
            holds &= condition.column(stats)
        chain = F.when(holds, number) if chain is None else chain.when(holds, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed, rule (first of the list that rejects, 0: none) and kept."""
    scored = docs.select(column(id_col).alias("doc_id"), statistics(column(text_col)).alias("s"))
    judged = scored.select("doc_id", "s.*", base_failed(F.col("s")).alias("base_failed"), rejected_by(rules, F.col("s")).alias("rule"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns; one filter on the scan, no shuffle."""
    return docs.where(let(statistics(column(text_col)), lambda s: ~base_failed(s) & (rejected_by(rules, s) == 0)))
