"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text, all n-grams of words: single words and pairs of words, and runs of one to
three word forms. The form of a word is its outline: capitals, small letters and digits each as
one sign, a run of equal signs as one, other characters as they are; a word equal to the one
before it has the form ``=``. An n-gram is hashed to one of 2^BITS places; its weight in the text is the square
root of its share of the text's words, so a document counts by what it is made of and not by its
length. The score is the logistic function of a sparse dot product and a bias.

Training: FTRL-proximal with per-coordinate rates (McMahan et al., 2013) over `EPOCHS` passes, in
hash order of the ids, on at most `SAMPLE_ROWS` labelled documents, those with the smallest id
hashes among the rows whose crc32 of the id as text, modulo 3, is not 1 (of rows that share a
labelled id, the least text). Their features are a staged table that the driver reads partition by
partition. The weights (a float per place, 1 MB) are broadcast. Scoring reads each text once,
without a shuffle.

Edge cases: a null or empty text has no features and gets the bias' score. Null or contradictory
labels are not used; without labels of both classes all scores are the share of good labels, or
one half. Rows may repeat; null ids are scored (they are not held out). An empty table gives an
empty result. Only id and text are read, so other columns cannot clash; labels, language, source and
id are never features. A very long text is read whole by its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.rows import column
from weftline.staging import discard, stage

BITS, SAMPLE_ROWS, EPOCHS = 18, 12_000, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.05
#: Words whose hash and form are kept per task.
WORDS_KEPT = 300_000
FORM_SIGNS = 64


def outline(word: str) -> str:
    """The form of a word: letters as A (capital) or a, digits as 0, runs as one."""
    out, last = [], ""
    for ch in word:
        sign = "0" if ch.isdigit() else ("A" if ch.isupper() else "a") if ch.isalpha() else ch
        if sign != last:
            out.append(sign)
            last = sign
    return "".join(out)


class Featuriser:
    """Hashed n-grams of texts; words seen before are looked up."""

    def __init__(self, bits: int = BITS) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.words: dict[str, tuple[int, int]] = {}
        #: Of words whose outline is longer than one form, the forms after the first.
        self.more: dict[str, list[int]] = {}

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        table = self.words
        if len(table) > WORDS_KEPT:
            table = self.words = {}
            self.more = {}
        for word in set(words).difference(table):
            signs = outline(word)
            table[word] = (xxhash.xxh32_intdigest(word.lower()), xxhash.xxh32_intdigest(signs[:FORM_SIGNS], 7))
            if len(signs) > FORM_SIGNS:
                self.more[word] = [xxhash.xxh32_intdigest(signs[at : at + FORM_SIGNS], 7) for at in range(FORM_SIGNS, len(signs), FORM_SIGNS)]
        pairs = np.array([table[w] for w in words], np.uint64)
        return pairs[:, 0], pairs[:, 1]

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places (sorted) and weights."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        ids, forms = self._known(words)
        same = np.concatenate([[False], ids[1:] == ids[:-1]])
        forms = np.where(same, np.uint64(61), forms)
        if self.more and not self.more.keys().isdisjoint(words):
            more = [(i + 1, form) for i, word in enumerate(words) if not same[i] for form in self.more.get(word, ())]
            forms = np.insert(forms, [i for i, _ in more], np.array([form for _, form in more], np.uint64))
        grams = [ids, self._joined(ids, 2), forms + np.uint64(1 << 40), self._joined(forms, 2), self._joined(forms, 3)]
        mixed = np.concatenate(grams)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        places, counts = np.unique((mixed >> np.uint64(20)) & self.mask, return_counts=True)
        return places.astype(np.int64), np.sqrt(counts / len(forms)).astype(np.float32)

    @staticmethod
    def _joined(values: np.ndarray, n: int) -> np.ndarray:
        if len(values) < n:
            return np.zeros(0, np.uint64)
        out = np.full(len(values) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + values[i : len(values) - n + 1 + i]
        return out


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", target: str = "quality") -> DataFrame:
    """h, label, text of at most `rows` labelled documents outside the held-out third."""
    usable = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(target).alias("label"), F.max(target).alias("most"))
    chosen = usable.where("label = most").select(F.col("doc_id").alias("labelled_id"), F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    chosen = chosen.orderBy("h", "labelled_id").limit(rows)
    read = docs.select(column(id_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    return read.join(F.broadcast(chosen), F.col("id") == F.col("labelled_id")).groupBy("h", "labelled_id", "label").agg(F.min("text").alias("text")).select("h", "label", "text")


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of = Featuriser()
    for batch in batches:
        found = [of(x) for x in batch.column(2).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([w.astype("<f4").tobytes() for _, w in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["h", "label", "places", "weights"])


class Ftrl:
    """FTRL-proximal with one learning rate per place; the bias is a place of its own, without L1, behind the prior's log odds."""

    def __init__(self, prior: float, bits: int = BITS) -> None:
        self.z, self.n, self.l1 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, L1)
        self.l1[-1], self.offset = 0.0, float(np.log(prior / (1 - prior)))

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, l1 = self.z[at], self.n[at], self.l1[at]
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def update(self, places: np.ndarray, values: np.ndarray, label: int) -> float:
        """One example; returns the probability before the update."""
        at, x = np.append(places, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(self.offset + float(w @ x), -30, 30)))
        g = (p - label) * x
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] += g * g
        return float(p)

    def model(self) -> tuple[np.ndarray, float]:
        w = self.weights(slice(None))
        return w[:-1].astype(np.float32), self.offset + float(w[-1])


def ftrl(examples: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], good: int, total: int, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal updates over (places, values, label); `examples` gives them anew, in order, for each epoch."""
    learner = Ftrl((good + 1) / (total + 2), bits)
    for _ in range(epochs if 0 < good < total else 0):
        for places, values, label in examples():
            learner.update(places, values, label)
    return learner.model()


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias. Reruns agree: the order of training is that of the id hashes.

    The features are written and read again in order for each epoch, a partition at a time, so the
    driver holds one partition of them, however long the labelled texts are.
    """
    sample = stage(training_rows(docs, labels, rows, id_col, text_col).mapInArrow(_featurise, "h long, label int, places binary, weights binary"), "features")
    good, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()

    def examples() -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        for row in sample.orderBy("h", "places").toLocalIterator():
            yield np.frombuffer(row["places"], "<i4").astype(np.int64), np.frombuffer(row["weights"], "<f4").astype(np.float64), row["label"]

    found = ftrl(examples, good, total)
    discard(sample)
    return found


def _score_batches(shared, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, weights = Featuriser(), shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                logits = np.empty(part.num_rows)
                for i, text in enumerate(part.column(1).to_pylist()):
                    places, values = of(text or "")
                    logits[i] = bias + float(weights[places] @ values)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: label 1 likelier) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).mapInArrow(_score_batches(shared, bias), "doc_id long, score double")
