"""Stages that return rows, on tables whose other columns carry the names the operators use themselves."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import exact_dedup, mixing, quality_rules, sharding, simhash

NAMES = ["row", "h", "d", "key", "group", "bucket", "digest", "hot", "nth", "keep_id", "keep_row", "gone_id", "again_id", "mixed_id", "copies", "copy", "shard", "_shard", "cell", "crc", "size", "fp", "text_hash", "kept", "keeper", "component_id", "first", "n", "s", "label", "gone", "held", "mixed", "a.b", "back`tick", "e", "u", "v", "m"]
SCHEMA = "doc_id long, text string, source string, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
GOOD = "the quick brown fox number {} jumps over the lazy dog and runs far away into the wood {}"
ROWS = [(i, GOOD.format(i, i * 7), "ab"[i % 2]) for i in range(30)]
ROWS += [(100 + i, GOOD.format(3, 21), "a") for i in range(8)] + [(None, GOOD.format(50 + i, i), None) for i in range(6)] + [(None, GOOD.format(3, 21), "a"), (5, "one id for two texts " + GOOD.format(1, 2), "b")]
ROWS += [(200, None, "a"), (201, "", None), (202, " \n\t", "b"), (203, "word " * 30_000, "b"), (7, GOOD.format(7, 49), "b"), (7, GOOD.format(7, 49), "b")]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, *[f"{n}|{i}|{k}" for n in NAMES]) for k, (i, t, s) in enumerate(rows)], SCHEMA).repartition(3)


def quality(docs):
    return quality_rules.keep_good(docs, [(quality_rules.Condition("pipes_per_word", True, 0.5),)])


STAGES = [quality, exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.mix_documents, sharding.shard_documents]


def plain(row):
    """The row's own columns; the values carry its number, so rows that are alike can be told apart."""
    values = tuple(row)[: 3 + len(NAMES)]
    number = values[3].rsplit("|", 1)[1]
    i, t, s = ROWS[int(number)]
    assert values == (i, t, s, *[f"{n}|{i}|{number}" for n in NAMES])
    return int(number)


@pytest.mark.parametrize("stage", STAGES)
def test_rows_come_back_as_they_were(spark, stage):
    docs = frame(spark, ROWS)
    out = stage(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = collections.Counter(plain(r) for r in out.collect())
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in ROWS]
    if stage is exact_dedup.drop_exact_duplicates:
        assert max(got.values()) == 1 and sorted(texts[k] for k in got) == sorted(set(texts))
        assert all(ROWS[k][0] == min((ROWS[j][0] for j in range(len(ROWS)) if texts[j] == texts[k] and ROWS[j][0] is not None), default=None) for k in got)
    elif stage is simhash.drop_near_duplicates:
        prints = [simhash.fingerprint((t or "").encode()) for _, t, _ in ROWS]
        parent = list(range(len(ROWS)))
        for _ in range(len(ROWS)):
            for a in range(len(ROWS)):
                for b in range(len(ROWS)):
                    if bin(prints[a] ^ prints[b]).count("1") <= 4:
                        parent[a] = parent[b] = min(parent[a], parent[b])
        for root in set(parent):
            members = [k for k in range(len(ROWS)) if parent[k] == root]
            stay = {(ROWS[k][0], ROWS[k][1]) for k in got if k in members}
            smallest = min((ROWS[k][0] for k in members if ROWS[k][0] is not None), default=None)
            assert len(stay) == 1 and next(iter(stay))[0] == smallest
    elif stage is quality:
        assert set(got) == {k for k, t in enumerate(texts) if len(t.split()) >= 10 and k != next(j for j, r in enumerate(ROWS) if r[0] == 203)}
    elif stage is sharding.shard_documents:
        assert sorted(got.elements()) == list(range(len(ROWS))) and out.columns[-1] == "__shard"
    else:
        assert max(got.values()) <= 3


@pytest.mark.parametrize("stage", STAGES)
def test_empty_tables_and_rows_without_any_id(spark, stage):
    assert stage(frame(spark, [])).count() == 0
    none = frame(spark, [(None, t, s) for _, t, s in ROWS]).withColumn("doc_id", F.lit(None).cast("long"))
    out = stage(none)
    assert out.columns[:3] == none.columns[:3] and out.count() > 0


def test_mixing_decides_rows_without_id_one_by_one(spark):
    rows = [(None, f"w{i} " * 10, "a") for i in range(40)] + [(i, "x " * 10, "b") for i in range(5)]
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.count("*").alias("n")).collect()
    words = {r.source: 10 * r.n for r in out}
    targets = {"a": 450 * 5 / 7, "b": 450 * 2 / 7}
    assert all(abs(words[s] - targets[s]) <= 10 for s in targets)
