"""The stages against plain Python on a small corpus with planted copies."""

import collections
import hashlib

import corpus_pipeline
import duckdb
import pytest

from weftline.llm import simhash
from weftline.llm.queries import read_bytes, registry, tokenizer_file
from weftline.staging import stage

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, ROOT), name)
        out.append((name, docs.collect()))
        assert name == "sentencepiece" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return dict(out)


def normal(text):
    import re

    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_quality_keeps_good_documents(spark, stages):
    kept = {r.doc_id for r in stages["quality_rules"]}
    labels = spark.read.parquet(f"{ROOT}/labels.parquet").collect()
    bad = [r.doc_id for r in labels if r.quality == 0]
    assert sum(i in kept for i in bad) <= 0.3 * len(bad)
    clean = [r.doc_id for r in labels if r.quality == 1 and len(next(d.text for d in stages["documents"] if d.doc_id == r.doc_id).split()) >= 10]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_exact_stage(stages):
    first = {}
    for r in sorted(stages["quality_rules"], key=lambda r: r.doc_id):
        first.setdefault(normal(r.text), r.doc_id)
    assert sorted(r.doc_id for r in stages["exact_dedup"]) == sorted(first.values())


def test_near_stage(stages):
    rows = sorted((r.doc_id, simhash.fingerprint(r.text.encode())) for r in stages["exact_dedup"])
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in rows:
        for b, y in rows:
            if a < b and bin(x ^ y).count("1") <= 4:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    assert sorted(r.doc_id for r in stages["simhash_dedup"]) == sorted({root(i) for i in parent})


def test_mixing_stage_repeats_whole_documents(stages):
    source = {r.doc_id: r for r in stages["simhash_dedup"]}
    counts = collections.Counter(r.doc_id for r in stages["mixing"])
    assert set(counts) <= set(source) and max(counts.values()) <= 3
    assert all(r.text == source[r.doc_id].text for r in stages["mixing"])


def test_last_stage_encodes_every_row(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=read_bytes(tokenizer_file("piece_bpe_32k.model")))
    text = {r.doc_id: r.text for r in stages["mixing"]}
    assert len(stages["sentencepiece"]) == len(stages["mixing"])
    for r in stages["sentencepiece"]:
        ids = sp.encode(text[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, ROOT).collect()) == sorted(tuple(r) for r in stages["sentencepiece"])


def test_op1_against_its_twin(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{ROOT}/documents.parquet')")
    twin = duck.sql(registry.twins["op1_exact_dedup"])
    got = registry.queries["op1_exact_dedup"](spark, ROOT).select(*twin.columns).collect()
    assert sorted(map(tuple, got)) == sorted(twin.fetchall())
