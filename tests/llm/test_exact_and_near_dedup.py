import hashlib
import random
import re

import numpy as np
import pytest

from weftline.llm import exact_dedup, simhash

SCHEMA = "doc_id long, text string, digest string, fp string"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "other", "other") for i, t in texts], SCHEMA)


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


CASES = [(1, "a  b"), (2, "a b"), (3, "a\tb"), (4, " a b"), (5, None), (6, ""), (7, "\n"), (8, " "), (9, "a\xa0b"), (10, "x" * 300_000), (11, "x" * 300_000), (None, "a b"), (12, "a b c")]


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_exact_groups_match_brute_force(spark, counters):
    rnd = random.Random(3)
    texts = CASES + [(100 + i, rnd.choice(["hot text", "hot  text", f"t{rnd.randrange(40)}"])) for i in range(300)]
    groups = {}
    for i, t in texts:
        groups.setdefault(normal(t), []).append(i)
    got = exact_dedup.exact_duplicates(docs_of(spark, texts), counters=counters).collect()
    assert len(got) == len(texts)
    by_hash = {hashlib.sha256(k.encode()).digest(): v for k, v in groups.items()}
    for r in got:
        ids = by_hash[bytes(r.digest)]
        assert r.group_size == len(ids)
        assert r.keep_id == min(i for i in ids if i is not None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_misra_gries_finds_every_frequent_digest(spark):
    rows = [("hot", i) for i in range(400)] + [(f"x{i}", i) for i in range(600)]
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(rows)], "doc_id long, text string").repartition(7)
    table = exact_dedup.digests(df)
    assert [r.group_size for r in exact_dedup.heavy_hitters(table, 3).collect()] == [400]


def test_exact_repeated_rows_keep_one(spark):
    docs = docs_of(spark, [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (3, "b"), (None, "z")])
    assert [r.kept for r in exact_dedup.exact_duplicates(docs).orderBy("doc_id").collect()].count(True) == 4
    kept = sorted((r.doc_id or 0, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect())
    assert kept == [(0, "z"), (1, "a"), (2, "b"), (2, "c")]
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert exact_dedup.exact_duplicates(docs).count() == 0
    assert simhash.near_duplicates(docs).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == simhash.drop_near_duplicates(docs).count() == 0


def reference_fingerprint(text):
    import xxhash

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_the_definition():
    rnd = random.Random(1)
    for _ in range(200):
        text = "".join(rnd.choice(["Ab", "É", " ", "\n", "\x0b", "x", "\xa0", "ß", "İ", "9"]) for _ in range(rnd.randrange(60)))
        assert simhash.fingerprint(text.encode()) == reference_fingerprint(text)
    assert simhash.fingerprint(b"a b c d") == reference_fingerprint("a b c d")
    long = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(long.encode()) == reference_fingerprint(long)


@pytest.mark.parametrize("bits", [0, 1, 2, 4, 6])
@pytest.mark.parametrize("distinct", [10, 1 << 30])
def test_links_are_complete_and_single(spark, bits, distinct):
    rnd = np.random.default_rng(bits)
    base = rnd.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set(base.tolist()) | {0}
    for b in base.tolist():
        for _ in range(12):
            fps.add(b ^ sum(1 << int(k) for k in rnd.choice(64, rnd.integers(1, 7), replace=False)))
    parts = simhash.segments(distinct, bits)
    if sum(len(simhash.ball(size, radius)) for _, size, radius in parts) > 6000:
        pytest.skip("no one would choose these segments")
    values = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), bits, parts).collect()]
    want = {(a, b) for a in values for b in values if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= bits}
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 103), (103, 100)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_near_duplicates_match_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(25):
        body = [rnd.choice(words) for _ in range(120)]
        for _ in range(4):
            copy = list(body)
            if rnd.random() < 0.7:
                copy[rnd.randrange(120)] = "changed"
            texts.append((len(texts), " ".join(copy)))
    texts += [(500, None), (501, ""), (502, "one"), (None, "one"), (503, "ONE")]
    fps = [(i, simhash.fingerprint((t or "").encode())) for i, t in texts]
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                parent[root(a)] = root(b)
    smallest = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    want = sorted((i is None, i or 0, smallest[root(k)]) for k, (i, _) in enumerate(fps))
    docs = docs_of(spark, texts)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {c for *_, c in want}  # a row without id goes with its group
