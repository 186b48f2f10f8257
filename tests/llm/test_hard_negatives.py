"""Hard negatives against a plain search of all rows, with small lists, blocks, packs and rounds so that each has several."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q string, list string, windows string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y", "z", "w", 1) for i, v, k in rows], SCHEMA).repartition(3)


def brute(rows, step=100, positives=5, negatives=10, low=30, high=90):
    held = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, label in held:
        if i % step:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), j, k) for j, b, k in held if j != i))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            hard = [(n, j) for n, j, k in scored if k != label and low * -s <= 100 * -n <= high * -s][:negatives]
            out += [(i, p, r + 1, j, -s, -n) for r, (n, j) in enumerate(hard)]
    return sorted(out)


def mined(docs, step=100, **options):
    return sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.prepared(docs), anchor_step=step, **options).collect())


def vectors(n, dims, seed, labels=4, copies=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    rows = [(i, [float(F32(x + rng.gauss(0, 0.4))) for x in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    return rows + [(n + i, rows[0][1], i % labels) for i in range(copies)]


def F32(x):
    import numpy as np

    return np.float32(x)


@pytest.mark.parametrize("options", [{}, {"lists": 7, "fit_rows": 50, "block": 16}, {"lists": 1}])
def test_equals_a_plain_search(spark, options):
    rows = vectors(300, 5, 3, copies=90)
    assert mined(frame(spark, rows), 20, **options) == brute(rows, 20)


def test_lists_are_left_out_by_their_bounds(spark, monkeypatch):
    rows = vectors(600, 3, 4)
    index = hard_negatives.Index(hard_negatives.prepared(frame(spark, rows)), lists=24, block=32)
    anchors = index.rows.where("id % 50 = 0").select("row_no", "id", "label", "q", F.array(F.struct(F.lit(1).alias("w"), F.lit(-(1 << 62)).alias("low"), F.lit(1 << 62).alias("high"))).alias("windows"))
    found = hard_negatives.search(index, anchors, 5, True, first_visits=2, pack=3)
    chosen = hard_negatives._choice(index, 5, 24)
    kth = {r.row_no: r.kth for r in found.groupBy("row_no").agg(F.min("score").alias("kth")).collect()}
    asked = anchors.collect()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"row_no": r.row_no, "id": r.id, "label": r.label, "q": r.q, "windows": [{"w": 1, "low": kth[r.row_no], "high": 1 << 62}], "next": 0} for r in asked])
    visited = sum(len(x) for out in chosen([batch]) for x in out.column("lists").to_pylist())
    assert visited < 0.6 * len(asked) * int((index.blocks > 0).sum())
    assert found.count() == 5 * len(asked)


def test_rows_of_all_shapes(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(60, 4, 5, labels=2)
    odd = [(None, [1.0, 0.0, 0.0, 0.0], 1), (100, None, 1), (100, [1.0, None, 0.0, 0.0], 1), (200, [nan, 0.0, 0.0, 0.0], 0), (200, [inf, 0.0, 0.0, 0.0], 0), (300, [1.0, 0.0, 0.0, 0.0], None)]
    odd += [(400, [], 1), (500, [0.5], 1), (600, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], 0), (700, [1.0, 1.0, 1.0, 1.0], 9)]  # empty, short, long, alone
    odd += [(20, rows[3][1], 0), (21, rows[5][1], 1), (21, rows[5][1], 1), (22, [-x for x in rows[5][1]], 1)]  # ids and rows again
    got = mined(frame(spark, rows + odd), 20, lists=5, block=8)
    assert got == brute(rows + odd, 20)
    assert mined(frame(spark, rows + odd + [(800, [3e38, 0.0, 0.0, 0.0], 1)]), 20, lists=5) == got  # too long to have a score
    big = [(i, [x * 4000 for x in v], k) for i, v, k in rows]
    assert mined(frame(spark, big), 20, lists=5) == brute([(i, [float(F32(x)) for x in v], k) for i, v, k in big], 20)


def test_empty_tables_and_tables_without_anchors(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 0)])) == []
    assert mined(frame(spark, [(0, [1.0], 1)])) == []


def test_products_beyond_a_double_are_exact():
    import pyarrow as pa

    held = pa.table({"id": [1, 2], "label": [0, 0], "q": pa.array([[2**27 - 1, 3], [2**27 - 1, 2]], pa.list_(pa.int32()))})
    asking = pa.table({"row_no": [0], "id": [9], "label": [1], "q": pa.array([[2**27 - 1, 1]], pa.list_(pa.int32())), "windows": [[{"w": 1, "low": 0, "high": 2**62}]]})
    out = hard_negatives._scored(2, False, 1)(held, asking).to_pylist()
    assert out == [{"row_no": 0, "w": 1, "score": (2**27 - 1) ** 2 + 3, "id": 1}]
