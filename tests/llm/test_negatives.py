"""Hard negatives against all pairs, and the bounds of segments."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from barwright.llm import negatives as N

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType()), T.StructField("slice", T.StringType())])


def brute(rows):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v])
        known[i] = max(known.get(i, r), r)
    out = []
    for a, (label, v) in known.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in known.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if known[i][0] == label][:5]:
            fits = [i for i in order if known[i][0] != label and 50 * score[p] <= 100 * score[i] <= 95 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(fits[:3], 1)]
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tuple(r) for r in N.hard_negatives(table).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def single(x):
    return float(np.float32(x))


@pytest.mark.parametrize("seed, size, groups", [(1, 700, 3), (2, 400, 1), (3, 300, 40)])
def test_all_pairs(spark, monkeypatch, seed, size, groups):
    monkeypatch.setattr(N, "SLICE_ROWS", 150)
    monkeypatch.setattr(N, "ANCHOR_ROWS", 4)
    monkeypatch.setattr(N, "TILE", (3, 40))
    rng = random.Random(seed)
    centres = [[rng.gauss(0.2, 1) for _ in range(20)] for _ in range(groups)]
    rows = []
    for i in range(size):
        c = rng.choice(centres)
        v = [single(x + rng.choice([0, 0, 0.25, rng.gauss(0, 0.3)])) for x in c][:rng.choice([20, 20, 17])]
        rows.append((i, v, rng.choice([0, 0, 0, 1, 2, 9])))
    rows += [rows[50], rows[100], (50, rows[51][1], 1), (None, rows[0][1], 1), (9000, None, 1), (9050, rows[3][1], None),
             (9100, [1.0, None], 2), (9150, [float("nan")], 2), (9200, [float("inf"), 1.0], 0), (9250, [], 0)]
    expected = brute(rows)
    assert expected and found(spark, rows) == expected


def test_large_components(spark):
    rows = [(i, [single(2.0 ** 17 + i * 3), single(-1.5 * i)], i % 2) for i in range(60)]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0], 0)]) == []
    rows = [(0, [1.0], 0), (1, [1.0], 1), (2, [0.7], 2), (3, [0.7], 2)]
    assert found(spark, rows) == brute(rows)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = N.Side(rng.integers(-90, 90, (60, 64)).astype(float)), N.Side(rng.integers(-90, 90, (80, 64)).astype(float))
    score = a.vectors @ b.vectors.T
    for low, high in ((-1e9, 1e9), (2e4, 1e9), (-5e3, 5e3), (1e5, 2e5)):
        open_ = N.open_pairs(a, b, np.ones(score.shape, bool), np.full(60, low), np.full(60, high))
        assert not ((score >= low) & (score <= high) & ~open_).any()
    flat = N.Side(np.full((5, 64), 3.0)), N.Side(np.full((5, 64), 4.0))
    assert not N.open_pairs(*flat, np.ones((5, 5), bool), np.full(5, 769.0), np.full(5, 1e9)).any()
    assert N.open_pairs(*flat, np.ones((5, 5), bool), np.full(5, 768.0), np.full(5, 1e9)).all()
