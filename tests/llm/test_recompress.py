"""Repeated runs of words against brute force, and the consistency of interior symbols."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from barwright.llm import recompress as R

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("owner", T.StringType()),
                       T.StructField("spans", T.StringType())])


def brute(rows, length):
    seen, texts = {}, [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in texts:
        for i in range(len(w) - length + 1):
            s, k = tuple(w[i:i + length]), (d is None, d or 0)
            seen[s] = min(seen.get(s, k), k)
    out = []
    for d, w in texts:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] < (d is None, d or 0):
                gone[i:i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, length):
    docs = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    return sorted((tuple(r) for r in R.repeated_words(docs, length).collect()), key=str)


@pytest.mark.parametrize("seed, length, alphabet", [(1, 4, "ab"), (2, 6, "a"), (3, 9, "abcdefgé"), (4, 15, "abc"), (5, 50, "abcdefghijklmnop"), (6, 1, "abcdefghi")])
def test_brute_force(spark, seed, length, alphabet):
    rng = random.Random(seed)

    def words(n):
        return [rng.choice(alphabet) * rng.choice([1, 1, 2]) for _ in range(n)]

    shared = [words(rng.randint(length // 2 + 1, 3 * length)) for _ in range(5)]
    rows = []
    for i in range(60):
        parts = [w for _ in range(rng.randint(0, 5)) for w in (rng.choice(shared) if rng.random() < 0.6 else words(rng.randint(0, length)))]
        text = "".join(w + rng.choice([" ", "\n\t ", "\x0b"]) for w in parts)
        rows.append((rng.choice([i, i, i, i // 2, None]), rng.choice(["", " "]) + text if rng.random() < 0.95 else None))
    rows += rows[:3] + [(3, ""), (None, " \t"), (70, rows[5][1]), (71, rows[5][1])]
    expected = brute(rows, length)
    assert found(spark, rows, length) == expected
    assert any(r[2] for r in expected)


def test_hot_passage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"before {i} {passage} after {i}") for i in range(200)]
    assert found(spark, rows, 50) == brute(rows, 50)


def test_empty_table(spark):
    assert found(spark, [], 50) == []
    assert found(spark, [(1, None), (2, None)], 50) == brute([(1, None), (2, None)], 50)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcdefgh"])
def test_equal_windows_have_equal_anchors(alphabet):
    rng = random.Random(7)
    for _ in range(30):
        inner = [rng.choice(alphabet) for _ in range(20)]
        texts = [" ".join([rng.choice(alphabet) for _ in range(rng.randint(0, 9))] + inner + [rng.choice(alphabet) for _ in range(rng.randint(0, 9))])
                 for _ in range(4)]
        w = R.Words(pa.array(texts))
        starts, key, *_ = R.anchors(w.names, w.bounds, 20)
        prints = w.fingerprints(starts, starts + 20)
        words = " ".join(texts).split()
        by_content = {}
        for s, k, p in zip(starts.tolist(), key.tolist(), prints.tolist(), strict=True):
            by_content.setdefault(tuple(words[s:s + 20]), set()).add((k, p))
        assert all(len(v) == 1 for v in by_content.values())


def test_neighbours_share_anchors():
    rng = np.random.default_rng(5)
    w = R.Words(pa.array([" ".join(f"w{x}" for x in rng.integers(0, 500, 20_000))]))
    _, anchor, *_ = R.pieces(w, 50)
    assert len(anchor) < 20_000 / 5
