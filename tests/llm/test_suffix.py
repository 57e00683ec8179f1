"""Suffix sorting and repeated strings against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from barwright.llm import suffix

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("block", T.StringType())])


def brute(rows, length):
    """doc_id -> sorted results, straight from the definition."""
    seen = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            k = (d is None, d or 0)
            seen[s] = min(seen.get(s, k), k)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] < (d is None, d or 0):
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", ["a", "ab", "abc", "\x00ab", "abcdefghijklmnop"])
def test_order_by_prefix(alphabet):
    rng = random.Random(len(alphabet))
    for _ in range(60):
        n, length = rng.randint(1, 120), rng.choice([1, 3, 8, 11])
        raw = "".join(rng.choice(alphabet) for _ in range(n)).encode()
        data = np.frombuffer(raw + b"\0" * (length + 8), np.uint8)
        order = suffix.suffix_order(data, n, length).tolist()
        assert sorted(order) == list(range(n))
        full = [bytes(data[i:i + length]) for i in order if i + length <= n]
        assert full == sorted(full)
        wanted = np.array([rng.random() < 0.4 for _ in range(n)])
        some = suffix.suffix_order(data, n, length, wanted).tolist()
        assert {i for i in range(n) if wanted[i]} <= set(some) and len(set(some)) == len(some)
        full = [bytes(data[i:i + length]) for i in some if i + length <= n]
        assert full == sorted(full)


def make(rng, n):
    shared = ["".join(rng.choice("abé \x00") for _ in range(rng.randint(5, 40))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 30)))
                 for _ in range(rng.randint(0, 6))]
        rows.append((rng.choice([i, i, i, i // 2, None]), "".join(parts) if rng.random() < 0.95 else None, "x"))
    return [*rows, rows[0], (n + 1, "a" * 300, "y"), (n + 2, "a" * 200, "y")]


@pytest.mark.parametrize("seed, block, hot", [(1, 8 << 20, 64), (2, 300, 64), (3, 300, 2)])
def test_random_documents(spark, seed, block, hot):
    rows = make(random.Random(seed), 60)
    got = suffix.repeated_strings(spark.createDataFrame(rows, SCHEMA), length=12, block_bytes=block, bucket_bytes=block, hot_blocks=hot)
    assert sorted(map(tuple, got.collect()), key=str) == brute([r[:2] for r in rows], 12)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = suffix.repeated_strings(docs, block_bytes=60_000, bucket_bytes=40_000, hot_blocks=3)
    assert sorted(map(tuple, got.collect()), key=str) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


def test_no_rows(spark):
    assert suffix.repeated_strings(spark.createDataFrame([], SCHEMA)).count() == 0
