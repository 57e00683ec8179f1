"""Exact groups against plain grouping, with collisions forced."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from barwright.llm import fingerprint as fp

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("keep_id", T.StringType())])
#: Sixteen possible values: many different texts of one length collide.
WEAK = ((3, 2), (3, 2), (3, 2), (3, 2))


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(d)
    out = []
    for text, ids in groups.items():
        known = [d for d in ids if d is not None]
        keep, sha = min(known, default=None), hashlib.sha256(text.encode()).hexdigest()
        kept = 0
        for d in ids:
            out.append((d, keep, len(ids), d == keep and not kept, sha))
            kept += d == keep
    return sorted(out, key=str)


def rows(seed):
    rng = random.Random(seed)
    out = [(i, "".join(rng.choice(["a", "b", " ", "\t", "é", "\n"]) for _ in range(rng.choice([0, 1, 3, 3, 4, 12]))), "x") for i in range(120)]
    return [*out, out[3], (None, "ab", "x"), (None, None, "x"), (None, None, "x"), (500, None, "x"), (501, "ab" * 40, "x"), (7000, "ab" * 40, "x")]


@pytest.mark.parametrize("size, polynomials", [(1 << 20, fp.POLYNOMIALS), (5, fp.POLYNOMIALS), (5, WEAK)])
def test_groups(spark, size, polynomials):
    data = rows(size)
    got = fp.exact_groups(spark.createDataFrame(data, SCHEMA), size, polynomials).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)


def test_chunks_combine_to_the_whole():
    tables = fp.polynomial_tables(fp.POLYNOMIALS)
    rng = random.Random(1)
    data = rng.randbytes(30_000)
    whole = fp.fingerprint(data, tables, fp.POLYNOMIALS)
    for cut in (0, 1, 4096, 12345, 30_000):
        a, b = (fp.fingerprint(x, tables, fp.POLYNOMIALS) for x in (data[:cut], data[cut:]))
        assert [(int(x) * pow(base, 30_000 - cut, p) + int(y)) % p for x, y, (base, p) in zip(a, b, fp.POLYNOMIALS, strict=True)] == whole.tolist()
    for (base, p), h in zip(fp.POLYNOMIALS, whole.tolist(), strict=True):
        value = 0
        for byte in data:
            value = (value * base + byte + 1) % p
        assert value == h


def test_stage_keeps_columns_and_one_row(spark):
    data = rows(9)
    docs = spark.createDataFrame(data, SCHEMA)
    left = fp.drop_exact_copies(docs)
    assert left.columns == docs.columns
    got = sorted((re.sub(r"[ \t-\r]+", " ", r.text or "") for r in left.collect()))
    assert got == sorted({re.sub(r"[ \t-\r]+", " ", t or "") for _, t, _ in data})
    assert fp.exact_groups(docs.limit(0)).count() == 0
