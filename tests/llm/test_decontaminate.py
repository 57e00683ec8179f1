"""Multi-pattern search against plain search."""

import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from barwright.llm import decontaminate as dc

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("items", T.StringType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("doc_id", T.LongType())])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, size):
    windows = []
    for i, t in items:
        w = WORD.findall(lower(t))
        windows += [("" if i is None else str(i), w[k:k + size]) for k in range(max(1, len(w) - size + 1)) if w]
    out = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        hit, names = set(), set()
        for n, p in windows:
            for k in range(len(w) - len(p) + 1):
                if w[k:k + len(p)] == p:
                    hit |= set(range(k, k + len(p)))
                    names.add(n)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_all_occurrences_found():
    rng = random.Random(1)
    words = ["a", "bb", "the", "ccc", "é", "x1", "longword"]
    for _ in range(200):
        patterns = list({p for _ in range(rng.randint(1, 6)) for p in dc.windows_of([rng.choice(words).encode() for _ in range(rng.randint(1, 6))], rng.randint(1, 4))})
        data = b" " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 200))).encode() + b" "
        at, which = dc.occurrences(dc.build(patterns), patterns, data)
        assert sorted(zip(at.tolist(), which.tolist(), strict=True)) == [
            (i, k) for i in range(len(data)) for k, p in sorted(enumerate(patterns)) if data.startswith(p, i)]


@pytest.mark.parametrize("per_block", [1000, 3])
def test_documents(spark, per_block):
    rng = random.Random(per_block)
    words = ["alpha", "B", "c-d", "É", "42", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(1, 7)), i) for i in range(6)] + [(7, None, 1), (8, "--", 1), (None, "alpha alpha alpha x", 1), (0, "x 42 x 42 x", 0)]
    docs = [(i, text(rng.randint(0, 60)), "i") for i in range(30)] + [(None, None, None), (3, "alpha", ""), (3, "alpha", ""), (40, text(4000), "")]
    found = dc.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=4, per_block=per_block)
    assert sorted(map(tuple, dc.report(found).collect()), key=str) == brute([d[:2] for d in docs], [i[:2] for i in items], 4)
    clean = dc.drop_contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), window=4, per_block=per_block)
    dirty = {(r[0], r[1]) for r in brute([d[:2] for d in docs], [i[:2] for i in items], 4) if r[5]}
    assert clean.columns == ["doc_id", "text", "items"]
    assert sorted(map(tuple, clean.collect()), key=str) == sorted((d for d in docs if (d[0], len(WORD.findall(lower(d[1])))) not in dirty), key=str)


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], ITEMS)
    docs = spark.createDataFrame([(1, "a b", "")], DOCS)
    assert [tuple(r)[:4] for r in dc.report(dc.contamination(docs, none)).collect()] == [(1, 2, 0, 0)]
    assert dc.report(dc.contamination(docs.limit(0), none)).count() == 0
