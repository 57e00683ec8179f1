"""Near-duplicate classes against all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import types as T

from barwright.llm import neardup as nd
from barwright.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("class_id", T.StringType())])


def definition(a, b):
    x, y = (dict(zip(k.tolist(), v.tolist(), strict=True)) for k, v in (a, b))
    union = x.keys() | y.keys()
    return sum(1 / sum(max(x.get(u, 0) / x[d], y.get(u, 0) / y[d]) for u in union) for d in x.keys() & y.keys())


def random_sets(rng, n):
    elements = np.array(sorted(rng.sample(range(1 << 40), 2 * n + 2)), np.uint64)
    a = sorted(rng.sample(range(2 * n + 2), n + 1))
    b = sorted({*a[:max(1, int(0.8 * n))], *rng.sample(range(2 * n + 2), max(1, n // 8))})
    return tuple((elements[i], np.array([rng.choice([1, 1, 1, 3]) for _ in i])) for i in (a, b))


def test_similarity_and_estimate():
    rng = random.Random(1)
    for n in (1, 2, 3, 10, 60, 400):
        a, b = random_sets(rng, n)
        exact = definition(a, b)
        assert abs(nd.similarity(a, b) - exact) < 1e-9
        s = nd.signatures([a, b], 4096)
        assert abs((s[0] == s[1]).mean() - exact) < 0.05


def test_signature_does_not_depend_on_the_batch():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 4, 5, 9, 300]))) for _ in range(20)] + ["x " * 20_000]
    parts = [nd.shingles(nd.words_of(t)) for t in texts]
    together = nd.signatures(parts, 60)
    for p, row in zip(parts, together, strict=True):
        assert nd.signatures([p], 60)[0].tolist() == row.tolist()


def brute_classes(rows):
    parts = {d: nd.shingles(nd.words_of(t or "")) for d, t in rows if d is not None}
    name = {d: d for d in parts}

    def top(d):
        while name[d] != d:
            d = name[d]
        return d

    for a, b in itertools.combinations(sorted(parts), 2):
        if len(parts[a][0]) and len(parts[b][0]) and definition(parts[a], parts[b]) >= 0.8:
            x, y = top(a), top(b)
            name[max(x, y)] = min(x, y)
    return {d: top(d) for d in parts}


def test_classes(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for family in range(6):
        base = [rng.choice(words) for _ in range(rng.choice([60, 150, 300]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(200, "a b"), (201, "A, b!"), (202, "a c"), (203, ""), (204, None), (205, "..."), (206, "q r s t u v " * 500)]
    want = brute_classes(rows)
    docs = spark.createDataFrame([(d, t, "c") for d, t in rows] + [(None, "a b", "c"), (None, "lone row", "c"), (200, "a b", "c")], SCHEMA)
    got = nd.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert {r.class_id for r in got if r.doc_id is None} == {200, None}
    left = nd.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, c in want.items() if d == c} | {None}
    assert nd.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (60, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 50: 50, 60: 50}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
