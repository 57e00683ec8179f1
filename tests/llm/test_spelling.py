"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from barwright.llm import spelling

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("word", T.StringType()),
                       T.StructField("n", T.StringType()), T.StructField("key", T.StringType())])


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def found(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)
    return sorted(tuple(r) for r in spelling.variants(docs).select("word", "n", "n_near", "form", "form_n", "root").collect())


@pytest.mark.parametrize("seed", range(3))
def test_variants(spark, seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdeéÀß÷") for _ in range(rng.randint(5, 11))) for _ in range(12)]
    vocabulary = []
    for b in bases:
        vocabulary.append((b, rng.choice([3, 300, 900])))
        for _ in range(8):
            w, i = list(rng.choice([b, vocabulary[-1][0]])), rng.randrange(5)
            kind = rng.randrange(3)
            w[i:i + (kind > 0)] = [] if kind == 2 else [rng.choice("abcdeéÀ")]
            vocabulary.append(("".join(w), rng.choice([1, 5, 6, 30, 150])))
    bag = [w.upper() if rng.random() < 0.1 and w.isascii() else w for w, n in vocabulary for _ in range(n)]
    rng.shuffle(bag)
    rows = [(rng.choice([i, i, i // 2, None]), " ".join(bag[k:k + 40]) + ".") for i, k in enumerate(range(0, len(bag), 40))]
    rows += [(None, None), (7, ""), (8, "short wor ds 12345678")] + rows[:2]
    expected = brute(rows)
    assert found(spark, rows) == expected
    assert any(r[3] for r in expected) and any(r[5] not in (r[0], r[3]) for r in expected)


def test_long_text_is_scanned(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LONG_TEXT", 10)
    text = "Colour colors colour-colour COLOUR colours colour " * 40
    assert dict(spelling.words_in(1, text, noise=0)) == {"colour": 200, "colors": 40, "colours": 40}


def test_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None)]) == []


@pytest.mark.parametrize("a, b", [("banana", "banan"), ("banana", "bananas"), ("banana", "canana"), ("straße", "strasße"), ("aaaaaa", "aaaaaaa"), ("abcdef", "abcxef")])
def test_near_words_share_a_key(a, b):
    signer = spelling.Signer()
    assert set(signer.keys(a)) & set(signer.keys(b))
    assert len(signer.keys(a)) == 36
