"""Spelling variants by PartEnum signatures.

Words are the letter runs of all texts (``A-Z`` lower-cased), counted over the whole table.  Two words are near if one
inserted, deleted or replaced code point tells them apart.  Their letter multisets, as binary vectors with a dimension
for the first, second, ... occurrence of each letter, then differ in at most two dimensions.  The dimensions are dealt
by a hash into ``PARTS`` parts; two differing dimensions touch at most two parts, so the vectors agree on some choice
of ``PARTS - 2`` of them.  Every such choice is enumerated and its projection hashed: near words share a signature.

A letter multiset says nothing of the order of letters, so many words share a projection.  Each signature is therefore
refined by place: the shorter word is cut in thirds, and the differing place lies in one of them, so that the words
agree on the other two, aligned to the left and to the right end.  A word emits its keys for its own length (as the
shorter or equal word) and for one less (as the longer one).  Words are equi-joined on the keys, and the edit distance
decides.

The form of a word is its near word of largest count, if that is at least ``RATIO`` times its own; following forms to
the end gives the root.  Counts grow by that factor at each step, so chains are short and pointers are doubled.

Nulls: a null text has no words; a null doc_id counts as an empty id in the hash.  Very long texts are scanned, not
listed.  Repeated rows count again.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import batch, small_batches

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
#: One in so many (document, run) pairs loses a letter: the misspellings that the corpus itself does not have.
NOISE = 199
DISTANCE, PARTS = 2, 4
#: Distinct words held by a task before they are handed on.
HELD_WORDS = 200_000
LONG_TEXT = 4 << 20
ALL_BITS = (1 << 64) - 1


def lower(text: str) -> str:
    """``A-Z`` lower-cased, all else kept."""
    return text.encode().lower().decode()


def words_in(doc_id: int | None, text: str, least: int = LEAST_LETTERS, noise: int = NOISE) -> Iterator[tuple[str, int]]:
    """(word, occurrences) of one text; runs that are too short to give a word are not matched."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    text = lower(text)
    runs = Counter(pattern.findall(text) if len(text) < LONG_TEXT else (m.group() for m in pattern.finditer(text)))
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), seed)
        if noise and h % noise == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
            if len(run) < least:
                continue
        yield run, n


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n) of the words that occur often enough; tasks add up before the exchange."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                for word, n in words_in(doc_id, text, least_letters, noise):
                    held[word] += n
                if len(held) >= HELD_WORDS:
                    yield batch({"word": (list(held), pa.string()), "n": (list(held.values()), pa.int64())})
                    held.clear()
        yield batch({"word": (list(held), pa.string()), "n": (list(held.values()), pa.int64())})

    rows = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= least_count)


class Signer:
    """Keys of a word; letters' dimensions are hashed once."""

    def __init__(self, parts: int = PARTS, distance: int = DISTANCE):
        self.parts, self.known = parts, {}
        self.choices = list(combinations(range(parts), parts - distance))

    def dimension(self, letter: str, turn: int) -> tuple[int, int]:
        """Part and hash of a letter's occurrence number ``turn``."""
        at = (letter, turn)
        if at not in self.known:
            h = xxhash.xxh64_intdigest(f"{letter}{turn}".encode())
            self.known[at] = (h % self.parts, xxhash.xxh64_intdigest(f"{turn}{letter}".encode(), seed=1))
        return self.known[at]

    def projections(self, word: str) -> list[int]:
        """Per choice of parts a hash of the multiset's vector on them."""
        sums, turns = [0] * self.parts, Counter()
        for letter in word:
            turns[letter] += 1
            part, h = self.dimension(letter, turns[letter])
            sums[part] += h
        return [xxhash.xxh64_intdigest(b"".join((sums[p] & ALL_BITS).to_bytes(8, "little") for p in c), seed=i)
                for i, c in enumerate(self.choices)]

    def keys(self, word: str) -> list[int]:
        """All keys of a word, as signed 64-bit numbers."""
        n, found = len(word), []
        projections = self.projections(word)
        for shorter in (n, n - 1):
            cuts = [shorter * i // 3 for i in range(4)]
            for third in range(3):
                kept = f"{shorter},{third},{word[:cuts[third]]},{word[n - (shorter - cuts[third + 1]):]}".encode()
                found += [xxhash.xxh64_intdigest(kept, seed=p) for p in projections]
        return [k - (1 << 64) if k >> 63 else k for k in found]


def signatures(words: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """(key, word) for every key of every word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(parts, distance)
        for b in batches:
            words = b.column("word").to_pylist()
            keys = [signer.keys(w) for w in words]
            yield batch({"key": ([k for ks in keys for k in ks], pa.int64()),
                         "word": ([w for w, ks in zip(words, keys, strict=True) for _ in ks], pa.string())})

    return words.select("word").mapInArrow(run, "key long, word string")


def near_pairs(words: DataFrame, parts: int = PARTS, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b, of all words one edit apart: signatures equi-joined, then verified."""
    signed = signatures(words, parts, distance)
    left, right = signed.select("key", F.col("word").alias("a")), signed.select("key", F.col("word").alias("b"))
    met = left.join(right, "key").filter(F.col("a") < F.col("b"))
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def variants(docs: DataFrame, ratio: int = RATIO, **limits: int) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = cut_lineage(word_counts(docs, **limits))
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Ties of the count go to the smallest word: the order of a struct's minimum is that of its bytes.
    best = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("its_n")), "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("its_n")).alias("rank"), F.col("b").alias("form"))).alias("best"))
    wins = -F.col("best.rank") >= F.lit(ratio) * F.col("n")
    found = cut_lineage(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(wins, F.col("best.form")).alias("form"),
        F.when(wins, -F.col("best.rank")).alias("form_n")))
    return found.join(roots(found), "word", "left").withColumn("root", F.coalesce("root", "word"))


def roots(found: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form: each round a pointer jumps over its target's pointer."""
    ends = found.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = cut_lineage(ends.join(further, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ends.filter("moved").isEmpty():
            return ends.drop("moved")
        ends = ends.drop("moved")


#: The hash of a run, byte by byte over a table of remainders that the polynomial gives.
SQL = f"""
WITH RECURSIVE divided AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM bytes, divided),
results AS (
  SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM results WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
without AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS its FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(its) AS top FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n,
    (SELECT min(p.other) FROM pairs p WHERE p.word = w.word AND p.its = CASE WHEN top >= {RATIO} * w.n THEN top END) AS form
  FROM words w LEFT JOIN best USING (word)),
ends AS (
  SELECT word, word AS root, 0 AS step FROM forms
  UNION ALL SELECT e.word, f.form, step + 1 FROM ends e JOIN forms f ON e.root = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, e.root FROM forms f JOIN (SELECT word, arg_max(root, step) AS root FROM ends GROUP BY word) e USING (word)
"""
