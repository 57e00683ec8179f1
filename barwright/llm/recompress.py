"""Repeated runs of words by recompression.

A word goes when a window of ``LENGTH`` words that covers it also starts in a document with a smaller doc_id.  Texts are
compressed in rounds: first every maximal run of one symbol becomes a symbol, then the symbols are parted into left and
right ones and every left one followed by a right one becomes a symbol with it.  A name is a hash of what it stands for
and the side a bit of the name, so that all tasks name alike without a dictionary and a round needs no exchange.  Only
the symbols at both ends of a window depend on what stands around it (the outer runs; an outer right symbol at the
beginning, an outer left one at the end): the others are the same wherever the window occurs.

1. Every window is followed through ``ROUNDS`` rounds or until one would leave it no such interior symbol; the smallest
   name of the last round, with the fingerprint of the words on its longer side (half of those that the window has
   besides), is its anchor.  Equal windows have equal anchors, and neighbours mostly share one.  Windows in a row with
   one anchor are a piece, marked by a fingerprint of its words.
2. Spark counts pieces and anchors.  Where a document has a piece that a smaller doc_id has too, all its windows go.
3. Of the different pieces of one anchor, each in its smallest document only, the windows are compared one by one by
   their fingerprints, as minima per fingerprint that tasks add up before the exchange.
4. Texts come together with what was found, by document, and are cut.

A match needs the anchor's 64-bit name and an independent 64-bit fingerprint of the window's words, 128 bits in all.
No anchor, piece or window is gathered in one place: all steps are aggregated minima and joins that adaptive execution
may split, and lists are formed per document only.

Nulls: a null text has no words; a null doc_id is larger than any other.  Rows with the same doc_id do not remove each
other's words.  A text is held by a task with about thirty times its size.  An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_dir
from .common import gathered, mix64, small_batches, utf8_views

LENGTH = 50
#: Rounds after which all windows take an anchor: symbols then stand for two or three words, and a window has ten.
ROUNDS = 3
BATCH_BYTES = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers of the two word hashes, and of the fingerprint of several words with its inverse.
FIRST, SECOND = np.uint64(0x100000001B3), np.uint64(0xD6E8FEB86659FD93)
BASE = 0xA24BAED4963EE407
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NO_ID = np.iinfo(np.int64).max


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Words:
    """Two independent hashes of every word of a batch of texts."""

    def __init__(self, column: pa.Array):
        bounds, data = utf8_views(column)
        data, bounds = data[bounds[0]:bounds[-1]], bounds - bounds[0]
        space = SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        inner = bounds[:-1][np.diff(bounds) > 0]
        begins[inner] |= ~space[inner]
        starts = np.flatnonzero(begins)
        self.bounds = np.searchsorted(starts, bounds)  # of each text's words
        letters = np.flatnonzero(~space)
        number = np.cumsum(begins)[letters] - 1
        place = letters - starts[number]
        top = int(place.max()) + 1 if len(place) else 1
        code = data[letters].astype(np.uint64) + np.uint64(1)
        cut = np.searchsorted(letters, starts)
        self.names, self.prints = (
            mix64(np.add.reduceat(code * powers(int(b), top)[place], cut)) if len(starts) else np.zeros(0, np.uint64) for b in (FIRST, SECOND))

    def fingerprints(self, first: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Of the words from ``first`` to before ``after``."""
        n = len(self.prints) + 1
        total = np.concatenate([[np.uint64(0)], np.cumsum(self.prints * powers(BASE, n)[:-1])])
        return mix64((total[after] - total[first]) * powers(INVERSE, n)[first] + (after - first).astype(np.uint64))


def smallest(names: np.ndarray, first: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Per interval the place of its smallest name, the leftmost of equal ones."""
    best, left, k = first.copy(), np.arange(len(first)), 1
    while len(left):
        left = left[first[left] + k < after[left]]
        at = first[left] + k
        less = names[at] < names[best[left]]
        best[left[less]] = at[less]
        k += 1
    return best


def anchors(names: np.ndarray, bounds: np.ndarray, length: int, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(start, anchor's name, anchor's first word, word after the anchor) of every window of every text."""
    sizes = np.maximum(0, np.diff(bounds) - length + 1)
    starts = np.arange(int(sizes.sum())) + np.repeat(bounds[:-1] - (np.cumsum(sizes) - sizes), sizes)
    key, at, end = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    live, low, high = np.arange(len(starts)), starts, starts + length  # interior symbols of each window
    begin = np.arange(len(names))  # first word of each symbol
    opens = np.zeros(len(names) + 1, bool)  # symbols that a text begins with
    opens[bounds] = True
    opens = opens[:-1]
    step = 0
    while len(live):
        salt = mix64(np.array([step + 1], np.uint64))
        joined = np.zeros(len(names), bool)  # with the symbol before
        if step % 2 == 0:
            joined[1:] = (names[1:] == names[:-1]) & ~opens[1:]
        else:
            right = (mix64(names ^ salt) & np.uint64(1)).astype(bool)
            joined[1:] = right[1:] & ~right[:-1] & ~opens[1:]
        heads = np.flatnonzero(~joined)
        number = np.cumsum(~joined) - 1
        if step % 2 == 0:
            count = np.diff(np.append(heads, len(names))).astype(np.uint64)
            new = np.where(count > 1, mix64((names[heads] ^ salt) * GOLDEN + count), names[heads])
            new_low, new_high = number[low] + 1, number[high - 1]
        else:
            new = names[heads]
            seconds = np.flatnonzero(joined)
            new[number[seconds]] = mix64(mix64(names[seconds - 1] ^ salt) * GOLDEN + names[seconds])
            new_low, new_high = number[low] + right[low], number[high - 1] + right[high - 1]
        stays = (new_low < new_high) & (step < 2 * rounds)
        if not stays.all():
            chosen = smallest(names, low[~stays], high[~stays])
            key[live[~stays]] = mix64(names[chosen] * GOLDEN + np.uint64(step))
            at[live[~stays]] = begin[chosen]
            end[live[~stays]] = np.append(begin, bounds[-1])[chosen + 1]
        live, low, high = live[stays], new_low[stays], new_high[stays]
        names, begin, opens = new, begin[heads], opens[heads]
        step += 1
    return starts, key, at, end


def pieces(words: Words, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, mark, first start, last start) of every piece; starts count from the text's first word."""
    starts, key, at, end = anchors(words.names, words.bounds, length)
    owner = np.searchsorted(words.bounds, starts, side="right") - 1
    beside = (length - (end - at)) // 2
    ahead = at - starts < beside  # the longer side follows the anchor
    new = np.ones(len(starts), bool)
    new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | (ahead[1:] != ahead[:-1])
    head = np.flatnonzero(new)
    first, last = starts[head], starts[np.append(head[1:], len(starts))[:len(head)] - 1]
    key, at, end, beside, ahead = (x[head] for x in (key, at, end, beside, ahead))
    side = words.fingerprints(np.where(ahead, at, at - beside), np.where(ahead, end + beside, end))
    key = mix64((key ^ side) * GOLDEN + ahead.astype(np.uint64))
    mark = words.fingerprints(first, last + length)
    base = words.bounds[owner[head]]
    return owner[head], key.view(np.int64), mark.view(np.int64), (first - base).astype(np.int32), (last - base).astype(np.int32)


def listed(count: int, owner: np.ndarray, values: np.ndarray) -> pa.Array:
    """Values as one list per text."""
    offsets = np.searchsorted(owner, np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def parsed(rows: DataFrame, length: int) -> DataFrame:
    """owner, tag and the pieces of every text, as lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, limit=BATCH_BYTES):
            owner, *columns = pieces(Words(b.column("text")), length)
            yield pa.RecordBatch.from_arrays([b.column("owner"), b.column("tag"), *(listed(b.num_rows, owner, c) for c in columns)],
                                             names=["owner", "tag", "anchor", "mark", "first", "last"])

    return rows.select("owner", "tag", "text").mapInArrow(
        run, "owner long, tag long, anchor array<long>, mark array<long>, first array<int>, last array<int>")


def windows(open_: DataFrame, length: int) -> DataFrame:
    """(anchor, print, owner, tag, start) of every window of the listed pieces of texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, limit=BATCH_BYTES):
            words = Words(b.column("text"))
            found = [(i, p["first"], p["last"], p["anchor"]) for i, ps in enumerate(b.column("pieces").to_pylist()) for p in ps]
            text, first, last, anchor = (np.array(x, np.int64) for x in zip(*found, strict=True))
            count = last - first + 1
            each = np.repeat(np.arange(len(count)), count)
            start = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count) + first[each]
            at = start + words.bounds[text[each]]
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[each]), pa.array(words.fingerprints(at, at + length).view(np.int64)),
                b.column("owner").take(pa.array(text[each])), b.column("tag").take(pa.array(text[each])), pa.array(start.astype(np.int32))],
                names=["anchor", "print", "owner", "tag", "start"])

    return open_.mapInArrow(run, "anchor long, print long, owner long, tag long, start int")


def cut(joined: DataFrame) -> DataFrame:
    """Texts without the words in ``spans``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, digests = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                words = text.encode().split()
                if spans:
                    depth = np.zeros(len(words) + 1, np.int64)
                    np.add.at(depth, [s["first"] for s in spans], 1)
                    np.add.at(depth, [s["after"] for s in spans], -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
                else:
                    kept = words
                sizes.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def staged(df: DataFrame, name: str) -> DataFrame:
    out = scratch_dir(df.sparkSession, name)
    df.write.parquet(out)
    return df.sparkSession.read.parquet(out)


def repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("owner"), F.xxhash64("text").alias("tag"), "text")
    each = staged(parsed(rows, length), "pieces").select(
        "owner", "tag", F.explode(F.arrays_zip("anchor", "mark", "first", "last")).alias("p")).select("owner", "tag", "p.*")
    name = ["anchor", "mark"]
    known = each.groupBy(*name).agg(F.min("owner").alias("low"), F.max("owner").alias("high"))
    shared = known.groupBy("anchor").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.count(F.lit(1)).alias("kinds")).filter("least < most")
    marked = known.join(shared.select("anchor", (F.col("kinds") > 1).alias("several")), "anchor").filter("several OR low < high")
    found = staged(each.join(marked.select(*name, "low", "several"), name).filter("owner > low OR several"), "shared-pieces")

    whole = found.filter("owner > low").select("owner", "tag", "first", (F.col("last") + length).alias("after"))
    open_ = found.filter("owner = low").groupBy("owner", "tag").agg(F.collect_set(F.struct("first", "last", "anchor")).alias("pieces"))
    every = windows(rows.select("owner", "tag", "text").join(open_, ["owner", "tag"]).select("owner", "tag", "text", "pieces"), length)
    lowest = every.groupBy("anchor", "print").agg(F.min("owner").alias("low"), F.max("owner").alias("high")).filter("low < high").drop("high")
    single = every.join(lowest, ["anchor", "print"]).filter("owner > low").select("owner", "tag", F.col("start").alias("first"), (F.col("start") + length).alias("after"))
    spans = whole.unionByName(single).groupBy("owner", "tag").agg(F.collect_set(F.struct("first", "after")).alias("spans"))
    return cut(rows.join(spans, ["owner", "tag"], "left"))


SQL = f"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + {LENGTH - 1}), ' ') AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {LENGTH} + 2)) AS i FROM t)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS low FROM s) WHERE low < doc_id),
x AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM t)),
c AS (SELECT x.doc_id, x.i, word, coalesce(max(g.i) OVER (PARTITION BY x.doc_id ORDER BY x.i) > x.i - {LENGTH}, false) AS gone
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.i = g.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM t LEFT JOIN k USING (doc_id)
"""
