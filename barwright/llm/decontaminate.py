"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber.

Texts and benchmark items become lower-case words joined by single spaces.  The patterns are the windows of
consecutive item words, with a space at both ends so that only whole words match.  A SHIFT table over hashed
byte blocks tells how far a search position can jump; where it may not jump, the block at the end of the
window selects a bucket of patterns, a prefix table thins the bucket, and a byte comparison decides.  Many
positions of a batch of texts advance together, each jumping by its own shift.

The pattern set is dealt into blocks of bounded size by a hash of the pattern, each broadcast by itself and
searched in all texts; the hits of the blocks are merged, so any number of items can be used.

Nulls: a null text has no words; an item without words has no windows; a null item_id counts as the empty
name; a null doc_id is kept.  Repeated rows give a result row each, repeated items count once by id.  An
empty benchmark hits nothing, an empty table gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import small_batches

WINDOW_WORDS = 10
#: Patterns broadcast at a time (a few dozen MB with their tables at the very most).
PATTERNS_PER_BLOCK = 100_000
TABLE_BITS = 18
LANE_BYTES = 4096
MULTIPLIER = 0x9E3779B97F4A7C15

#: Bytes of words stay (A-Z as a-z), all others become spaces.
TO_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
                 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Every run of ``size`` words; all words of a shorter text; nothing of a text without words."""
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


def build_class(patterns: list[bytes]) -> dict:
    """Tables for patterns of similar length: SHIFT by block hash, buckets by suffix block, prefixes."""
    m = min(map(len, patterns))
    block = min(8, m)
    mask = np.uint64((1 << (8 * block)) - 1)
    width = max(map(len, patterns))
    heads = np.zeros((len(patterns), m + 8), np.uint8)
    for i, p in enumerate(patterns):
        heads[i, 8:] = np.frombuffer(p[:m], np.uint8)
    shift = np.full(1 << TABLE_BITS, m - block + 1, np.int64)
    for end in range(block - 1, m):  # blocks nearer to the end come later and shift less
        values = np.ascontiguousarray(heads[:, end + 1:end + 9]).view("<u8").ravel() >> np.uint64(64 - 8 * block)
        shift[slot(values)] = m - 1 - end
    suffixes = np.ascontiguousarray(heads[:, m:m + 8]).view("<u8").ravel() >> np.uint64(64 - 8 * block)
    prefixes = np.ascontiguousarray(heads[:, 8:8 + block]) if block < 8 else heads[:, 8:16]
    prefix = np.zeros((len(patterns), 8), np.uint8)
    prefix[:, :block] = prefixes
    order = np.argsort(suffixes, kind="stable")
    keys, first = np.unique(suffixes[order], return_index=True)
    return {"m": m, "block": block, "mask": mask, "width": width, "shift": shift, "keys": keys,
            "bounds": np.append(first, len(patterns)), "order": order,
            "prefix": np.ascontiguousarray(prefix).view("<u8").ravel()}


def slot(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (values * np.uint64(MULTIPLIER)) >> np.uint64(64 - TABLE_BITS)


def build(patterns: list[bytes]) -> list[dict]:
    """Patterns grouped by length, so that a short one does not shorten the jumps of the others."""
    classes: dict[int, list[int]] = {}
    for i, p in enumerate(patterns):
        classes.setdefault(min(len(p), 32).bit_length(), []).append(i)
    return [build_class([patterns[i] for i in ids]) | {"ids": np.array(ids)} for ids in classes.values()]


def occurrences(tables: list[dict], patterns: list[bytes], data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, pattern) of every occurrence in ``data``."""
    padded = np.frombuffer(b"\0" * 8 + data + b"\0" * 8, np.uint8)
    loads = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # loads[i + 1] ends at data[i]
    starts, found = [], []
    for t in tables:
        m, drop = t["m"], np.uint64(64 - 8 * t["block"])
        ends = np.arange(m - 1, len(data), LANE_BYTES)
        stops = np.minimum(ends + LANE_BYTES, len(data))
        at, block = [], []
        while len(ends):
            values = loads[ends + 1] >> drop
            jump = t["shift"][slot(values)]
            stay = jump == 0
            if stay.any():
                at.append(ends[stay])
                block.append(values[stay])
                jump[stay] = 1
            ends = ends + jump
            going = ends < stops
            if not going.all():
                ends, stops = ends[going], stops[going]
        if not at:
            continue
        at, block = np.concatenate(at) - (m - 1), np.concatenate(block)
        bucket = np.minimum(np.searchsorted(t["keys"], block), len(t["keys"]) - 1)
        real = t["keys"][bucket] == block
        at, bucket = at[real], bucket[real]
        sizes = t["bounds"][bucket + 1] - t["bounds"][bucket]
        at = np.repeat(at, sizes)
        member = np.repeat(t["bounds"][bucket], sizes) + np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        which = t["order"][member]
        same = (loads[at + 8] & t["mask"]) == t["prefix"][which]
        for a, i in zip(at[same].tolist(), t["ids"][which[same]].tolist(), strict=True):
            if data.startswith(patterns[i], a):
                starts.append(a)
                found.append(i)
    return np.array(starts, np.int64), np.array(found, np.int64)


def scan(texts: list[str | None], tables: list[dict], patterns: list[bytes]):
    """Per text: number of words, disjoint hit ranges in words, patterns found."""
    split = [words_of(t) for t in texts]
    parts = [b" " + b" ".join(w) + b" " for w in split]
    bounds = np.cumsum([0, *map(len, parts)])
    data = b"".join(parts)
    at, which = occurrences(tables, patterns, data)
    owner = np.searchsorted(bounds, at, side="right") - 1
    hits: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for i in np.unique(owner).tolist():
        mine = owner == i
        spaces = np.flatnonzero(np.frombuffer(parts[i], np.uint8) == 32)
        first = np.searchsorted(spaces, at[mine] - bounds[i])
        count = np.array([patterns[k].count(b" ") - 1 for k in which[mine].tolist()])
        ranges: list[tuple[int, int]] = []
        for a, b in sorted(zip(first.tolist(), (first + count).tolist(), strict=True)):
            if ranges and a <= ranges[-1][1]:
                ranges[-1] = (ranges[-1][0], max(ranges[-1][1], b))
            else:
                ranges.append((a, b))
        hits[i] = ranges, set(which[mine].tolist())
    return [len(w) for w in split], hits


def pattern_blocks(benchmark: DataFrame, window: int, per_block: int) -> Iterator[dict[bytes, list[str]]]:
    """Pattern -> names of its items, in blocks of about ``per_block`` patterns."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, n or "") for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
                    for p in windows_of(words_of(t), window)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.string())],
                                             names=["pattern", "item"])

    spark = benchmark.sparkSession
    small_batches(spark)
    windows = benchmark.select(F.col("item_id").cast("string"), F.col("text")).mapInArrow(cut, "pattern binary, item string").distinct()
    blocks = max(1, -(-windows.count() // per_block))
    for k in range(blocks):
        block: dict[bytes, list[str]] = {}
        for row in windows.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).toLocalIterator():
            block.setdefault(bytes(row.pattern), []).append(row.item)
        yield block


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
                  per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """Per row: doc_id, n_words, ranges of hit words, items whose windows occur."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    parts = []
    for block in pattern_blocks(benchmark, window, per_block):
        patterns = list(block)
        shared = spark.sparkContext.broadcast((build(patterns), patterns, [block[p] for p in patterns]))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tables, patterns, names = shared.value
            for b in batches:
                counts, hits = scan(b.column("text").to_pylist(), tables, patterns)
                none = ([], ())
                per_row = [hits.get(i, none) for i in range(len(counts))]
                yield pa.RecordBatch.from_arrays([
                    b.column("row_id"), b.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array([[{"first": a, "after": z} for a, z in r] for r, _ in per_row],
                             pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))),
                    pa.array([sorted({n for k in ks for n in names[k]}) for _, ks in per_row], pa.list_(pa.string())),
                ], names=["row_id", "doc_id", "n_words", "ranges", "items"])

        parts.append(rows.mapInArrow(find, "row_id long, doc_id long, n_words long, ranges array<struct<first:long,after:long>>, items array<string>"))
    if len(parts) == 1:
        return parts[0].drop("row_id")
    merged = parts[0]
    for p in parts[1:]:
        merged = merged.unionByName(p)
    return merged.groupBy("row_id").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")).drop("row_id")


def report(found: DataFrame) -> DataFrame:
    """Counts and digest of ``contamination``."""
    covered = F.expr("""aggregate(array_sort(ranges), named_struct('n', 0L, 'upto', 0L),
        (acc, r) -> named_struct('n', acc.n + greatest(0L, r.after - greatest(r.first, acc.upto)), 'upto', greatest(acc.upto, r.after))).n""")
    return found.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS,
                      per_block: int = PATTERNS_PER_BLOCK) -> DataFrame:
    """Rows without any hit, with all their columns."""
    spark = docs.sparkSession
    kept = docs
    place = docs.columns.index("text")
    for block in pattern_blocks(benchmark, window, per_block):
        patterns = list(block)
        shared = spark.sparkContext.broadcast((build(patterns), patterns))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hits = scan(b.column(place).to_pylist(), *shared.value)[1]
                yield b.filter(pa.array([i not in hits for i in range(b.num_rows)], pa.bool_()))

        kept = kept.mapInArrow(clean, T.StructType(docs.schema.fields))
    return kept


SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
