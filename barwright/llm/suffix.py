"""Repeated byte strings by two-stage suffix sorting.

A byte goes when a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller doc_id.  Equal
strings are brought together by minimizers: the smallest hash of the 16-byte pieces of a string depends on the string
alone, and neighbouring strings mostly share it, so a text is cut into runs of string starts with one minimizer.

1. Texts are dealt into blocks of bounded size; each block sends its distinct minimizers to hash buckets.
2. A bucket tells which minimizers occur in several documents, and which in so many blocks that they are hot.
3. Blocks send the bytes under the runs of shared minimizers to the buckets, each distinct piece once with its smallest
   doc_id and its places.  The strings of hot minimizers are sent one by one to the bucket of their own hash, so that
   a passage in very many documents does not fill one bucket.
4. A bucket sorts the suffixes of its pieces: those smaller than their successors directly, the others by bucket
   scans; equal strings are then neighbours, found by common prefixes, and share the smallest doc_id.
5. Blocks take back the removed intervals and unite them per document.

Nulls: a null text is empty; a null doc_id is larger than any other.  Rows with the same doc_id do not remove each
other's bytes.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import mix64, small_batches

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 3 << 20
BUCKET_BYTES = 2 << 20
#: A minimizer found in so many blocks is hot.
HOT_BLOCKS = 1024
NO_ID = np.iinfo(np.int64).max


def loads(data: np.ndarray, at: np.ndarray | slice, size: int = 8) -> np.ndarray:
    """Unaligned 64-bit words; ``data`` must have 8 bytes behind every place."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]


# -- minimizer runs of a block ---------------------------------------------------------------------------------

class Block:
    """The texts of a block in a fixed order, as one buffer."""

    def __init__(self, table: pa.Table):
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True),
                      key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        raw = [t.encode() for _, t in rows]
        self.given = [d for d, _ in rows]
        self.ids = np.array([NO_ID if d is None else d for d in self.given], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        self.data = np.frombuffer(b"".join(raw) + b"\0" * (LENGTH + 8), np.uint8)

    def runs(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(minimizer, document, first start, last start) of every run of strings with one minimizer."""
        n = int(self.bounds[-1])
        none = np.zeros(0, np.int64)
        if n < length:
            return none.view(np.uint64), none, none, none
        gram = min(GRAM, length)
        words = loads(self.data, slice(0, n))
        hashes = mix64(words if gram <= 8 else words + mix64(loads(self.data, slice(gram - 8, n + gram - 8))) * np.uint64(0x9E3779B97F4A7C15))
        if gram < 8:
            hashes = mix64(words << np.uint64(64 - 8 * gram))
        low, width, span = hashes, 1, length - gram + 1
        del hashes
        del words
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if span > width:
            low = np.minimum(low[:-(span - width)], low[span - width:])
        sizes = np.maximum(0, np.diff(self.bounds) - length + 1)
        if not sizes.any():
            return none.view(np.uint64), none, none, none
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(owner)) + np.repeat(self.bounds[:-1] - (np.cumsum(sizes) - sizes), sizes)
        value = low[at]
        cut = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        first = np.flatnonzero(cut)
        return value[first], owner[first], at[first], at[np.append(first[1:], len(at)) - 1]


def place_of(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32-bit name of a minimizer."""
    return ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), value.astype(np.uint32)


def pack(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def unpack(data: bytes, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def split_rows(bucket: np.ndarray, *arrays: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """Arrays ordered by bucket and cut into one byte string per bucket."""
    order = np.argsort(bucket, kind="stable")
    names, first = np.unique(bucket[order], return_index=True)
    upto = np.append(first[1:], len(order))[:len(first)]
    return names, [[x[a:z].tobytes() for a, z in zip(first.tolist(), upto.tolist(), strict=True)] for x in (y[order] for y in arrays)]


def table(schema: pa.Schema, *columns) -> pa.Table:
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def schema(spec: str) -> tuple[str, pa.Schema]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return spec, pa.schema([(n, kinds[t]) for n, t in (c.split() for c in spec.split(", "))])


NAMES = schema("bucket int, block int, single binary, several binary")
SHARED = schema("block int, bucket int, shared binary, hot binary")
PIECES = schema("bucket int, block int, data binary, sizes binary, lows binary, piece binary, doc binary, owner binary, start binary")
GONE = schema("block int, owner binary, first binary, after binary")
RESULT = schema("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def send_minimizers(length: int, buckets: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        value, owner, _, _ = Block(group).runs(length)
        order = np.lexsort((owner, value))
        value, owner = value[order], owner[order]
        new = np.concatenate([[True], value[1:] != value[:-1]])[:len(value)]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(value))[:len(first)] - 1
        value, many = value[first], owner[first] != owner[last]
        bucket, name = place_of(value, buckets)
        names, (single,) = split_rows(bucket[~many], name[~many])
        others, (several,) = split_rows(bucket[many], name[many])
        one, two = dict(zip(names.tolist(), single, strict=True)), dict(zip(others.tolist(), several, strict=True))
        all_ = sorted({*one, *two})
        return table(NAMES[1], all_, [key[0].as_py()] * len(all_), [one.get(b, b"") for b in all_], [two.get(b, b"") for b in all_])
    return run


def find_shared(hot_blocks: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        blocks, names, many = [], [], []
        for block, one, two in zip(*(group.column(c).to_pylist() for c in ("block", "single", "several")), strict=True):
            name = np.concatenate([np.frombuffer(one, np.uint32), np.frombuffer(two, np.uint32)])
            blocks.append(np.full(len(name), block, np.int32))
            names.append(name)
            many.append(np.arange(len(name)) * 4 >= len(one))
        block, name, several = np.concatenate(blocks), np.concatenate(names), np.concatenate(many)
        _, at, count = np.unique(name, return_inverse=True, return_counts=True)
        shared = (count >= 2)[at] | (np.bincount(at, several) > 0)[at]
        hot = (count >= hot_blocks)[at]
        rows, (found, flags) = split_rows(block[shared].astype(np.int64), name[shared], hot[shared])
        return table(SHARED[1], rows, [key[0].as_py()] * len(rows), found, flags)
    return run


def send_pieces(length: int, buckets: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return PIECES[1].empty_table()
        block = Block(left)
        value, owner, first, last = block.runs(length)
        bucket, name = place_of(value, buckets)
        known, hot = [], []
        for b, names, flags in zip(*(right.column(c).to_pylist() for c in ("bucket", "shared", "hot")), strict=True):
            known.append(np.frombuffer(names, np.uint32).astype(np.uint64) | np.uint64(b << 32))
            hot.append(np.frombuffer(flags, bool))
        known, hot = np.concatenate(known), np.concatenate(hot)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        code = name.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32))
        at = np.minimum(np.searchsorted(known, code), len(known) - 1)
        there = np.flatnonzero(known[at] == code)
        raw = block.data.tobytes()
        alone = hot[at[there]]
        runs, each = there[~alone], there[alone]
        count = last[each] - first[each] + 1
        single = np.repeat(first[each] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        starts = np.concatenate([first[runs], single])
        owners = np.concatenate([owner[runs], np.repeat(owner[each], count)])
        texts = [raw[a:z] for a, z in zip(first[runs].tolist(), (last[runs] + length).tolist(), strict=True)]
        texts += [raw[a:a + length] for a in single.tolist()]
        own = np.array([zlib.crc32(t) % buckets for t in texts[len(runs):]], np.int64)  # equal strings meet by their own hash
        number: dict[bytes, int] = {}
        piece = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
        of = np.zeros(len(number), np.int64)
        of[piece] = np.concatenate([bucket[runs], own])
        low = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(low, piece, block.ids[owners])
        keys = list(number)
        order = np.argsort(of, kind="stable")
        rank = np.zeros(len(order), np.int64)
        names, begin = np.unique(of[order], return_index=True)
        upto = np.append(begin[1:], len(order))[:len(begin)]
        rank[order] = np.arange(len(order)) - np.repeat(begin, upto - begin)
        cut = list(zip(begin.tolist(), upto.tolist(), strict=True))
        texts = [keys[i] for i in order.tolist()]
        sizes = np.array([len(t) for t in texts], np.uint32)
        places = split_rows(of[piece], rank[piece].astype(np.uint32), block.ids[owners], owners.astype(np.uint32),
                            (starts - block.bounds[owners]).astype(np.uint32))[1]
        return table(PIECES[1], names, [key[0].as_py()] * len(names), [pack(b"".join(texts[a:z])) for a, z in cut],
                     [pack(sizes[a:z].tobytes()) for a, z in cut], [pack(low[order[a:z]].tobytes()) for a, z in cut],
                     *([pack(x) for x in column] for column in places))
    return run


# -- two-stage suffix sorting ----------------------------------------------------------------------------------

def prefix_words(data: np.ndarray, at: np.ndarray, length: int) -> list[np.ndarray]:
    """The first ``length`` bytes of each suffix as big-endian words, the first word first."""
    words = []
    for k in range(0, length, 8):
        w = loads(data, at + k).byteswap()
        if length - k < 8:
            w &= np.uint64((1 << 64) - (1 << (64 - 8 * (length - k))))
        words.append(w)
    return words


def suffix_order(data: np.ndarray, n: int, length: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of data[:n] in the order of their first ``length`` bytes (``data`` has zeros behind them).  With
    ``wanted`` (a mask) only those, and others that they follow from.

    A suffix smaller than its successor is sorted by its bytes.  Any other starts with a byte not below the next one,
    and follows from its successor: going through the order by first byte, each suffix puts the one before it, if
    that is larger, at the next place of its bucket.
    """
    text = data[:n]
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    begins = np.concatenate([[0], change])
    rises = np.append(text[begins[1:]] > text[begins[:-1]], False)
    small = np.repeat(rises, np.diff(np.append(begins, n)))  # smaller than the successor
    direct = np.flatnonzero(small)
    ends_larger = True
    if wanted is not None:  # the first suffix from each wanted one on that is sorted directly
        after = np.searchsorted(direct, np.flatnonzero(wanted))
        ends_larger = bool((after == len(direct)).any())
        used = np.zeros(len(direct) + 1, bool)
        used[after] = True
        direct = direct[used[:-1]]
    direct = direct[np.lexsort(prefix_words(data, direct, length)[::-1])] if len(direct) else direct
    upto = np.searchsorted(text[direct], np.arange(257))  # their first bytes ascend
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if ends_larger:
        induced[text[n - 1]].append(np.array([n - 1]))  # before the end stands nothing smaller
    out = []
    for c in range(256):
        larger, todo = [], induced[c]
        while todo:  # suffixes of this bucket that follow from others in it come generation by generation
            now = np.concatenate(todo)
            larger.append(now)
            before = now[now > 0] - 1
            todo = [same] if len(same := before[text[before] == c]) else []
        own = [*larger, direct[upto[c]:upto[c + 1]]]
        whole = np.concatenate(own)
        if not len(whole):
            continue
        out.append(whole)
        before = whole[whole > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        for d, a, z in zip(*(x.tolist() for x in _groups(first)), strict=True):
            induced[d].append(before[a:z])
    return np.concatenate(out) if out else direct


def _groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, begin and end of each run of equal values."""
    begin = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])
    return values[begin], begin, np.append(begin[1:], len(values))[:len(begin)]


def smallest_owner(data: bytes, sizes: np.ndarray, lows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the string at every start of every piece the smallest doc_id that has it, and the pieces' bounds in it."""
    n = len(data)
    buffer = np.frombuffer(data + b"\0" * (length + 8), np.uint8)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(n) + length <= ends[owner]
    order = suffix_order(buffer, n, length, inside)
    order = order[inside[order]]
    low = np.full(n, NO_ID, np.int64)
    if len(order):
        words = prefix_words(buffer, order, length)
        new = np.zeros(len(order), bool)  # the common prefix with the suffix before is shorter than a string
        new[0] = True
        for w in words:
            new[1:] |= w[1:] != w[:-1]
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(lows[owner[order]], begin)
        low[order] = np.repeat(least, np.diff(np.append(begin, len(order))))
    return low[inside], np.concatenate([[0], np.cumsum(sizes - length + 1)])


def find_removed(length: int):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by("block").to_pylist()
        number: dict[bytes, int] = {}
        lows, mine = [], []
        for r in rows:
            data, ends = zstandard.decompress(r["data"]), np.cumsum(unpack(r["sizes"]), dtype=np.int64).tolist()
            mine.append(np.array([number.setdefault(data[a:z], len(number)) for a, z in zip([0, *ends], ends)], np.int64))  # noqa: B905
            lows.append(unpack(r["lows"], np.int64))
        sizes = np.array([len(p) for p in number], np.int64)
        first_ids = np.full(len(number), NO_ID, np.int64)
        np.minimum.at(first_ids, np.concatenate(mine), np.concatenate(lows))
        low, bounds = smallest_owner(b"".join(number), sizes, first_ids, length)
        least, most = np.minimum.reduceat(low, bounds[:-1]), np.maximum.reduceat(low, bounds[:-1])
        out = ([], [], [], [])
        for r, local in zip(rows, mine, strict=True):
            piece, doc = local[unpack(r["piece"])], unpack(r["doc"], np.int64)
            owner, start = (unpack(r[c]).astype(np.int64) for c in ("owner", "start"))
            all_ = np.flatnonzero(most[piece] < doc)
            part = np.flatnonzero((most[piece] >= doc) & (least[piece] < doc)).tolist()
            owners, first, after = [owner[all_]], [start[all_]], [start[all_] + sizes[piece[all_]]]
            for i in part:
                p = int(piece[i])
                gone = np.flatnonzero(low[bounds[p]:bounds[p + 1]] < doc[i])
                edge = np.flatnonzero(np.diff(gone) > 1)
                a, z = gone[np.append(0, edge + 1)], gone[np.append(edge, -1)]
                owners.append(np.full(len(a), owner[i]))
                first.append(start[i] + a)
                after.append(start[i] + z + length)
            packed = [np.concatenate(x).astype(np.int64) for x in (owners, first, after)]
            if len(packed[0]):
                for column, x in zip(out, (r["block"], *(pack(x.tobytes()) for x in packed)), strict=True):
                    column.append(x)
        return table(GONE[1], *out)
    return run


def cut_documents(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return RESULT[1].empty_table()
    block = Block(left)
    n = int(block.bounds[-1])
    depth = np.zeros(n + 1, np.int32)
    for o, a, z in zip(*(right.column(c).to_pylist() for c in ("owner", "first", "after")), strict=True):
        base = block.bounds[unpack(o, np.int64)]
        np.add.at(depth, base + unpack(a, np.int64), 1)
        np.add.at(depth, base + unpack(z, np.int64), -1)
    gone = np.cumsum(depth)[:n] > 0
    removed, spans, digests = [], [], []
    for a, z in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
        g = gone[a:z]
        removed.append(int(g.sum()))
        spans.append(int((g[1:] & ~g[:-1]).sum()) + int(z > a and g[0]))
        digests.append(hashlib.sha256(block.data[a:z][~g].tobytes()).hexdigest())
    return table(RESULT[1], block.given, np.diff(block.bounds), removed, spans, digests)


def repeated_strings(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
                     hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = max(1, total // block_bytes), max(1, total // bucket_bytes)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).repartition("block")
    by_block = rows.groupBy("block")
    names = by_block.applyInArrow(send_minimizers(length, buckets), NAMES[0])
    shared = names.groupBy("bucket").applyInArrow(find_shared(hot_blocks), SHARED[0])
    pieces = by_block.cogroup(shared.groupBy("block")).applyInArrow(send_pieces(length, buckets), PIECES[0])
    gone = pieces.groupBy("bucket").applyInArrow(find_removed(length), GONE[0])
    return by_block.cogroup(gone.groupBy("block")).applyInArrow(cut_documents, RESULT[0])
