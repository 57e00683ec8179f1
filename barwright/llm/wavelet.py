"""Token ids in wavelet matrices, one per shard.

A shard holds the ids of consecutive documents over its own dense alphabet as bit-planes, from the highest bit
down; each plane is followed by the next in the order of a stable partition by its bits.  Counts of ones before
every block of 512 bits make rank a table look-up and a short popcount, and so token access, counting and the
places of a token are answered from the planes without decoding them.  Shards are rows of zstd-compressed
Parquet, written by Spark's commit protocol to a folder all executors share, in ascending order of doc_id
(repeated ids by text).  A shard ends with the document that fills it.

Nulls: a null text is empty and has the end token alone; a null doc_id comes first.  Repeated rows are written
each, an empty table gives no shards, extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import gathered, small_batches, texts
from .packing import with_end
from .tokens import encoder

END_ID = 2
SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
#: Shards a Python task holds at a time.
SHARD_ROWS = 4

SCHEMA = ("part int, shard int, first_token long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
          "alphabet binary, zeros array<long>, planes array<binary>, ranks array<binary>")


def build(ids: np.ndarray) -> dict:
    """Alphabet, number of zeros, bits and rank directory per plane."""
    present = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    present[ids] = True
    alphabet = np.flatnonzero(present).astype("<u4")
    code = np.zeros(len(present), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    code[alphabet] = np.arange(len(alphabet))
    now = code[ids]
    zeros, planes, ranks = [], [], []
    for level in range(max(1, int(len(alphabet) - 1).bit_length()) - 1, -1, -1):
        ones = (now & code.dtype.type(1 << level)) != 0
        bits = np.packbits(ones)
        blocks = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), BLOCK_BITS // 8), dtype=np.int64)
        planes.append(bits.tobytes())
        ranks.append((np.cumsum(blocks) - blocks).astype("<u4").tobytes())
        zeros.append(len(now) - int(np.count_nonzero(ones)))
        if level:  # compress: masks as irregular as these are several times slower as an index
            now = np.concatenate([now.compress(~ones), now.compress(ones)])
    return {"alphabet": alphabet.tobytes(), "zeros": zeros, "planes": planes, "ranks": ranks}


class WaveletMatrix:
    """Access, counting and look-up on one shard."""

    def __init__(self, n: int, alphabet: bytes, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, zeros
        self.alphabet = np.frombuffer(alphabet, "<u4")
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    def ones(self, level: int, i: int) -> int:
        """Ones before position i of a plane."""
        block = min(i // BLOCK_BITS, len(self.ranks[level]) - 1)
        first = block * BLOCK_BITS // 8
        bits = self.planes[level]
        whole = int(np.bitwise_count(bits[first:i // 8]).sum())
        return int(self.ranks[level][block]) + whole + (int(bits[i // 8] >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def access(self, i: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.planes[level][i // 8] >> (7 - i % 8)) & 1
            ones = self.ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return int(self.alphabet[value])

    def span(self, token: int, upto: int | None = None) -> tuple[int, int]:
        """Where the occurrences of a token before ``upto`` stand below the last plane."""
        a, b = 0, self.n if upto is None else upto
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            ones = self.ones(level, a), self.ones(level, b)
            one = code >> (len(self.zeros) - 1 - level) & 1
            a, b = (zeros + ones[0], zeros + ones[1]) if one else (a - ones[0], b - ones[1])
        return a, b

    def count(self, token: int, upto: int | None = None) -> int:
        a, b = self.span(token, upto)
        return b - a

    def place(self, level: int, k: int, one: int) -> int:
        """Position of the k-th (from 0) bit of a kind in a plane: by block counts, then inside the block."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * BLOCK_BITS - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK_BITS // 8:(block + 1) * BLOCK_BITS // 8])
        return block * BLOCK_BITS + int(np.flatnonzero(bits == one)[k - before[block]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self.span(token)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for level in range(len(self.zeros) - 1, -1, -1):
            zeros = self.zeros[level]
            i = self.place(level, i - zeros, 1) if i >= zeros else self.place(level, i, 0)
        return i

    def tokens(self) -> np.ndarray:
        """All ids: the stable partitions undone from the last plane up."""
        values = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n).view(bool)
            zeros = self.zeros[level]
            up = np.empty_like(values)
            up[np.flatnonzero(~ones)] = values[:zeros]  # faster than a mask as the index
            up[np.flatnonzero(ones)] = values[zeros:] | values.dtype.type(1 << (len(self.zeros) - 1 - level))
            values = up
        return self.alphabet[values]


def matrix(row: dict) -> WaveletMatrix:
    return WaveletMatrix(row["n_tokens"], row["alphabet"], row["zeros"], row["planes"], row["ranks"])


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encodes whole texts and writes their shards to ``out``."""
    # Ids that repeat are told apart by text and by place, so that no range of the order is a single key.
    order = ["doc_id", "text_hash", "row_id"]
    rows = texts(docs).withColumn("text_hash", F.xxhash64("text")).withColumn("row_id", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*order).sortWithinPartitions("doc_id", "text", "row_id").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        ids, names, lengths, size, first, shard = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            row = {"part": part, "shard": shard, "first_token": first, "n_tokens": size, "doc_ids": names, "doc_tokens": lengths}
            return pa.RecordBatch.from_pylist([row | build(np.concatenate(ids))], schema=ARROW_SCHEMA)

        for b in gathered(batches):
            encoded, bounds = with_end(*encode(b.column("text")), end_id)
            doc_ids, sizes = b.column("doc_id").to_pylist(), np.diff(bounds)
            done = 0
            while done < len(sizes):
                full = np.searchsorted(np.cumsum(sizes[done:]), shard_tokens - size) + 1
                upto = min(len(sizes), done + int(full))
                ids.append(encoded[bounds[done]:bounds[upto]])
                names, lengths = names + doc_ids[done:upto], lengths + sizes[done:upto].tolist()
                size, done = size + len(ids[-1]), upto
                if size >= shard_tokens:
                    yield close()
                    ids, names, lengths, size, first, shard = [], [], [], 0, first + size, shard + 1
        if names:
            yield close()

    rows.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(out)


ARROW_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int32()), ("first_token", pa.int64()), ("n_tokens", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("alphabet", pa.binary()),
    ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    small_batches(spark, SHARD_ROWS)
    return spark.read.schema(SCHEMA).parquet(path)


def placed(rows: DataFrame, shards: DataFrame, column: str) -> DataFrame:
    """Turns positions within a part into positions over all shards; only narrow rows are joined."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    # One row per written part; the sums before it are the only global order.
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    return rows.join(parts, "part").withColumn(column, F.col("part_start") + F.col(column)).drop("part", "part_start")


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the decoded ids of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {n: b.column(n)[i].as_py() for n in b.schema.names}
                raw = memoryview(matrix(row).tokens().astype("<u4", copy=False)).cast("B")
                sizes = np.array(row["doc_tokens"], np.int64)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(sizes), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["first_token"] + bounds[:-1]), pa.array(sizes),
                    pa.array([zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.int64()),
                ], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    return placed(shards.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids_crc32 long"), shards, "start")


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """Global positions of a token, by select on each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                m = matrix(row)
                places = [row["first_token"] + m.select(token, k) for k in range(m.count(token))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), row["part"], np.int32)), pa.array(places, pa.int64())],
                                                 names=["part", "position"])

    return placed(shards.mapInArrow(run, "part int, position long"), shards, "position")
