"""Exact duplicates by composable polynomial fingerprints.

A text is a sequence of chunks; a chunk's fingerprint is a polynomial in its bytes under four bases and
31-bit primes (124 bits).  Fingerprints of neighbours combine by shifting the left one by the length of the
right one, so a huge document is hashed in many tasks and folded from a few numbers.  Rows with equal length
and fingerprint are then compared with the row that would stay, chunk by chunk; what differs forms a group of
its own and is compared again, so a collision costs a round and never a document.

Nulls: a null text is empty, all empty texts are equal; a null doc_id is larger than any other and only stays
where no other row of its group has an id.  Of rows that repeat both id and text one stays.  An empty table
gives an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import small_batches

#: Bases and primes of the four polynomials.
POLYNOMIALS = ((1000003, 2147483647), (715827881, 2147483629), (1431655777, 2147483587), (987654337, 2147483579))
CHUNK_CHARS = 1 << 20
BLOCK = 4096
KEY = ("n_bytes", "fp_a", "fp_b")


def normalised(text: Column) -> Column:
    """Each run of blanks (space, tab to carriage return) is one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def chunks_of(text: Column, size: int) -> Column:
    """Consecutive pieces of at most ``size`` characters; an empty text has one empty piece."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))


def polynomial_tables(polynomials) -> tuple[np.ndarray, np.ndarray]:
    """Powers base^(BLOCK-1) .. base^0 per polynomial, and the primes."""
    primes = np.array([p for _, p in polynomials], dtype=np.int64)
    powers = np.ones((BLOCK, len(polynomials)), dtype=np.int64)
    bases = np.array([b for b, _ in polynomials], dtype=np.int64)
    for i in range(BLOCK - 2, -1, -1):
        powers[i] = powers[i + 1] * bases % primes
    return powers, primes


def fingerprint(data: bytes, tables: tuple[np.ndarray, np.ndarray], polynomials) -> np.ndarray:
    """Polynomial of the bytes (each plus one, so that zero bytes count), one value per prime."""
    powers, primes = tables
    values = np.frombuffer(data, dtype=np.uint8).astype(np.int64) + 1
    n = len(values)
    if n <= BLOCK:
        return values @ powers[BLOCK - n:] % primes if n else np.zeros(len(primes), np.int64)
    padded = np.concatenate([np.zeros(-n % BLOCK, np.int64), values])
    acc = np.zeros(len(primes), np.int64)
    step = np.array([pow(b, BLOCK, p) for b, p in polynomials], dtype=np.int64)
    for h in padded.reshape(-1, BLOCK) @ powers % primes:
        acc = (acc * step + h) % primes
    return acc


def hash_chunks(polynomials):
    """Adds to (row_id, doc_id, sha, chunk_no, chunk): length, the four values and the shift of each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = polynomial_tables(polynomials)
        for b in batches:
            raw = [x.encode() for x in b.column("chunk").to_pylist()]
            values = np.array([fingerprint(x, tables, polynomials) for x in raw]).reshape(len(raw), -1)
            shifts = [[pow(base, len(x), p) for base, p in polynomials] for x in raw]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("doc_id"), b.column("text_sha256"), b.column("chunk_no"),
                 pa.array([len(x) for x in raw], pa.int64()),
                 pa.array(values.tolist(), pa.list_(pa.int64())), pa.array(shifts, pa.list_(pa.int64()))],
                names=["row_id", "doc_id", "text_sha256", "chunk_no", "n_bytes", "h", "shift"])
    return run


HASHED = "row_id long, doc_id long, text_sha256 string, chunk_no int, n_bytes long, h array<long>, shift array<long>"


def combined(parts: DataFrame, polynomials) -> DataFrame:
    """Chunk fingerprints folded from left to right into one per row."""
    primes = [p for _, p in polynomials]
    start = ", ".join(["0L"] * len(primes))
    step = ", ".join(f"(acc[{i}] * x.shift[{i}] + x.h[{i}]) % {p}L" for i, p in enumerate(primes))
    return parts.groupBy("row_id", "doc_id", "text_sha256").agg(
        F.sum("n_bytes").alias("n_bytes"),
        F.sort_array(F.collect_list(F.struct("chunk_no", "h", "shift"))).alias("parts"),
    ).select("doc_id", "text_sha256", "n_bytes", F.expr(f"aggregate(parts, array({start}), (acc, x) -> array({step}))").alias("h"))


def row_fingerprints(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, polynomials=POLYNOMIALS) -> DataFrame:
    """doc_id, text_sha256, n_bytes, fp_a, fp_b per row.  Short texts are hashed where they are read; the
    chunks of long ones are dealt over the cluster and folded."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"),
                       normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2(F.encode("norm", "utf-8"), 256))
    short = rows.filter(F.length("norm") <= chunk_chars).select(
        "row_id", "doc_id", "text_sha256", F.lit(0).alias("chunk_no"), F.col("norm").alias("chunk"))
    long = rows.filter(F.length("norm") > chunk_chars).select(
        "row_id", "doc_id", "text_sha256", F.posexplode(chunks_of(F.col("norm"), chunk_chars)).alias("chunk_no", "chunk"))
    single = short.mapInArrow(hash_chunks(polynomials), HASHED).select("doc_id", "text_sha256", "n_bytes", "h")
    folded = combined(long.repartition("row_id", "chunk_no").mapInArrow(hash_chunks(polynomials), HASHED), polynomials)
    h = F.col("h")
    at = lambda i: F.coalesce(F.try_element_at(h, F.lit(i)), F.lit(0))
    return single.unionByName(folded).select(
        "doc_id", "text_sha256", "n_bytes",
        F.shiftleft(at(1), 31).bitwiseOR(at(2)).alias("fp_a"), F.shiftleft(at(3), 31).bitwiseOR(at(4)).alias("fp_b"))


def differing(docs: DataFrame, groups: DataFrame, chunk_chars: int) -> DataFrame:
    """(doc_id, text_sha256) of rows that do not equal, chunk by chunk, the row their group would keep."""
    suspects = groups.filter("group_size > 1").select("doc_id", "text_sha256", *KEY, "round", "keep_id", "keep_sha").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("text_sha256", F.sha2(F.encode("norm", "utf-8"), 256))
    rows = rows.join(suspects, (rows.doc_id.eqNullSafe(suspects.doc_id)) & (rows.text_sha256 == suspects.text_sha256)).select(
        suspects.doc_id, suspects.text_sha256, *KEY, "round", "keep_id", "keep_sha",
        F.posexplode(chunks_of(F.col("norm"), chunk_chars)).alias("chunk_no", "chunk"))
    stays = (F.col("doc_id").eqNullSafe(F.col("keep_id"))) & (F.col("text_sha256") == F.col("keep_sha"))
    kept = rows.filter(stays).select(*KEY, "round", "chunk_no", F.col("chunk").alias("kept_chunk")).dropDuplicates([*KEY, "round", "chunk_no"])
    return rows.filter(~stays).join(kept, [*KEY, "round", "chunk_no"], "left").filter(
        ~F.col("chunk").eqNullSafe(F.col("kept_chunk"))).select("doc_id", "text_sha256").distinct()


def exact_groups(docs: DataFrame, chunk_chars: int = CHUNK_CHARS, polynomials=POLYNOMIALS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (see the module's text)."""
    prints = cut_lineage(row_fingerprints(docs, chunk_chars, polynomials).withColumn("round", F.lit(0)))
    while True:
        order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_sha256")
        groups = prints.groupBy(*KEY, "round").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size")).select(
            *KEY, "round", F.col("first.doc_id").alias("keep_id"), F.col("first.text_sha256").alias("keep_sha"), "group_size")
        placed = prints.join(groups, [*KEY, "round"])
        odd = cut_lineage(differing(docs, placed, chunk_chars))
        if odd.isEmpty():
            break
        later = odd.withColumn("odd", F.lit(1))
        prints = cut_lineage(prints.join(
            later, prints.doc_id.eqNullSafe(later.doc_id) & (prints.text_sha256 == later.text_sha256), "left").select(
            prints.doc_id, prints.text_sha256, *KEY, (F.col("round") + F.coalesce("odd", F.lit(0))).alias("round")))
    same = Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0))
    return placed.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    rows = docs.withColumn("__text", F.sha2(F.encode(normalised(F.col("text")), "utf-8"), 256))
    stay = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__sha")), "left_semi")
    return stay.dropDuplicates(["doc_id", "__text"]).drop("__text")


SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
