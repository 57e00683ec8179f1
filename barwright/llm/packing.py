"""Vector bin packing of token sequences.

Every example takes tokens, one segment and loss-bearing tokens; a sequence has a limit on each.  A sequence is
filled with the example whose demand has the largest dot product with what is left of the limits, weighted by how
scarce each of them is in the block; when no example fits whole, one is cut to fill the rest.  Pieces as long as a
sequence stand alone.  A block is a bounded number of rows of one input partition, so packing needs no
shuffle, holds little, and gives the same result when a task is repeated; only the last sequence of a block can be
short.

Nulls: a null text is empty and has the end token alone; a null doc_id is kept.  Repeated rows are packed each,
an empty table gives no pieces, extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import gathered, texts
from .tokens import encoded, encoder

CAPACITY = 1024
MAX_SEGMENTS = 256
MAX_LOSS = 1024
END_ID = 0
BLOCK_BYTES = 8 << 20


def loss_of(start: np.ndarray, length: np.ndarray, prompt: np.ndarray) -> np.ndarray:
    """Loss-bearing tokens of a piece; the first ``prompt`` tokens of an example bear none."""
    return np.maximum(0, start + length - np.maximum(start, prompt))


def pack(lengths: np.ndarray, prompts: np.ndarray, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS,
         max_loss: int = MAX_LOSS) -> np.ndarray:
    """Rows (example, start, length, sequence, offset) for one block of examples, by sequence and offset."""
    if min(capacity, max_segments, max_loss) < 1:
        raise ValueError("every limit must be at least 1")
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    left: list[tuple[int, int, int]] = []
    for i, (n, prompt) in enumerate(zip(lengths.tolist(), prompts.tolist(), strict=True)):
        start = 0
        while n - start >= capacity and max(0, start + capacity - max(start, prompt)) <= max_loss:
            out.append((i, start, capacity, sequence, 0))
            sequence += 1
            start += capacity
        while n - start > 0:  # pieces that respect each limit by themselves
            size = min(n - start, capacity, max(0, prompt - start) + max_loss)
            left.append((i, start, size))
            start += size
    example, start, length = np.array(left, np.int64).reshape(-1, 3).T.copy()
    prompt = prompts[example].astype(np.int64)
    loss = loss_of(start, length, prompt)
    token_weight = length.sum() / capacity / capacity ** 2
    loss_weight = loss.sum() / max_loss / max_loss ** 2
    while len(length):
        tokens, segments, losses, offset = capacity, max_segments, max_loss, 0
        gone = np.zeros(len(length), bool)
        while tokens and segments:
            fits = (length <= tokens) & (loss <= losses) & ~gone
            if fits.any():
                k = int(np.where(fits, token_weight * tokens * length + loss_weight * losses * loss, -1.0).argmax())
                take = int(length[k])
                gone[k] = True
            else:
                room = np.where(gone, 0, np.minimum(tokens, np.maximum(0, prompt - start) + losses))
                k = int(room.argmax())
                take = int(room[k])
                if not take:
                    break
            out.append((int(example[k]), int(start[k]), take, sequence, offset))
            tokens, segments, offset = tokens - take, segments - 1, offset + take
            losses -= int(loss_of(start[k], take, prompt[k]))
            if not gone[k]:
                start[k] += take
                length[k] -= take
                loss[k] = loss_of(start[k], length[k], prompt[k])
        sequence += 1
        stay = ~gone
        example, start, length, prompt, loss = example[stay], start[stay], length[stay], prompt[stay], loss[stay]
    return np.array(out, np.int64).reshape(-1, 5)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Appends ``end_id`` to each text."""
    later = bounds + np.arange(len(bounds))
    out = np.full(later[-1], end_id, np.uint32)
    inside = np.ones(later[-1], bool)
    inside[later[1:] - 1] = False
    out[inside] = ids
    return out, later


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, max_segments: int = MAX_SEGMENTS,
                   max_loss: int = MAX_LOSS, end_id: int = END_ID, prompt_tokens: str | None = None) -> DataFrame:
    """Pieces with their ids (unsigned 32-bit little-endian).  ``prompt_tokens`` names a column with the number of
    leading tokens that bear no loss; without it all tokens do."""
    rows = texts(docs)
    if prompt_tokens:
        rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"),
                           F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)).alias("prompt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        sequences = TaskContext.get().partitionId() << 40
        for b in gathered(batches, limit=BLOCK_BYTES):
            ids, bounds = with_end(*encoded(encode, b.column("text")), end_id)
            lengths = np.diff(bounds)
            prompts = b.column("prompt").to_numpy(zero_copy_only=False) if prompt_tokens else np.zeros(len(lengths), np.int64)
            example, start, length, sequence, offset = pack(lengths, prompts, capacity, max_segments, max_loss).T
            first = bounds[example] + start
            raw = ids.astype("<u4", copy=False)
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(pa.array(example)), pa.array(start), pa.array(length),
                pa.array([raw[a:z].tobytes() for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)], pa.binary()),
                pa.array(lengths[example]), pa.array(sequence + sequences), pa.array(offset),
            ], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequences += int(sequence.max()) + 1
            del ids, raw
            pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def report(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
