"""Chat formatting with offset-aligned loss masks.

A turn is rendered as ``<|turn|>role``, a line feed, the text and ``<|end|>`` with a line feed.  Inside roles and texts a
backslash is doubled and every control string gets a backslash after its first character (a line feed in a role becomes
backslash and n), so no control string of the template or of a common other one appears by itself and the original
comes back exactly.  A rendered conversation is encoded once with offsets; the spans of assistant texts are intersected
with the token spans by binary search, and a token that crosses the edge of a text counts with the part inside it.

A conversation is rendered in blocks of ``BLOCK_TURNS`` turn numbers, each in its own task, and a block is cut after
``PIECE_CHARS`` characters at the end of a turn; all but enormous conversations are one piece.  Digests stream over a
conversation's pieces in order and hold one piece at a time.

Nulls: a null role or text is empty, a null turn comes first, rows with a null conv_id are one conversation.  Rows
of equal turn are ordered by role and text and repeated rows all stay.  An empty table gives an empty result; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import small_batches, worker_state

TURN, END = "<|turn|>", "<|end|>"
#: Strings that other templates and tokenizers give a meaning.  Fixed values.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>")
CONTROLS = (TURN, END, *FOREIGN)
CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
LOSS_ROLE = "assistant"
BLOCK_TURNS = 1024
PIECE_CHARS = 1 << 20
BATCH_ROWS = 32


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """Formatted turns and the spans of their loss-bearing texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape_role(role)}\n", escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn."""
    at = 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape(formatted[at + len(TURN):line]), unescape(formatted[line + 1:end])
        at = end + len(END) + 1


def masked(spans: list[tuple[int, int]], offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Loss mask of the tokens and the characters under it: token spans clipped to the given spans and merged."""
    mask, under = np.zeros(len(offsets), bool), []
    if not len(offsets):
        return mask, under
    first, last = offsets[:, 0], np.maximum.accumulate(offsets[:, 1])
    for a, b in spans:
        lo, hi = np.searchsorted(last, a, side="right"), np.searchsorted(first, b, side="left")
        if lo >= hi or a >= b:
            continue
        mask[lo:hi] = True
        start, end = np.maximum(first[lo:hi], a), np.minimum(last[lo:hi], b)
        gaps = np.flatnonzero(start[1:] > end[:-1]) + 1
        under += zip(start[np.append(0, gaps)].tolist(), end[np.append(gaps - 1, -1)].tolist(), strict=True)
    return mask, under


def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
SCHEMA = ("conv_id long, block long, piece int, formatted string, input_ids array<int>, loss_mask array<boolean>, "
          "loss_spans array<struct<start:long,end:long>>")


def format_conversations(conversations: DataFrame, tokenizer: str, block_turns: int = BLOCK_TURNS,
                         piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Rendered pieces with token ids, the loss mask of the tokens and the characters under it."""
    small_batches(conversations.sparkSession, BATCH_ROWS)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).cast("long"))
    rows = rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_state(f"chat:{tokenizer}", lambda: load(tokenizer)).encode
        key, turns, size, piece = None, [], 0, 0

        def close() -> pa.RecordBatch:
            formatted, spans = render(turns)
            tokens = encode(formatted, add_special_tokens=False)
            mask, under = masked(spans, np.array(tokens.offsets, np.int64).reshape(-1, 2))
            return pa.RecordBatch.from_arrays([
                pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([piece], pa.int32()), pa.array([formatted]),
                pa.array([tokens.ids], pa.list_(pa.int32())), pa.array([mask.tolist()], pa.list_(pa.bool_())),
                pa.array([[{"start": a, "end": b} for a, b in under]], SPAN),
            ], names=["conv_id", "block", "piece", "formatted", "input_ids", "loss_mask", "loss_spans"])

        for b in batches:
            for conv, block, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "block", "role", "text")), strict=True):
                if turns and ((conv, block) != key or size >= piece_chars):
                    yield close()
                    piece = piece + 1 if (conv, block) == key else 0
                    turns, size = [], 0
                key = conv, block
                turns.append((role, text))
                size += len(text)
        if turns:
            yield close()

    return rows.select("conv_id", "block", "role", "text").mapInArrow(run, SCHEMA)


def report(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted pieces: turns, loss text and length."""
    small_batches(formatted.sparkSession, BATCH_ROWS)
    rows = formatted.select("conv_id", "block", "piece", "formatted", "loss_spans")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        none = object()
        key, n, chars, loss, all_turns, all_loss = none, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
            done.clear()
            return out

        for b in batches:
            for conv, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans")), strict=True):
                if conv != key:
                    if key is not none:
                        done.append((key, n, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars))
                    key, n, chars, loss, all_turns, all_loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, body in parse(text):
                    all_turns.update(f"{role}\n{body}\n".encode())
                    n += 1
                for s in spans:
                    under = unescape(text[s["start"]:s["end"]])
                    all_loss.update(under.encode())
                    loss += len(under)
                chars += len(text)
            if len(done) > 1000:
                yield flush()
        if key is not none:
            done.append((key, n, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars))
        if done:
            yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that says control strings, added to the table by the query.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def _control_count(column: str) -> str:
    pattern = "|".join(re.sub(r"([|\[\]])", r"\\\1", c) for c in sorted(CONTROLS, key=len, reverse=True))
    return f"len(regexp_extract_all({column}, '{pattern}')) + length({column}) - length(replace({column}, '\\', ''))"


SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, length(role) + length(text) + {len(TURN) + len(END) + 2} + {_control_count('role')} + length(role) - length(replace(role, chr(10), ''))
      + {_control_count('text')} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
