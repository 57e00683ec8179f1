"""Quality by a regularised quadratic discriminant over document statistics.

Each text becomes a vector of statistics (lengths, shares of character classes, repetition, line shapes), moved
towards normal by logarithms and arc sines.  Spark sums the moments of the labelled, not held-out rows per class;
the driver only sees those sums.  Each class covariance is shrunk towards the pooled one and its diagonal, its
Cholesky factor is kept, and a score is the logistic of the difference of the log densities, which are Mahalanobis
distances under the factors.

Nulls: a null text is empty, null or other labels than 0 and 1 are ignored, rows with a null doc_id are scored
but not learned.  Repeated labels count each.  Without labels of both kinds all scores are the smoothed share of
label 1.  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .common import held_out, small_batches, texts

SHRINK_POOLED = 0.05
SHRINK_DIAGONAL = 0.02
THRESHOLD = 0.3
#: No statistic may add more than this many standard deviations to a distance.
CLIP = 8.0

#: Byte classes whose shares are statistics.
CLASSES = {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "stop": b".?",
    "comma": b",;:", "exclaim": b"!", "pipe": b"|", "quote": b"\"'()-", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "wide": range(128, 256),
}
MASKS = np.array([[b in c for b in range(256)] for c in CLASSES.values()], float)
NAMES = ("log_chars", "log_words", "log_lines", "mean_word", "spread_word", "longest_word", "words_per_line", "line_spread",
         *CLASSES, "upper_words", "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "short_lines", "ends_with_stop",
         "capital_lines", "plain_words")
PLAIN = re.compile(r"[^\W\d_]+[.,;:!?]?")


def share(part: float, whole: float) -> float:
    """Arc sine of the root: an even spread near 0 and 1."""
    return float(np.arcsin(np.sqrt(min(1.0, part / whole)))) if whole else 0.0


def statistics(text: str) -> list[float]:
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    words, lines = text.split(), text.split("\n")
    lengths = np.array([len(w) for w in words] or [0], float)
    line_words = np.array([len(x.split()) for x in lines], float)
    n, m = len(words), len(lines)
    counts = Counter(words)
    return [
        np.log1p(len(text)), np.log1p(n), np.log1p(m), np.log1p(lengths.mean()), np.log1p(lengths.std()), np.log1p(lengths.max()),
        np.log1p(line_words.mean()), np.log1p(line_words.std()),
        *(share(k, raw.sum()) for k in (MASKS @ raw).tolist()),
        share(sum(map(str.isupper, words)), n), share(len(counts), n), share(max(counts.values(), default=0), n),
        share(sum(map(eq, words, words[1:])), n), share(m - len(set(lines)), m), share(float((line_words <= 2).sum()), m),
        share(sum(x.rstrip().endswith((".", "!", "?")) for x in lines), m), share(sum(x[:1].isupper() for x in lines), m),
        share(sum(bool(PLAIN.fullmatch(w)) * c for w, c in counts.items()), n),
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([statistics(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))],
                                             names=["doc_id", "x"])

    return texts(docs).mapInArrow(run, "doc_id long, x array<double>")


def moments(stats: DataFrame, labels: DataFrame, column: str = "quality") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and sums of products per class; (2,), (2, d), (2, d, d)."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter(~held_out())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(NAMES)
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            label = b.column("label").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            for k in (0, 1):
                mine = x[label == k]
                total[k] += np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
        for k in np.flatnonzero(total[:, 0]).tolist():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], k, np.int32)), pa.array(np.arange(total.shape[1], dtype=np.int32)), pa.array(total[k])],
                                             names=["label", "cell", "value"])

    rows = stats.join(known, "doc_id").select("label", "x").mapInArrow(run, "label int, cell int, value double")
    d = len(NAMES)
    total = np.zeros((2, 1 + d + d * d))
    for r in rows.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        total[r.label, r.cell] = r.value
    return total[:, 0], total[:, 1:1 + d], total[:, 1 + d:].reshape(2, d, d)


def fit(n: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled_share: float = SHRINK_POOLED,
        diagonal_share: float = SHRINK_DIAGONAL) -> dict:
    """Means, inverse Cholesky factors, log determinants and the prior log odds of label 1."""
    odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) < 2:
        return {"odds": odds}
    means = sums / n[:, None]
    own = products / n[:, None, None] - means[:, :, None] * means[:, None, :]
    pooled = (own * n[:, None, None]).sum(0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    factors, dets = [], []
    for k in (0, 1):
        cov = (1 - pooled_share) * own[k] + pooled_share * pooled
        cov = (1 - diagonal_share) * cov + diagonal_share * np.diag(np.maximum(np.diag(cov), 0)) + 1e-3 * np.diag(scale ** 2)
        factor = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(factor))
        dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return {"odds": odds, "means": means, "factors": np.array(factors), "dets": np.array(dets), "scale": scale}


def log_odds(x: np.ndarray, model: dict) -> np.ndarray:
    if "means" not in model:
        return np.full(len(x), model["odds"])
    density = []
    for k in (0, 1):
        away = np.clip(x - model["means"][k], -CLIP * model["scale"], CLIP * model["scale"])
        density.append(-(((away @ model["factors"][k].T) ** 2).sum(1) + model["dets"][k]) / 2)
    return model["odds"] + density[1] - density[0]


def score(stats: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted from ``document_statistics``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = log_odds(b.column("x").flatten().to_numpy().reshape(b.num_rows, -1), model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of their labels."""
    small_batches(docs.sparkSession)
    stats = cut_lineage(document_statistics(docs))  # texts are read once
    return score(stats, fit(*moments(stats, labels)))
