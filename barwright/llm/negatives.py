"""Hard negatives by segment summaries.

Every vector is cut into segments of equal length, and each segment keeps its mean and its deviation (the norm of what
is left without the mean).  The inner product of two segments is the product of their means, times the length, plus at
most and minus at most the product of their deviations, so sums over segments bound a score from both sides.  Segments
of 16 components are looked at first, then those of 4, and only pairs that both bounds leave open are scored exactly.

Anchors are a stated query set and meet all rows in blocks: anchors are dealt into blocks, rows into slices, and every
(block, slice) is one group, which keeps the best rows per anchor as it goes; their last one is the bound for what
follows.  Groups hold at most about ``ANCHOR_ROWS`` and ``SLICE_ROWS`` rows whatever labels or ids prevail, and the
best of all slices are merged per anchor.  Nothing is approximate.

1. positives: the ``POSITIVES`` other rows of the anchor's label that score highest;
2. negatives: per positive the ``NEGATIVES`` highest rows of other labels whose score lies in the stated share of the
   positive's.

Nulls: rows with a null vec_id, label or vector, or a component that is null or not finite, take no part.  Vectors of
fewer components are filled with zeros.  Rows that repeat a vec_id are one row, that with the largest label and vector.
Ties go to the smaller vec_id.  A positive of a negative score has no negatives.  An empty table gives an empty result;
extra columns are not read.  Scores beyond 2^53 are added as Python integers; they must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import batch

POSITIVES, NEGATIVES = 5, 3
#: Bounds of a negative's score as percent of the positive's.
LEAST, MOST = 50, 95
EVERY = 50
SLICE_ROWS, ANCHOR_ROWS = 8192, 16384
#: Segment lengths, coarse to fine.
SEGMENTS = (16, 4)
#: Anchors and rows of a tile, and the share of open pairs above which a tile is multiplied whole.
TILE = (512, 2048)
WHOLE = 0.125
NONE = -np.inf
EXACT = 2.0 ** 53


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v are the components' integers."""
    x = F.col("embedding")
    kept = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    each = kept.select(F.col("vec_id").cast("long").alias("vec_id"), shifted.cast("long").alias("label"),
                       F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double"))).alias("v"))
    return each.groupBy("vec_id").agg(F.max(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows of doubles, filled with zeros up to ``width``."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    out[owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(lists.flatten(), float)
    return out


class Side:
    """Vectors with the scaled means and deviations of their segments, per level."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.levels = vectors, []
        for length in SEGMENTS:
            x = vectors.reshape(len(vectors), -1, length)
            mean = x.mean(axis=2)
            rest = np.sqrt(np.maximum(0.0, ((x - mean[:, :, None]) ** 2).sum(axis=2)))
            self.levels.append((mean * np.sqrt(length), rest))
        self.norm = float(np.sqrt((vectors ** 2).sum(axis=1)).max()) if len(vectors) else 0.0

    def part(self, a: int, z: int) -> Side:
        """Rows a to z; the largest norm stays an upper bound."""
        out = object.__new__(Side)
        out.vectors, out.levels, out.norm = self.vectors[a:z], [(m[a:z], r[a:z]) for m, r in self.levels], self.norm
        return out


def products(a: np.ndarray, b: np.ndarray, at: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """All inner products, or those of the pairs ``at``."""
    return a @ b.T if at is None else np.einsum("ij,ij->i", a[at[0]], b[at[1]])


def open_pairs(a: Side, b: Side, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which allowed pairs may score between their row's bounds, after both levels."""
    slack = 1e-9 * a.norm * b.norm + 1e-6
    for (mean_a, rest_a), (mean_b, rest_b) in zip(a.levels, b.levels, strict=True):
        at = None if allowed.mean() > WHOLE else np.nonzero(allowed)
        middle, reach = products(mean_a, mean_b, at), products(rest_a, rest_b, at) + slack
        low, high = (least[:, None], most[:, None]) if at is None else (least[at[0]], most[at[0]])
        fits = (middle + reach >= low) & (middle - reach <= high)
        if at is None:
            allowed &= fits
        else:
            allowed[at] = fits
        if not allowed.any():
            break
    return allowed


def exact(a: Side, b: Side, at: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """Integer scores of the pairs ``at``, as doubles where these are exact."""
    if a.norm * b.norm >= EXACT:
        return np.array([sum(int(x) * int(y) for x, y in zip(a.vectors[i], b.vectors[j], strict=True))
                         for i, j in zip(*at, strict=True)], object)
    return products(a.vectors, b.vectors, None)[at] if share > WHOLE else products(a.vectors, b.vectors, at)


class Best:
    """The highest ``k`` (score, id) per query, ties by smaller id."""

    def __init__(self, queries: int, k: int):
        self.k, self.query = k, np.zeros(0, np.int64)
        self.score: np.ndarray = np.zeros(0)
        self.ids = np.zeros(0, np.int64)
        self.last = np.full(queries, NONE)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        enough = score >= self.last[query]
        query, score, ids = (np.concatenate([x, y[enough]]) for x, y in ((self.query, query), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        begin = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])[:len(query)])
        rank = np.arange(len(query)) - np.repeat(begin, np.diff(np.append(begin, len(query))))
        kept = rank < self.k
        full = rank == self.k - 1
        self.last[query[full]] = score[full]
        self.query, self.score, self.ids = query[kept], score[kept], ids[kept]


def tiles(anchors: int, rows: int) -> Iterator[tuple[int, int, int, int]]:
    for a in range(0, anchors, TILE[0]):
        for r in range(0, rows, TILE[1]):
            yield a, min(a + TILE[0], anchors), r, min(r + TILE[1], rows)


def padded(*columns) -> int:
    """A width that holds all vectors and whole segments."""
    sizes = [len(v) for c in columns for v in c.to_pylist()] or [1]
    return -(-max(1, *sizes) // max(SEGMENTS)) * max(SEGMENTS)


def meet(anchors: pa.Table, rows: pa.Table, k: int, same: bool, lows: np.ndarray, highs: np.ndarray) -> Best:
    """Best rows per query between its bounds; ``lows`` and ``highs`` have a line per anchor, a column per query."""
    width = padded(anchors.column("v"), rows.column("v"))
    a, b = Side(matrix(anchors.column("v"), width)), Side(matrix(rows.column("v"), width))
    ids, its = np.asarray(anchors.column("vec_id")), np.asarray(rows.column("vec_id"))
    label, other = np.asarray(anchors.column("label")), np.asarray(rows.column("label"))
    per = lows.shape[1]
    best = Best(lows.size, k)
    for i, j, r, s in tiles(len(ids), len(its)):
        allowed = (label[i:j, None] == other[None, r:s]) == same
        allowed &= ids[i:j, None] != its[None, r:s]
        bars = np.maximum(lows[i:j], best.last.reshape(-1, per)[i:j])  # what a query still takes
        open_ = open_pairs(a.part(i, j), b.part(r, s), allowed, bars.min(axis=1), highs[i:j].max(axis=1))
        at = np.nonzero(open_)
        if not len(at[0]):
            continue
        score = exact(a.part(i, j), b.part(r, s), at, open_.mean())
        for q in range(per):
            fits = (score >= bars[at[0], q]) & (score <= highs[i:j][at[0], q])
            best.add((at[0][fits] + i) * per + q, score[fits], its[r:s][at[1][fits]])
    return best


FOUND = "anchor_id long, query int, score long, vec_id long"


def find(anchors: DataFrame, rows: DataFrame, k: int, same: bool) -> DataFrame:
    """Per anchor and query the best ``k`` rows of every slice, then of all.

    ``anchors`` have lows and highs, arrays with the bounds of each query."""
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table(batch({n: ([], t) for n, t in (("anchor_id", pa.int64()), ("query", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()))}).columns,
                            names=["anchor_id", "query", "score", "vec_id"])
        per = max(1, *(len(x) for x in left.column("lows").to_pylist()))
        lows = np.full((left.num_rows, per), np.inf)
        highs = np.full((left.num_rows, per), -np.inf)
        for i, (x, y) in enumerate(zip(left.column("lows").to_pylist(), left.column("highs").to_pylist(), strict=True)):
            lows[i, :len(x)], highs[i, :len(y)] = x, y
        best = meet(left, right, k, same, lows, highs)
        return pa.table({"anchor_id": pa.array(np.asarray(left.column("vec_id"))[best.query // per], pa.int64()),
                         "query": pa.array(best.query % per, pa.int32()),
                         "score": pa.array([int(x) for x in best.score], pa.int64()), "vec_id": pa.array(best.ids, pa.int64())})

    n = rows.count()
    slices, blocks = -(-max(n, 1) // SLICE_ROWS), -(-max(anchors.count(), 1) // ANCHOR_ROWS)
    cell = ["block", "slice"]
    left = anchors.withColumn("block", _dealt(blocks, 1)).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    right = rows.select(*[F.col(c).alias(c) for c in rows.columns]).withColumn("slice", _dealt(slices, 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    parts = slices * blocks
    met = left.repartition(parts, *cell).groupBy(*cell).cogroup(right.repartition(parts, *cell).groupBy(*cell)).applyInArrow(run, FOUND)
    first = F.row_number().over(Window.partitionBy("anchor_id", "query").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", first).filter(F.col("rank") <= k)


def _dealt(n: int, seed: int) -> Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")


def _percent(x: Column) -> Column:
    """A hundredth, rounded down in integers."""
    return (x - F.pmod(x, F.lit(100))) / F.lit(100)


def hard_negatives(embeddings: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, every: int = EVERY,
                   least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = cut_lineage(quantised(embeddings))
    anchors = rows.filter(F.col("vec_id") % every == 0)
    any_score = F.array(F.lit(-float("inf"))), F.array(F.lit(float("inf")))
    near = find(anchors.withColumns({"lows": any_score[0], "highs": any_score[1]}), rows, positives, same=True)
    near = cut_lineage(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("query")))
    listed = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("query", "positive_score"))).alias("p"))
    low = F.transform("p", lambda x: -_percent(-x.positive_score * least))
    high = F.transform("p", lambda x: _percent(x.positive_score * most))
    far = find(anchors.join(listed, "vec_id").withColumns({"lows": low, "highs": high}).drop("p"), rows, negatives, same=False)
    far = far.select("anchor_id", "query", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return far.join(near, ["anchor_id", "query"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


SQL = f"""
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER g::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
WINDOW g AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER g <= {NEGATIVES}
"""
