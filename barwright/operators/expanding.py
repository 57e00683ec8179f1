"""Running quantiles of everything so far, for series of any length.

A running quantile needs order statistics of the whole past.  Values are put into buckets between approximate quantiles of
their series.  Counts per block of rows and bucket, summed over the blocks before, tell in which bucket the wanted ranks
of every row of a block lie; a block then asks for the earlier values of those buckets only, usually one or two of
``BUCKETS``, as distinct values with counts.  A task holds one block of rows, its counts, and what it asked for.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.scalar import dbl
from ..session import cut_lineage

BUCKETS = 256


def _ranks(buckets: np.ndarray, before: np.ndarray, q: float, need: int) -> tuple[np.ndarray, ...]:
    """Per row: number of values so far, lower rank, share of the upper one, and for both ranks the bucket and the rank in it.

    ``buckets`` is -1 for a missing value; rows with too few values have the bucket -1."""
    known = buckets >= 0
    steps = np.zeros((len(buckets), len(before)), np.int64)
    steps[np.flatnonzero(known), buckets[known]] = 1
    upto = np.cumsum(before + np.cumsum(steps, axis=0), axis=1)
    n = upto[:, -1] if len(before) else np.zeros(len(buckets), np.int64)
    place = q * (n - 1)
    low = np.maximum(np.floor(place).astype(np.int64), 0)
    high = np.minimum(low + 1, np.maximum(n - 1, 0))
    enough, found = n >= max(need, 1), []
    for rank in (low, high):
        at = np.argmax(upto > rank[:, None], axis=1)
        inside = rank - np.where(at > 0, upto[np.arange(len(at)), np.maximum(at - 1, 0)], 0)
        found += [np.where(enough, at, -1), inside]
    return (place - low, *found)


class Held:
    """One bucket's earlier values, distinct with counts, and the block's own so far, sorted."""

    def __init__(self, values: Sequence[float] = (), counts: Sequence[int] = ()):
        self.values, self.upto, self.own = list(values), np.cumsum(counts, dtype=np.int64), []
        self.total = int(self.upto[-1]) if len(self.upto) else 0

    def earlier(self, k: int) -> float:
        return self.values[int(np.searchsorted(self.upto, k, side="right"))]

    def at(self, k: int) -> float:
        """The value of 0-based rank ``k`` among both."""
        low, high = max(0, k - self.total), min(len(self.own), k)
        while low < high:  # how many of the own ones stand before it
            mid = (low + high) // 2
            if self.own[mid] < self.earlier(k - mid - 1):
                low = mid + 1
            else:
                high = mid
        found = ([self.own[low]] if low < len(self.own) else []) + ([self.earlier(k - low)] if k - low < self.total else [])
        return min(found)


def expanding_quantile_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, out: str, q: float, need: int, row: str = "row_index", block_rows: int = 4096,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Interpolated quantile of the non-missing values up to each row, NULL while there are fewer than ``need``.

    ``row`` is the dense row index; the result does not depend on ``block_rows``.
    """
    names = [*series, "_block"]
    edges = df.groupBy(*series).agg(F.percentile_approx(dbl(column), [i / buckets for i in range(1, buckets)], 10_000).alias("_edges"))
    keyed = df.join(edges, list(series)).withColumn("_block", F.floor(F.col(row) / F.lit(block_rows)).cast("long")).withColumn(
        "_bucket", F.when(dbl(column).isNotNull(), F.size(F.filter("_edges", lambda e: e < dbl(column)))).otherwise(F.lit(-1))).drop("_edges")
    keyed = cut_lineage(keyed)
    # Counts of all buckets before each block.
    present = keyed.filter("_bucket >= 0")
    counts = present.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    grid = keyed.select(*names).distinct().withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    earlier = Window.partitionBy(*series, "_bucket").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summed = grid.join(counts, [*names, "_bucket"], "left").withColumn("_n", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = cut_lineage(summed.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("_bucket", "_n"))).alias("_b")).select(
        *names, F.transform("_b", lambda b: b["_n"]).alias("_before")))
    keys = [keyed.schema[n] for n in names]
    ask_schema = T.StructType([*keys, T.StructField("_bucket", T.IntegerType())])

    def ask(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row)  # both sides have the same blocks
        _, low, _, high, _ = _ranks(rows["_bucket"].to_numpy(), np.array(held["_before"].iloc[0], np.int64), q, need)
        wanted = np.unique(np.concatenate([low, high]))
        wanted = wanted[wanted >= 0]
        return rows.iloc[np.zeros(len(wanted), int)][names].assign(_bucket=wanted.astype("int32"))

    # Own names for the second side of a pair of grouped tables that come from one.
    apart = lambda t: t.select(*[F.col(c).alias(c) for c in t.columns])
    asked = keyed.select(*names, row, "_bucket").groupBy(*names).cogroup(apart(before).groupBy(*names)).applyInPandas(ask, ask_schema)
    values = present.groupBy(*series, "_bucket", F.col("_block").alias("_of"), dbl(column).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    given = asked.join(values, [*series, "_bucket"]).filter("_of < _block").groupBy(*names, "_bucket", "_x").agg(F.sum("_n").alias("_n"))
    given = given.groupBy(*names).agg(F.collect_list(F.struct("_bucket", "_x", "_n")).alias("_given"))
    helped = before.join(given, names, "left")
    kept = [f for f in df.schema.fields if f.name != out]
    out_schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])

    def finish(key: tuple, rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row, ignore_index=True)
        bucket, x = rows["_bucket"].to_numpy(), rows[column].to_numpy(float)
        share, low, low_rank, high, high_rank = _ranks(bucket, np.array(held["_before"].iloc[0], np.int64), q, need)
        given = held["_given"].iloc[0]
        lists: dict[int, list] = {}
        for g in sorted([] if given is None else list(given), key=lambda g: g["_x"]):
            lists.setdefault(g["_bucket"], []).append((g["_x"], g["_n"]))
        past = {b: Held(*zip(*pairs)) for b, pairs in lists.items()}
        value = np.full(len(rows), np.nan)
        for i in range(len(rows)):  # insertions and look-ups in a bucket
            if bucket[i] >= 0:
                insort(past.setdefault(int(bucket[i]), Held()).own, x[i])
            if low[i] >= 0:
                a, b = past[int(low[i])].at(int(low_rank[i])), past[int(high[i])].at(int(high_rank[i]))
                value[i] = a + (b - a) * share[i]
        result = rows[[f.name for f in kept]].copy()
        missing = np.isnan(value)
        result[out] = pd.arrays.FloatingArray(np.where(missing, 0.0, value), missing)
        return result

    return keyed.groupBy(*names).cogroup(apart(helped).groupBy(*names)).applyInPandas(finish, out_schema)
