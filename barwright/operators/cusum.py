"""Cumulative-sum change detection and other ordered replays.

The samplers reset themselves, so each row depends on the whole past.  Rows are exchanged by
series, sorted, and streamed through a small kernel that keeps only the running sums and jumps from
fire to fire (``operators.jumps``): memory does not grow with the series.  For a series too long for one task,
``cusum_in_blocks`` splits it: an incoming sum is either cleared, fired or merely shifted, so a block's effect on it
is a short table, and only those tables are chained.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..functions.over import Layout
from ..functions.scalar import dbl, flag
from ..session import cut_lineage
from .blocks import in_blocks
from .fit import with_quantiles
from .jumps import after_block, block_effect, either, upward


def replay(
    df: DataFrame, ly: Layout, inputs: Sequence[str], outputs: Sequence[str],
    start: Callable[[], list], kernel: Callable[..., np.ndarray],
) -> DataFrame:
    """Stream each series in order through ``kernel(state, *inputs) -> flags``, a stretch of rows at a time.

    ``kernel`` gets arrays, mutates ``state`` (a short list of numbers) and returns a column per output.
    """
    fields = [f for f in df.schema.fields if f.name not in outputs]
    schema = T.StructType(fields + [T.StructField(o, T.IntegerType()) for o in outputs])
    names, keys = [f.name for f in fields], list(ly.keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, start()
        for rows in batches:
            if rows.empty:
                continue
            out = np.zeros((len(rows), len(outputs)), dtype="int32")
            values = rows[list(inputs)].to_numpy(float)
            ids = rows[keys]
            begins = np.flatnonzero((ids != ids.shift()).any(axis=1).to_numpy() | (np.arange(len(rows)) == 0))
            for a, z in zip(begins, [*begins[1:], len(rows)]):
                key = tuple(ids.iloc[a])
                if key != current:
                    current, state = key, start()
                out[a:z] = kernel(state, *values[a:z].T).reshape(z - a, len(outputs))
            result = rows[names].copy()
            for j, name in enumerate(outputs):
                result[name] = out[:, j]
            yield result

    return df.repartition(*keys).sortWithinPartitions(*keys, *ly.order).mapInPandas(run, schema)


def both_sides(state: list, steps: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Fires of the sum upwards and of the one downwards; for a limit that is not negative the two never fire together."""
    up, state[0] = upward(steps, limit, state[0])
    down, state[1] = upward(-steps, limit, state[1])
    return np.stack([up, down], axis=1)


def cusum_flags_resetting(df: DataFrame, ly: Layout, column: str, threshold: float) -> DataFrame:
    """Up/down flags of the sums of (x - series mean); only the side that fired resets."""
    if threshold < 0:
        raise ValueError("threshold must not be negative")
    centred = df.withColumn("_dev", dbl(column) - F.avg(dbl(column)).over(ly.whole()))
    outputs = [f"{column}_cusum_up_flag", f"{column}_cusum_down_flag"]
    kernel = lambda state, dev: both_sides(state, dev, np.full(len(dev), float(threshold)))
    return replay(centred, ly, ["_dev"], outputs, lambda: [0.0, 0.0], kernel).drop("_dev")


def add_cusum_flags(df: DataFrame, ly: Layout, thresholds: Mapping[str, float]) -> DataFrame:
    for column, threshold in thresholds.items():
        if column in df.columns:
            df = cusum_flags_resetting(df, ly, column, threshold)
    return df


def cusum_events(df: DataFrame, ly: Layout, column: str, quantile: float) -> DataFrame:
    """Rows where a one-sided sum of differences passes the ``quantile`` of |difference|."""
    moved = df.withColumn("_d", ly.diff(dbl(column)))
    moved = moved.withColumn("_limit", F.percentile(F.abs("_d"), F.lit(quantile)).over(ly.whole()))

    kernel = lambda state, d, limit: both_sides(state, d, limit).any(axis=1)  # the first row has no difference
    found = replay(moved, ly, ["_d", "_limit"], ["_event"], lambda: [0.0, 0.0], kernel)
    return found.filter("_event = 1").drop("_d", "_limit", "_event")


def cusum_events_adaptive(
    df: DataFrame, ly: Layout, column: str = "price", base: float = 0.01, factor: float = 0.5, window: int = 50
) -> DataFrame:
    """Sampler whose threshold follows volatility; both sums reset; the first row is kept."""
    padded = df.withColumn("_p", ly.ffill(dbl(column)))
    moved = padded.withColumns({"_r": ly.pct_change("_p"), "_d": ly.diff(dbl(column))})
    limited = moved.withColumn(
        "threshold", F.lit(base) + F.lit(factor) * F.coalesce(ly.std("_r", window), F.lit(0.0))
    )

    def kernel(state: list, d: np.ndarray, limit: np.ndarray) -> np.ndarray:
        first = int(not state[2])  # kept without a look at the sums
        fires, state[0], state[1] = either(d[first:], limit[first:], state[0], state[1])
        state[2] = 1
        return np.concatenate([np.ones(first, bool), fires])

    kept = replay(limited, ly, ["_d", "threshold"], ["_event"], lambda: [0.0, 0.0, 0], kernel)
    return kept.filter("_event = 1").drop("_p", "_r", "_d", "_event")


def latch(
    df: DataFrame, ly: Layout, column: str, out: str, enter: float, leave: float, mode: str = "high"
) -> DataFrame:
    """Two-threshold switch.  Ordinary thresholds use the window form; crossed ones replay."""
    beyond = enter > leave if mode == "high" else enter < leave
    if beyond:
        return df.withColumn(out, ly.latch(dbl(column), enter, leave, mode))
    sign = 1.0 if mode == "high" else -1.0

    def kernel(state: list, v: np.ndarray) -> np.ndarray:
        """Beyond both levels a reading decides, between crossed ones it flips the switch."""
        on, off = sign * v >= sign * enter, sign * v <= sign * leave
        decides = np.flatnonzero(on != off)
        flips = np.concatenate([[0], np.cumsum(on & off)])
        last = np.searchsorted(decides, np.arange(len(v)), side="right") - 1  # the latest decision up to a row
        known = last >= 0
        base, since = np.full(len(v), int(state[0])), flips[1:].copy()
        base[known] = on[decides[last[known]]]
        since[known] -= flips[decides[last[known]] + 1]
        now = (base + since) % 2
        state[0] = int(now[-1])
        return now

    return replay(df, ly, [column], [out], lambda: [0], kernel)


def drift_flags(ly: Layout, x, mean, limit) -> tuple[Column, Column]:
    """Run-sum flags against a moving mean and limit.

    The sums only ever collect excursions that already exceed the limit on their own row, so
    the flags equal a comparison on that row and need no state.
    """
    x = dbl(x)
    return flag(x - mean > limit), flag(mean - x > limit)


# ---- one long series -------------------------------------------------------

def cusum_in_blocks(
    df: DataFrame, series: Sequence[str], deviation: str, threshold: float | str,
    up: str, down: str, row: str = "row_index", block_rows: int = 4096,
) -> DataFrame:
    """Resetting sums of ``deviation`` (no missing values) for a series of any length.

    The two sides never interact for a non-negative threshold.  For one side a block maps an
    incoming sum s to: the block's own outcome from 0 when s was cleared or fired on the way,
    or s plus a shift.  Where that happens depends on the new lows and highs of the block's running total.

    ``threshold`` may name a column that is constant in a series; where it is NULL nothing fires.
    """
    if not isinstance(threshold, str) and threshold < 0:
        raise ValueError("threshold must not be negative")
    bar = F.coalesce(F.col(threshold), F.lit(float("inf"))) if isinstance(threshold, str) else F.lit(float(threshold))
    keyed = df.withColumns({"_block": F.floor(F.col(row) / F.lit(block_rows)).cast("long"), "_bar": bar.cast("double")})
    names = [*series, "_block"]
    sides = {"u": 1.0, "d": -1.0}
    parts = ("low", "low_at", "low_end", "high", "high_at", "high_end", "total")
    fields = [keyed.schema[n] for n in names]
    summary_schema = T.StructType(fields + [keyed.schema["_bar"]] + [T.StructField(f"{s}_{p}", T.ArrayType(T.DoubleType())) for s in sides for p in parts])

    def summarise(rows: pd.DataFrame) -> pd.DataFrame:
        steps, limit = rows.sort_values(row)[deviation].to_numpy(float), float(rows["_bar"].iloc[0])
        record = {n: rows[n].iloc[0] for n in (*names, "_bar")}
        for s, sign in sides.items():
            record |= {f"{s}_{p}": v for p, v in block_effect(sign * steps, limit).items()}
        return pd.DataFrame([record])

    summary = keyed.select(*names, row, deviation, "_bar").groupBy(*names).applyInPandas(summarise, summary_schema)
    carry_schema = T.StructType(fields + [T.StructField(f"_{s}", T.DoubleType()) for s in sides])

    def chain(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block", ignore_index=True)
        result, limit = blocks[names].copy(), float(blocks["_bar"].iloc[0])
        for s in sides:
            entering, carried = 0.0, []
            for effect in blocks[[f"{s}_{p}" for p in parts]].itertuples(index=False):
                carried.append(entering)
                entering = after_block(dict(zip(parts, effect)), entering, limit)
            result[f"_{s}"] = carried
        return result

    carry = summary.groupBy(*series).applyInPandas(chain, carry_schema)
    kept = [f for f in df.schema.fields if f.name not in (up, down)]
    out_schema = T.StructType(kept + [T.StructField(up, T.IntegerType()), T.StructField(down, T.IntegerType())])

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(row, ignore_index=True)
        result, steps, limit = rows[[f.name for f in kept]].copy(), rows[deviation].to_numpy(float), float(rows["_bar"].iloc[0])
        for (s, sign), name in zip(sides.items(), (up, down)):
            result[name] = upward(sign * steps, np.full(len(steps), limit), float(rows[f"_{s}"].iloc[0]))[0].astype("int32")
        return result

    return keyed.join(carry, names).groupBy(*names).applyInPandas(finish, out_schema)


def cusum_events_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, quantile: float, row: str = "row_index", block_rows: int = 4096,
) -> DataFrame:
    """``cusum_events`` for series of any length (no missing values); the limit of a series comes from an exact quantile
    without a series in one task."""
    moved = cut_lineage(in_blocks(df, series, row, lambda d, ly: d.withColumn("_d", ly.diff(dbl(column))), 1, 0, block_rows))
    x = with_quantiles(moved, series, {"move": F.abs(F.col("_d"))}, {"limit": quantile})
    x = x.withColumns({"_limit": F.col("_q_move.limit"), "_step": F.coalesce("_d", F.lit(0.0))}).drop("_q_move", "_d")
    found = cusum_in_blocks(x, series, "_step", "_limit", "_up", "_down", row, block_rows)
    return found.filter("_up = 1 OR _down = 1").drop("_step", "_limit", "_up", "_down")
