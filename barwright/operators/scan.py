"""Recurrences that no window frame can express: exponential means, Wilder smoothing,
running order statistics.

Each recurrence is a small spec.  ``scan`` evaluates any number of them in one grouped pass
over narrow rows, one series per group.  Groups are bars, at most one row per bar of the
calendar.  Longer series go through ``operators.linear``, where the same means are a prefix scan over blocks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.over import Layout
from .linear import ema_in_blocks

__all__ = ["Atr", "Ema", "Macd", "Rsi", "RunningQuantile", "SeededEma", "ema_in_blocks", "scan", "seeded_ema", "wilder"]


@dataclass(frozen=True)
class Ema:
    """Exponential mean; ``adjust=True`` normalises the weights of the available rows."""

    column: str
    out: str
    span: float | None = None
    alpha: float | None = None
    adjust: bool = False
    pad: bool = False

    def outputs(self) -> list[str]:
        return [self.out]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[self.column].ffill() if self.pad else rows[self.column]
        mean = x.ewm(span=self.span, alpha=self.alpha, adjust=self.adjust, min_periods=1).mean()
        return {self.out: mean.to_numpy()}


def _from_first_value(x: np.ndarray) -> int:
    present = np.flatnonzero(~np.isnan(x))
    return int(present[0]) if present.size else len(x)


def _recur(x: np.ndarray, start: int, seed: float, take: float) -> np.ndarray:
    """Values from ``start`` on of y = (1 - take)*y' + take*x with y[start] = seed: an unadjusted
    exponential mean of the seed and the later values.  A missing value ends it."""
    out = np.full(len(x), np.nan)
    later = np.concatenate([[seed], x[start + 1:]])
    gap = np.flatnonzero(np.isnan(later))
    later = later[:gap[0]] if gap.size else later
    if later.size:
        out[start:start + len(later)] = pd.Series(later).ewm(alpha=take, adjust=False).mean().to_numpy()
    return out


def seeded_ema(x: np.ndarray, period: int, first: int | None = None) -> np.ndarray:
    """EMA seeded with the simple mean of the ``period`` values that end at ``first``."""
    at = _from_first_value(x) + period - 1 if first is None else first
    if at >= len(x):
        return np.full(len(x), np.nan)
    k = 2.0 / (period + 1)
    return _recur(x, at, float(np.mean(x[at - period + 1 : at + 1])), k)


def wilder(x: np.ndarray, period: int, first: int) -> np.ndarray:
    """Wilder mean seeded with the simple mean of the ``period`` values ending at ``first``."""
    if first >= len(x):
        return np.full(len(x), np.nan)
    seed = float(np.mean(x[first - period + 1 : first + 1]))
    return _recur(x, first, seed, 1.0 / period)


@dataclass(frozen=True)
class SeededEma:
    column: str
    out: str
    period: int

    def outputs(self) -> list[str]:
        return [self.out]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        return {self.out: seeded_ema(rows[self.column].to_numpy(float), self.period)}


@dataclass(frozen=True)
class Macd:
    """Fast line, signal and histogram.  The fast mean is seeded where the slow one starts,
    and nothing is reported before the signal exists."""

    column: str
    prefix: str = "MACD"
    fast: int = 12
    slow: int = 26
    signal: int = 9

    def outputs(self) -> list[str]:
        return [self.prefix, f"{self.prefix}_signal", f"{self.prefix}_hist"]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[self.column].to_numpy(float)
        start = _from_first_value(x) + self.slow - 1
        line = seeded_ema(x, self.fast, start) - seeded_ema(x, self.slow, start)
        signal = seeded_ema(line, self.signal, start + self.signal - 1)
        line = np.where(np.isnan(signal), np.nan, line)
        return dict(zip(self.outputs(), (line, signal, line - signal)))


@dataclass(frozen=True)
class Rsi:
    """Relative strength with Wilder smoothing; a motionless series reads 0."""

    column: str
    out: str = "RSI"
    period: int = 14

    def outputs(self) -> list[str]:
        return [self.out]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[self.column].to_numpy(float)
        at = _from_first_value(x) + self.period
        change = np.diff(x, prepend=np.nan)
        up, down = (wilder(np.where(s * change > 0, s * change, change * 0.0), self.period, at) for s in (1.0, -1.0))
        total = up + down
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.where(total == 0.0, 0.0, 100.0 * up / total)
        return {self.out: np.where(np.isnan(total), np.nan, value)}


@dataclass(frozen=True)
class Atr:
    """Average true range, Wilder smoothing."""

    high: str
    low: str
    close: str
    out: str
    period: int

    def outputs(self) -> list[str]:
        return [self.out]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        high, low = rows[self.high].to_numpy(float), rows[self.low].to_numpy(float)
        before = rows[self.close].shift(1).to_numpy(float)
        span = np.maximum(high - low, np.maximum(np.abs(high - before), np.abs(low - before)))
        return {self.out: wilder(span, self.period, _from_first_value(span) + self.period - 1)}


@dataclass(frozen=True)
class RunningQuantile:
    """Quantile of everything so far (``window=None``) or of the last ``window`` rows."""

    column: str
    out: str
    q: float
    need: int
    window: int | None = None

    def outputs(self) -> list[str]:
        return [self.out]

    def run(self, rows: pd.DataFrame) -> dict[str, np.ndarray]:
        x = rows[self.column]
        frame = x.expanding(self.need) if self.window is None else x.rolling(self.window, min_periods=self.need)
        return {self.out: frame.quantile(self.q).to_numpy()}


def scan(df: DataFrame, ly: Layout, specs: Sequence) -> DataFrame:
    """Add the spec outputs.  Run it before the wide window layers so the rows are narrow."""
    added = [name for s in specs for name in s.outputs()]
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType(kept + [T.StructField(n, T.DoubleType()) for n in added])
    names, order = [f.name for f in kept], list(ly.order)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable", ignore_index=True)
        results = {}
        for spec in specs:
            results.update(spec.run(rows))
        out = rows[names].copy()
        for name in added:
            values = np.asarray(results[name], dtype="float64")
            out[name] = pd.array(np.where(np.isnan(values), 0.0, values), dtype="Float64")
            out.loc[np.isnan(values), name] = pd.NA
        return out

    return df.groupBy(*ly.keys).applyInPandas(run, schema)
