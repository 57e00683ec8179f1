"""Ordered-window expressions over a :class:`Layout`.

A layout names the partition keys and the ordering columns.  On hourly bars the keys are
the series columns: rows are unique per (series, bar), so one partition holds at most the
number of bars in the calendar (ten years of hours is about 88k rows) however many trades
went into them.  For longer inputs ``operators.blocks`` adds a block number to the keys and
the very same expressions run block by block.

Every expression built on one layout shares partitioning and sort order, so Spark plans one
exchange and one sort for a whole layer of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from itertools import accumulate, count, takewhile
from operator import mul

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from .scalar import col, dbl, flag, ratio, sign


class _Pending:
    """Window expressions waiting to become columns, each distinct one once."""

    def __init__(self) -> None:
        self.columns: dict[tuple, tuple[str, Column]] = {}
        self.specs: dict[tuple, WindowSpec] = {}

    def reference(self, key: tuple, build: Callable[[], Column]) -> Column:
        if key not in self.columns:
            self.columns[key] = (f"__w{len(self.columns)}", build())
        return F.col(self.columns[key][0])


@dataclass(frozen=True)
class Layout:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    pending: _Pending | None = field(default=None, compare=False, repr=False)

    @staticmethod
    def of(keys: str | Iterable[str], order: str | Iterable[str]) -> "Layout":
        as_tuple = lambda v: (v,) if isinstance(v, str) else tuple(v)
        return Layout(as_tuple(keys), as_tuple(order))

    # ---- layers -------------------------------------------------------
    def layered(self) -> "Layout":
        """A layout whose window expressions are shared inside a layer.

        A formula that mentions one window several times would otherwise have Spark evaluate
        it several times.  Use :meth:`add` to turn a layer of formulas into columns.
        """
        return replace(self, pending=_Pending())

    def add(self, df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
        if self.pending is None or not self.pending.columns:
            return df.withColumns(dict(columns)) if columns else df
        shared = dict(self.pending.columns.values())
        self.pending.columns.clear()
        return df.withColumns(shared).withColumns(dict(columns)).drop(*shared)

    def _over(self, key: tuple, args: tuple, build: Callable[[], Column]) -> Column:
        if self.pending is None:
            return build()
        named = tuple(a if isinstance(a, str) else str(a) for a in args)
        return self.pending.reference((*key, *named), build)

    def _spec(self, key: tuple, build: Callable[[], WindowSpec]) -> WindowSpec:
        if self.pending is None:
            return build()
        if key not in self.pending.specs:
            self.pending.specs[key] = build()
        return self.pending.specs[key]

    # ---- window specs -------------------------------------------------
    def ordered(self) -> WindowSpec:
        return self._spec(("ordered",), lambda: Window.partitionBy(*self.keys).orderBy(*self.order))

    def last(self, n: int) -> WindowSpec:
        return self.rows(-n + 1, 0)

    def rows(self, start: int, end: int) -> WindowSpec:
        return self._spec(("rows", start, end), lambda: self.ordered().rowsBetween(start, end))

    def so_far(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)

    def whole(self) -> WindowSpec:
        return self._spec(("whole",), lambda: Window.partitionBy(*self.keys))

    def fold(self, name: str, agg: Callable[..., Column], start: int | None, end: int | None, *args) -> Column:
        """Aggregate over rows ``start..end`` (``None``: the whole series)."""
        window = self.whole() if start is None else self.rows(start, end)
        return self._over((name, start, end), args, lambda: agg(*[col(a) for a in args]).over(window))

    # ---- shifts -------------------------------------------------------
    def lag(self, c, n: int = 1) -> Column:
        return self._over(("lag", n), (c,), lambda: F.lag(col(c), n).over(self.ordered()))

    def lead(self, c, n: int = 1) -> Column:
        return self._over(("lead", n), (c,), lambda: F.lead(col(c), n).over(self.ordered()))

    def row_number(self) -> Column:
        return self._over(("row_number",), (), lambda: F.row_number().over(self.ordered()))

    def diff(self, c, n: int = 1) -> Column:
        return col(c) - self.lag(c, n)

    def pct_change(self, padded, n: int = 1) -> Column:
        """Relative change; pass the forward-filled column (see :meth:`ffill`)."""
        return ratio(col(padded), self.lag(padded, n)) - 1.0

    def log_return(self, c, n: int = 1) -> Column:
        r = ratio(dbl(c), self.lag(c, n))
        return F.when(r > 0, F.ln(r)).when(r == 0, F.lit(float("-inf")))

    def ffill(self, c) -> Column:
        return self.fold("ffill", lambda x: F.last(x, ignorenulls=True), Window.unboundedPreceding, 0, c)

    # ---- rolling ------------------------------------------------------
    def _guarded(self, name: str, agg, c, start: int, end: int, need: int, floor: int = 1) -> Column:
        value = self.fold(name, lambda x: agg(x.cast("double")), start, end, c)
        if need <= floor:
            return value
        return F.when(self.fold("count", F.count, start, end, c) >= need, value)

    def _rolling(self, name: str, agg, c, n: int, need: int | None, floor: int = 1) -> Column:
        return self._guarded(name, agg, c, -n + 1, 0, n if need is None else need, floor)

    def mean(self, c, n: int, need: int | None = None) -> Column:
        return self._rolling("avg", F.avg, c, n, need)

    def mean_of_parts(self, part_sum: str, n: int, part: int) -> Column:
        """Full-window mean over ``n`` rows from a column of full sums over ``part`` rows.

        A frame is re-read for every row, so a 336-row mean costs 336 additions; adding the 14
        lagged 24-row sums costs 14 and shares them with the other multiples of 24.
        """
        if n % part:
            raise ValueError("n must be a multiple of part")
        total = col(part_sum)
        for k in range(part, n, part):
            total = total + self.lag(part_sum, k)
        return total / F.lit(float(n))

    def sum(self, c, n: int, need: int | None = None) -> Column:
        return self._rolling("sum", F.sum, c, n, need)

    def max(self, c, n: int, need: int | None = None) -> Column:
        return self._rolling("max", F.max, c, n, need)

    def min(self, c, n: int, need: int | None = None) -> Column:
        return self._rolling("min", F.min, c, n, need)

    def std(self, c, n: int, need: int | None = None) -> Column:
        """Sample deviation (n - 1)."""
        return self._rolling("std", F.stddev_samp, c, n, need, 2)

    def std_pop(self, c, n: int, need: int | None = None) -> Column:
        return self._rolling("std_pop", F.stddev_pop, c, n, need)

    def std_centered(self, c, n: int) -> Column:
        """Full centred frame; an even width leans one row to the past."""
        before = n // 2
        return self._guarded("std", F.stddev_samp, c, -before, n - before - 1, n, 2)

    def quantile(self, c, q: float, n: int, need: int | None = None) -> Column:
        return self._rolling(f"quantile{q}", lambda x: F.percentile(x, F.lit(q)), c, n, need)

    def median(self, c, n: int, need: int | None = None) -> Column:
        return self.quantile(c, 0.5, n, need)

    def expanding_quantile(self, c, q: float, need: int) -> Column:
        agg = lambda x: F.percentile(x, F.lit(q))
        return self._guarded(f"quantile{q}", agg, c, Window.unboundedPreceding, 0, need)

    def corr(self, a, b, n: int, need: int) -> Column:
        """Pearson correlation over the pairs present in the frame."""
        both = dbl(a).isNotNull() & dbl(b).isNotNull()
        x, y = F.when(both, dbl(a)), F.when(both, dbl(b))
        most = lambda v: self.fold("max", F.max, -n + 1, 0, v)
        least = lambda v: self.fold("min", F.min, -n + 1, 0, v)
        enough = self.fold("count", F.count, -n + 1, 0, x) >= max(need, 2)
        varies = (most(x) > least(x)) & (most(y) > least(y))
        return F.when(enough & varies, self.fold("corr", F.corr, -n + 1, 0, x, y))

    def zscore(self, c, n: int, eps: float = 1e-8) -> Column:
        spread = self.std(c, n)
        return ratio(dbl(c) - self.mean(c, n), spread + F.lit(eps) if eps else spread)

    def count_true(self, cond: Column, n: int, need: int | None = None) -> Column:
        """How many of the last ``n`` rows met the condition (never NULL once full)."""
        return self.sum(flag(cond), n, need)

    def k_of_l(self, cond: Column, k: int, n: int, need: int | None = None) -> Column:
        return flag(self.count_true(cond, n, need) >= k)

    # ---- whole series -------------------------------------------------
    def series_zscore(self, c, eps: float = 1e-8) -> Column:
        x = dbl(c)
        mean, spread = self.fold("avg", F.avg, None, None, x), self.fold("std", F.stddev_samp, None, None, x)
        return (x - mean) / (spread + F.lit(eps))

    # ---- stateful forms that a window can express ---------------------
    def latch(self, x: Column, enter: Column | float, leave: Column | float, mode: str = "high") -> Column:
        """Two-threshold switch; missing values hold the state.

        With ``enter`` strictly beyond ``leave`` the state equals the latest decisive
        reading, so it is a last-non-null window.  Callers with crossed thresholds use
        ``operators.cusum.latch``, which replays the rows in order.
        """
        enter = F.lit(enter) if isinstance(enter, (int, float)) else enter
        leave = F.lit(leave) if isinstance(leave, (int, float)) else leave
        on, off = (x >= enter, x <= leave) if mode == "high" else (x <= enter, x >= leave)
        decisive = F.when(on, F.lit(1)).when(off, F.lit(0))
        return F.coalesce(self.ffill(decisive), F.lit(0))

    def sign_entropy(self, step_sign, n: int) -> Column:
        """Base-2 entropy of the -1/0/+1 mix of the last ``n`` signs."""
        total = F.lit(0.0)
        for s in (-1.0, 0.0, 1.0):
            hits = self.fold("sum", F.sum, -n + 1, 0, (col(step_sign) == s).cast("int"))
            p = hits / F.lit(float(n))
            total = total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))
        return F.when(self.fold("count", F.count, -n + 1, 0, step_sign) >= n, total)

    def frac_diff(self, c, d: float, cutoff: float = 1e-2) -> Column:
        """Fractional difference; rows before the filter is full are 0."""
        weights = frac_weights(d, cutoff)
        x = dbl(c)
        value = sum((self.lag(x, k) * F.lit(w) for k, w in enumerate(weights) if k), x * F.lit(weights[0]))
        full = self.row_number() >= len(weights)
        return F.when(full, value).otherwise(F.lit(0.0))

    def ma_cross(self, gap: Column | str) -> Column:
        """+1 when the gap turns non-negative, -1 when it turns non-positive, else 0."""
        now, before = col(gap), self.lag(gap, 1)
        return F.when((before < 0) & (now >= 0), 1).when((before > 0) & (now <= 0), -1).otherwise(0)

    def step_of_flag(self, indicator: Column) -> Column:
        """First difference of a 0/1 indicator, 0 on the first row."""
        return F.coalesce(indicator - self.lag(indicator), F.lit(0)).cast("int")

    def sign_changed(self, c) -> Column:
        """1 where the sign differs from the row before; a missing side counts as different."""
        now, before = sign(col(c)), sign(self.lag(c, 1))
        return F.when(now.isNotNull() & before.isNotNull() & (now == before), 0).otherwise(1)


def frac_weights(d: float, cutoff: float) -> list[float]:
    """Coefficients of the series of (1 - L)^d, newest first, up to where they first fall below ``cutoff``.

    The k-th is (-1)^k times the generalised binomial coefficient of d over k, a product of the k
    factors (j - 1 - d) / j.
    """
    factors = ((j - 1 - d) / j for j in count(1))
    return list(takewhile(lambda w: abs(w) >= cutoff, accumulate(factors, mul, initial=1.0)))


def log_clipped(c: Column) -> Column:
    """``ln(max(x, 1))``"""
    return F.when(col(c).isNotNull(), F.ln(F.greatest(dbl(c), F.lit(1.0))))
