"""SQL text for window expressions of one series layout."""

from __future__ import annotations


def ratio(n: str, d: str) -> str:
    return (f"(CASE WHEN ({d}) = 0 THEN CASE WHEN ({n}) > 0 THEN 'inf'::DOUBLE WHEN ({n}) < 0 THEN '-inf'::DOUBLE END "
            f"ELSE ({n}) / ({d}) END)")


def flag(cond: str) -> str:
    return f"CAST(coalesce(({cond}), false) AS INT)"


def clip(x: str, lo, hi) -> str:
    return f"(CASE WHEN ({x}) IS NOT NULL THEN least(greatest(({x}), {lo}::DOUBLE), {hi}::DOUBLE) END)"


def finite(x: str) -> str:
    return f"(CASE WHEN isfinite({x}) THEN {x} END)"


class Win:
    def __init__(self, key: str, order: str = "date"):
        self.key, self.order = key, order

    def frame(self, rows: str = "") -> str:
        return f"OVER (PARTITION BY {self.key} ORDER BY {self.order} {rows})"

    def rows(self, before, after) -> str:
        a = f"{before} PRECEDING" if before >= 0 else f"{-before} FOLLOWING"
        b = f"{after} FOLLOWING" if after > 0 else ("CURRENT ROW" if after == 0 else f"{-after} PRECEDING")
        return self.frame(f"ROWS BETWEEN {a} AND {b}")

    def last(self, n: int) -> str:
        return self.rows(n - 1, 0)

    @property
    def sofar(self) -> str:
        return self.frame("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")

    @property
    def whole(self) -> str:
        return f"OVER (PARTITION BY {self.key})"

    def rn(self) -> str:
        return f"row_number() {self.frame()}"

    def lag(self, x: str, n: int = 1) -> str:
        return f"lag({x}, {n}) {self.frame()}"

    def lead(self, x: str, n: int = 1) -> str:
        return f"lead({x}, {n}) {self.frame()}"

    def diff(self, x: str, n: int = 1) -> str:
        return f"(({x}) - {self.lag(x, n)})"

    def pct(self, x: str, n: int = 1) -> str:
        return f"({ratio(x, self.lag(x, n))} - 1.0)"

    def logret(self, x: str, n: int = 1) -> str:
        return f"ln(({x}) / {self.lag(x, n)})"

    def ffill(self, x: str) -> str:
        return f"last_value({x} IGNORE NULLS) {self.sofar}"

    def _guard(self, agg: str, x: str, over: str, need: int) -> str:
        if need <= 1:
            return f"{agg} {over}"
        return f"(CASE WHEN count({x}) {over} >= {need} THEN {agg} {over} END)"

    def mean(self, x, n, need=None):
        return self._guard(f"avg({x})", x, self.last(n), n if need is None else need)

    def sum(self, x, n, need=None):
        return self._guard(f"sum({x})", x, self.last(n), n if need is None else need)

    def max(self, x, n, need=None):
        return self._guard(f"max({x})", x, self.last(n), n if need is None else need)

    def min(self, x, n, need=None):
        return self._guard(f"min({x})", x, self.last(n), n if need is None else need)

    def std(self, x, n, need=None):
        return self._guard(f"stddev_samp({x})", x, self.last(n), n if need is None else need)

    def std_pop(self, x, n, need=None):
        return self._guard(f"stddev_pop({x})", x, self.last(n), n if need is None else need)

    def quantile(self, x, q, n, need):
        return self._guard(f"quantile_cont({x}, {q})", x, self.last(n), need)

    def expanding(self, x, q, need):
        return self._guard(f"quantile_cont({x}, {q})", x, self.sofar, need)

    def qwhole(self, x, q):
        return f"quantile_cont({x}, {q}) {self.whole}"

    def zscore(self, x, n, eps="1e-8"):
        sd = self.std(x, n)
        return ratio(f"({x}) - {self.mean(x, n)}", f"{sd} + {eps}" if eps else sd)

    def count_true(self, cond, n, need=None):
        return self.sum(flag(cond), n, need)

    def k_of_l(self, cond, k, n, need=None):
        return flag(f"{self.count_true(cond, n, need)} >= {k}")

    def step(self, indicator: str) -> str:
        return f"CAST(coalesce({indicator} - lag({indicator}) {self.frame()}, 0) AS INT)"

    def latch(self, x: str, enter, leave) -> str:
        return (f"coalesce(last_value(CASE WHEN ({x}) >= {enter} THEN 1 WHEN ({x}) <= {leave} THEN 0 END IGNORE NULLS) "
                f"{self.sofar}, 0)")

    def entropy(self, s: str, n: int) -> str:
        parts = []
        for v in (-1, 0, 1):
            p = f"(sum(CAST({s} = {v} AS INT)) {self.last(n)} / {n}.0::DOUBLE)"
            parts.append(f"CASE WHEN {p} > 0 THEN -{p} * log2({p}) ELSE 0.0 END")
        return f"(CASE WHEN count({s}) {self.last(n)} >= {n} THEN {' + '.join(parts)} END)"


def scan_ema(name: str, source: str, key: str, alphas: dict[str, tuple[str, float]]) -> str:
    """Recursive CTE of exponential means (no missing values).  ``source`` has ``rn`` from 1.

    ``alphas``: output -> (input column, alpha).
    """
    start = ", ".join(f"{x} AS {o}" for o, (x, _) in alphas.items())
    step = ", ".join(f"CASE WHEN p.{o} <> b.{x} THEN (1.0 - {a!r}::DOUBLE) * p.{o} + {a!r}::DOUBLE * b.{x} ELSE p.{o} END"
                     for o, (x, a) in alphas.items())
    return f"""
{name}({key}, rn, {", ".join(alphas)}) AS (
  SELECT {key}, rn, {start} FROM {source} WHERE rn = 1
  UNION ALL
  SELECT b.{key}, b.rn, {step} FROM {name} p JOIN {source} b ON b.{key} = p.{key} AND b.rn = p.rn + 1)"""
