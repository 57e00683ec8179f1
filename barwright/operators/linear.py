"""Linear recurrences y = a * y' + b over series of any length, as a prefix scan on the JVM.

Two steps compose to one of the same kind, so a block of rows acts on whatever enters it as one pair.  Rows are gathered
into short blocks, each block folds its pairs, blocks of blocks and then a series fold those, and every block replays
its rows from the state that enters it.  A task sees one block of rows, one block of pairs or one pair per 65,536 rows
of a series.  The result does not depend on the block size, except for the last bits of a sum.

Exponential and Wilder means are such recurrences: ``a`` is 0 where a mean is seeded, 1 where it holds.  State is NULL
until the first seed.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import dbl, ratio
from ..session import cut_lineage
from .blocks import BLOCK, _carry, in_blocks

#: Rows of a block, and pairs of a block of blocks.
BLOCK_ROWS, FAN = 256, 256
NAN = float("nan")


def _applied(a: Column, b: Column, y: Column) -> Column:
    """A seed does not look at what was before, which may be NULL."""
    return F.when(a == 0.0, b).otherwise(a * y + b)


def _folded(rows: Column, n: int) -> Column:
    """The pairs of a list, composed."""
    start = F.struct(*[F.lit(v).alias(f"{k}{i}") for i in range(n) for k, v in (("a", 1.0), ("b", 0.0))])

    def merge(acc: Column, e: Column) -> Column:
        return F.struct(*[x for i in range(n) for x in (
            (acc[f"a{i}"] * e[f"a{i}"]).alias(f"a{i}"), _applied(e[f"a{i}"], e[f"b{i}"], acc[f"b{i}"]).alias(f"b{i}"))])

    return F.aggregate(rows, start, merge)


def _replayed(rows: Column, n: int, entering: Sequence[Column], after: bool) -> Column:
    """States of a list, one struct y0, y1, ... per element: after it, or before it."""
    now = lambda acc: F.struct(*[acc[f"y{i}"].alias(f"y{i}") for i in range(n)])
    none = F.array().cast(f"array<struct<{', '.join(f'y{i}: double' for i in range(n))}>>")
    start = F.struct(*[y.cast("double").alias(f"y{i}") for i, y in enumerate(entering)], none.alias("seen"))

    def merge(acc: Column, e: Column) -> Column:
        new = F.struct(*[_applied(e[f"a{i}"], e[f"b{i}"], acc[f"y{i}"]).alias(f"y{i}") for i in range(n)])
        return F.struct(*[new[f"y{i}"].alias(f"y{i}") for i in range(n)], F.concat(acc["seen"], F.array(new if after else now(acc))).alias("seen"))

    return F.aggregate(rows, start, merge, lambda acc: acc["seen"])


def _entering(pairs: DataFrame, series: Sequence[str], n: int) -> DataFrame:
    """(series, block, y0, ...): the state before each block, from one pair per block."""
    fields = [f"{k}{i}" for i in range(n) for k in "ab"]
    big = pairs.withColumn("_big", F.floor(F.col(BLOCK) / F.lit(FAN)).cast("long"))
    lists = big.groupBy(*series, "_big").agg(F.array_sort(F.collect_list(F.struct(BLOCK, *fields))).alias("_rows"))
    tops = lists.select(*series, F.struct("_big", *[_folded(F.col("_rows"), n)[f].alias(f) for f in fields]).alias("_top"))
    tops = tops.groupBy(*series).agg(F.array_sort(F.collect_list("_top")).alias("_tops"))
    unknown = [F.lit(None)] * n
    before = tops.select(*series, F.explode(F.arrays_zip("_tops", _replayed(F.col("_tops"), n, unknown, False).alias("_y"))).alias("_z"))
    before = before.select(*series, F.col("_z._tops._big").alias("_big"), F.col("_z._y").alias("_from"))
    joined = lists.join(before, [*series, "_big"])
    states = _replayed(F.col("_rows"), n, [F.col("_from")[f"y{i}"] for i in range(n)], False)
    each = joined.select(*series, F.explode(F.arrays_zip("_rows", states.alias("_y"))).alias("_z"))
    return each.select(*series, F.col(f"_z._rows.{BLOCK}").alias(BLOCK), F.col("_z._y").alias("_from"))


def linear_scan(
    df: DataFrame, series: Sequence[str], row: str, steps: Mapping[str, tuple[Column, Column]], block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add every recurrence of ``steps`` (name to its a and b, which must not be NULL); ``row`` is the dense row index."""
    n, names = len(steps), [c for c in df.columns if c not in steps]
    pairs = [c.cast("double").alias(f"{k}{i}") for i, ab in enumerate(steps.values()) for k, c in zip("ab", ab)]
    payload = [c for c in names if c not in series and c != row]
    keyed = df.select(*series, F.floor(F.col(row) / F.lit(block_rows)).cast("long").alias(BLOCK),
                      F.struct(row, *pairs, F.struct(F.lit(0).alias("_"), *payload).alias("_payload")).alias("_row"))
    # Rows are ordered by the index alone, whatever types the other columns have.
    by_index = F.array_sort(F.collect_list("_row"), lambda x, y: F.when(x[row] < y[row], -1).when(x[row] > y[row], 1).otherwise(0))
    lists = cut_lineage(keyed.groupBy(*series, BLOCK).agg(by_index.alias("_rows")))  # read twice: folded, then replayed
    fields = [f"{k}{i}" for i in range(n) for k in "ab"]
    whole = lists.select(*series, BLOCK, _folded(F.col("_rows"), n).alias("_p")).select(*series, BLOCK, *[F.col("_p")[f].alias(f) for f in fields])
    joined = lists.join(_entering(whole, series, n), [*series, BLOCK])
    states = _replayed(F.col("_rows"), n, [F.col("_from")[f"y{i}"] for i in range(n)], True)
    each = joined.select(*series, F.explode(F.arrays_zip("_rows", states.alias("_y"))).alias("_z"))
    at = {c: F.col(c) for c in series} | {row: F.col(f"_z._rows.{row}")} | {c: F.col(f"_z._rows._payload.{c}") for c in payload}
    return each.select(*[at[c].alias(c) for c in names], *[F.col(f"_z._y.y{i}").alias(out) for i, out in enumerate(steps)])


# ---- exponential means --------------------------------------------------------

def _gaps(df: DataFrame, series: Sequence[str], row: str, column: str, block_rows: int) -> DataFrame:
    """Rows since the last present value before each row (``_gap``), NULL where there is none."""
    mark = F.when(F.col(column).isNotNull(), F.col(row))
    keyed = _carry(df, series, row, mark, block_rows)
    before = Window.partitionBy(*series, BLOCK).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(mark, ignorenulls=True).over(before), F.col("_carry"))
    return keyed.withColumn("_gap", F.col(row) - last).drop(BLOCK, "_carry")


def ema_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, out: str, span: float, row: str = "row_index", block_rows: int = BLOCK_ROWS,
    adjust: bool = False,
) -> DataFrame:
    """Exponential mean of the present values; missing rows age the weights and repeat the mean.

    ``adjust=True`` divides by the weights of the rows that are there, as two recurrences.
    """
    alpha = 2.0 / (span + 1.0)
    x, gap = dbl(column), F.col("_gap")
    aged = F.pow(F.lit(1.0 - alpha), gap)
    known, first = x.isNotNull(), gap.isNull()
    marked = _gaps(df, series, row, column, block_rows)
    if adjust:
        a = F.when(~known, 1.0).when(first, 0.0).otherwise(aged)
        both = {"_num": (a, F.coalesce(x, F.lit(0.0))), "_den": (a, F.when(known, 1.0).otherwise(0.0))}
        return linear_scan(marked, series, row, both, block_rows).withColumn(out, ratio("_num", "_den")).drop("_num", "_den", "_gap")
    keep = F.when(first, 0.0).otherwise(aged / (aged + alpha))
    step = (F.when(known, keep).otherwise(1.0), F.when(known, (1.0 - keep) * x).otherwise(0.0))
    return linear_scan(marked, series, row, {out: step}, block_rows).drop("_gap")


@dataclass(frozen=True)
class Seeded:
    """A mean that starts at row ``at`` with the mean of the ``period`` values that end there and then takes the share
    ``take`` of every value.  A missing value ends it."""

    column: str
    period: int
    take: float
    at: str


def seeded_scan(df: DataFrame, series: Sequence[str], row: str, means: Mapping[str, Seeded], block_rows: int = BLOCK_ROWS) -> DataFrame:
    df = cut_lineage(df)  # read twice: for the seeds and by the scan
    parts = []
    for i, m in enumerate(means.values()):
        inside = F.when((F.col(row) > F.col(m.at) - m.period) & (F.col(row) <= F.col(m.at)), dbl(m.column))
        parts += [F.when(F.count(inside) == m.period, F.avg(inside)).otherwise(F.lit(NAN)).alias(f"_seed{i}")]
    seeds = df.groupBy(*series).agg(*parts)
    steps = {}
    for i, (out, m) in enumerate(means.items()):
        here = F.col(row) - F.col(m.at)
        early = here.isNull() | (here < 0)
        steps[out] = (F.when(early, 1.0).when(here == 0, 0.0).otherwise(1.0 - m.take),
                      F.when(early, 0.0).when(here == 0, F.col(f"_seed{i}")).otherwise(F.coalesce(dbl(m.column), F.lit(NAN)) * m.take))
    found = linear_scan(df.join(seeds, list(series)), series, row, steps, block_rows)
    return found.withColumns({out: F.nanvl(out, F.lit(None).cast("double")) for out in means}).drop(*[f"_seed{i}" for i in range(len(means))])


def first_present(df: DataFrame, series: Sequence[str], row: str, column: str, out: str, later: int = 0) -> DataFrame:
    """Add the row of a series' first present value, shifted by ``later``; NULL where there is none."""
    found = df.groupBy(*series).agg((F.min(F.when(F.col(column).isNotNull(), F.col(row))) + later).alias(out))
    return df.join(found, list(series))


def seeded_ema_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, periods: Mapping[str, int], row: str = "row_index", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exponential means seeded with a simple one, for several periods (name to period) in one scan."""
    x = first_present(df, series, row, column, "_first")
    x = x.withColumns({f"_at_{out}": F.col("_first") + (n - 1) for out, n in periods.items()})
    means = {out: Seeded(column, n, 2.0 / (n + 1), f"_at_{out}") for out, n in periods.items()}
    return seeded_scan(x, series, row, means, block_rows).drop("_first", *[f"_at_{out}" for out in periods])


def macd_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, prefix: str = "MACD", fast: int = 12, slow: int = 26, signal: int = 9,
    row: str = "row_index", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Line, signal and histogram: two means seeded at the same row, then one of their difference."""
    x = first_present(df, series, row, column, "_at", slow - 1)
    x = seeded_scan(x, series, row, {f"_m{n}": Seeded(column, n, 2.0 / (n + 1), "_at") for n in (fast, slow)}, block_rows)
    x = x.withColumns({prefix: F.col(f"_m{fast}") - F.col(f"_m{slow}"), "_at": F.col("_at") + (signal - 1)}).drop(f"_m{fast}", f"_m{slow}")
    x = seeded_scan(x, series, row, {f"{prefix}_signal": Seeded(prefix, signal, 2.0 / (signal + 1), "_at")}, block_rows).drop("_at")
    line = F.when(F.col(f"{prefix}_signal").isNotNull(), F.col(prefix))
    return x.withColumn(prefix, line).withColumn(f"{prefix}_hist", F.col(prefix) - F.col(f"{prefix}_signal"))


def rsi_in_blocks(
    df: DataFrame, series: Sequence[str], column: str, out: str = "RSI", period: int = 14, row: str = "row_index", block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Relative strength of Wilder means of the rises and the falls; a motionless series reads 0."""
    x = in_blocks(df, series, row, lambda d, ly: d.withColumn("_d", ly.diff(dbl(column))), 1, 0, block_rows)
    x = x.withColumns({"_up": F.when(F.col("_d") > 0, F.col("_d")).when(F.col("_d").isNotNull(), 0.0),
                       "_down": F.when(F.col("_d") < 0, -F.col("_d")).when(F.col("_d").isNotNull(), 0.0)})
    x = first_present(x, series, row, column, "_at", period)
    x = seeded_scan(x, series, row, {s: Seeded(c, period, 1.0 / period, "_at") for s, c in (("_u", "_up"), ("_v", "_down"))}, block_rows)
    total = F.col("_u") + F.col("_v")
    return x.withColumn(out, F.when(total == 0.0, 0.0).otherwise(ratio(100.0 * F.col("_u"), total))).drop("_d", "_up", "_down", "_at", "_u", "_v")


def atr_in_blocks(
    df: DataFrame, series: Sequence[str], high: str, low: str, close: str, out: str, period: int, row: str = "row_index",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Wilder mean of the true range; a range without an earlier close is missing."""
    def build(d: DataFrame, ly) -> DataFrame:
        h, l, before = dbl(high), dbl(low), ly.lag(dbl(close))
        whole = h.isNotNull() & l.isNotNull() & before.isNotNull()
        return d.withColumn("_range", F.when(whole, F.greatest(h - l, F.abs(h - before), F.abs(l - before))))

    x = first_present(in_blocks(df, series, row, build, 1, 0, block_rows), series, row, "_range", "_at", period - 1)
    return seeded_scan(x, series, row, {out: Seeded("_range", period, 1.0 / period, "_at")}, block_rows).drop("_range", "_at")
