"""Exact quantiles of many columns by a sketch and a refinement: two aggregates, bounded state.

A mergeable rank sketch gives, for every wanted quantile, two values whose ranks enclose it: the sketch's rank error is
1 / ``accuracy`` of the rows, the distance asked for twice that.  A second aggregate counts what lies below and at these
values and keeps only the few values between them, with the nearest on either side; the wanted order statistics are
among these.  A task holds sketches and at most about 6 / ``accuracy`` of a series' values, never a series.

Columns are put under each other first, so that groups are (series, column) pairs and spread over tasks however few the
series are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

ACCURACY = 10_000


def stacked(df: DataFrame, series: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """(series, ``_at`` the column's number, ``_x`` its value)."""
    return df.select(*series, F.posexplode(F.array(*[c.cast("double") for c in columns.values()])).alias("_at", "_x"))


def _order_statistic(k: Column, s: str) -> Column:
    """The value of 0-based rank ``k`` from the second aggregate's fields of one quantile."""
    f = lambda name: F.col(f"_{name}{s}")
    upto_low = f("below") + f("at_low")
    upto_inside = upto_low + F.size(f("inside"))
    return (
        F.when(k < f("below"), f("before")).when(k < upto_low, f("low"))
        .when(k < upto_inside, F.get(f("inside"), (k - upto_low).cast("int")))
        .when(k < upto_inside + f("at_high"), f("high")).otherwise(f("after"))
    )


def fitted(
    df: DataFrame, series: Sequence[str], columns: Mapping[str, Column], shares: Mapping[str, float],
    more: Mapping[str, Column] | None = None, accuracy: int = ACCURACY,
) -> DataFrame:
    """``(series, _at, <share names>..., <more>...)``, ``_at`` being the column's number: linearly interpolated quantiles of
    the non-missing values and further aggregates of the value ``_x``, taken along in the first pass."""
    more = dict(more or {})
    rows = stacked(df, series, columns)
    by = [*series, "_at"]
    sides = [min(1.0, max(0.0, q + d * 2.0 / accuracy)) for q in shares.values() for d in (-1, 1)]
    sketch = [F.percentile_approx("_x", sides, accuracy).alias("_sides")] if shares else []
    first = rows.groupBy(*by).agg(F.count("_x").alias("_n"), *sketch, *[c.alias(n) for n, c in more.items()])
    if not shares:
        return first.select(*by, *more)
    ends = first.select(*by, *[F.get("_sides", F.lit(2 * i + j)).alias(f"_{side}{i}") for i in range(len(shares)) for j, side in enumerate(("low", "high"))])
    x, parts = F.col("_x"), []
    for i in range(len(shares)):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        parts += [
            F.count_if(x < low).alias(f"_below{i}"), F.max(F.when(x < low, x)).alias(f"_before{i}"), F.count_if(x == low).alias(f"_at_low{i}"),
            F.sort_array(F.collect_list(F.when((x > low) & (x < high), x))).alias(f"_inside{i}"),
            F.count_if((x == high) & (high > low)).alias(f"_at_high{i}"), F.min(F.when(x > high, x)).alias(f"_after{i}"),
        ]
    second = rows.join(ends, by).groupBy(*by).agg(*parts)
    found = first.join(ends, by).join(second, by)
    out = []
    for i, (name, q) in enumerate(shares.items()):
        place = F.lit(q) * (F.col("_n") - 1)
        k = F.floor(place)
        a, b = _order_statistic(k, str(i)), _order_statistic(F.least(k + 1, F.col("_n") - 1), str(i))
        out.append(F.when(F.col("_n") > 0, F.when(place == k, a).otherwise(a * (k + 1 - place) + b * (place - k))).alias(name))
    return found.select(*by, *more, *out)


def exact_quantiles(
    df: DataFrame, series: Sequence[str], columns: Mapping[str, Column], shares: Mapping[str, float],
    more: Mapping[str, Column] | None = None, accuracy: int = ACCURACY,
) -> DataFrame:
    """``(series, column, <more>..., <share names>...)`` of every column."""
    named = F.element_at(F.array(*[F.lit(n) for n in columns]), F.col("_at") + 1).alias("column")
    return fitted(df, series, columns, shares, more, accuracy).select(*series, named, *(more or {}), *shares)


def beside(df: DataFrame, table: DataFrame, series: Sequence[str], out: str) -> DataFrame:
    """Rows with the fits of their series as one array ``out`` of structs in the columns' order; the join's strategy is left
    to the optimizer."""
    fields = [c for c in table.columns if c not in series]
    lists = table.groupBy(*series).agg(F.array_sort(F.collect_list(F.struct("_at", *[c for c in fields if c != "_at"]))).alias(out))
    return df.join(lists, list(series), "left")
