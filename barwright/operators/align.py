"""Joins, time alignment and grid completion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.over import Layout
from .clean import keep_first


def floor_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", ts)


def join_all(frames: Sequence[DataFrame], on: Sequence[str], how: str = "inner") -> DataFrame:
    """Chain of equi-joins on the same columns (``inner`` or ``full``), keys coalesced.

    All joins use the same keys, so each side is exchanged once and the chain stays
    co-partitioned.
    """
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """Backward as-of join: every left row gets the latest right row at or before its time.

    Both sides are stacked and the right row is carried forward in one window, with right
    rows before left rows at equal times.  A struct is carried, so a NULL in the matched
    right row stays NULL instead of reaching further back.  Right rows sharing a time are
    settled by ``tie`` (the last one wins).
    """
    missing = [c for c in columns if c not in right.columns]
    if missing:
        raise ValueError(f"columns not found on the right side: {missing}")
    keys = [*series, *extra_keys]
    if not keys:
        raise ValueError("name at least one series column; a window without keys runs in one task")
    payload = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(
        *keys, ts, F.lit(1).alias("_side"), F.struct(*payload).alias("_left")
        if payload else F.lit(True).alias("_left"),
    )
    r = right.select(
        *keys, ts, F.lit(0).alias("_side"),
        F.struct(*columns).alias("_right"), *[F.col(t).alias(f"_tie_{t}") for t in tie],
    )
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_side", *[f"_tie_{t}" for t in tie]).rowsBetween(
        Window.unboundedPreceding, 0)
    carried = both.withColumn("_right", F.last("_right", ignorenulls=True).over(w))
    return carried.filter("_side = 1").select(
        *keys, ts,
        *[F.col(f"_left.{c}").alias(c) for c in payload],
        *[F.col(f"_right.{c}").alias(c) for c in columns],
    )


def asof_join_in_buckets(
    left: DataFrame,
    right: DataFrame,
    series: Sequence[str],
    ts: str,
    columns: Sequence[str],
    tie: Sequence[str] = (),
    bucket_seconds: int = 3_600,
) -> DataFrame:
    """Backward as-of join for a left side too long for one task per series (raw trades).

    Rows are matched inside (series, time bucket); the right row in force when a bucket
    opens comes from a table with one row per bucket, filled forward.
    """
    bucket = F.floor(F.unix_seconds(F.col(ts)) / F.lit(bucket_seconds)).cast("long").alias("_bucket")
    l, r = left.select("*", bucket), right.select(*series, ts, *columns, *[t for t in tie if t != ts], bucket)
    inside = asof_join(
        l, r.withColumn("_hit", F.lit(True)), series, ts, [*columns, "_hit"], tie, extra_keys=["_bucket"])
    ends = r.groupBy(*series, "_bucket").agg(
        F.max_by(F.struct(*columns), F.struct(ts, *[t for t in tie if t != ts])).alias("_end"))
    seen = l.select(*series, "_bucket").distinct()
    w = Window.partitionBy(*series).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = seen.join(ends, [*series, "_bucket"], "full").select(
        *series, "_bucket", F.last("_end", ignorenulls=True).over(w).alias("_carry"))
    joined = inside.join(carried, [*series, "_bucket"], "left")
    return joined.select(
        *left.columns,
        *[F.when(F.col("_hit"), F.col(c)).otherwise(F.col(f"_carry.{c}")).alias(c) for c in columns])


def merge_slow_series(
    base: DataFrame, sources: Sequence[tuple[DataFrame, str]], series: Sequence[str], ts: str
) -> DataFrame:
    """As-of join several slow tables onto the base grid, one value column each.

    The slow tables are merged first (full join on time, small), so the large side is
    exchanged and sorted once, not once per source.  Each value is carried on its own so
    that sources with different clocks do not cut each other short.
    """
    payload = [c for c in base.columns if c not in (*series, ts)]
    stacked = base.select(*series, ts, F.lit(1).alias("_side"), F.struct(*payload).alias("_left"))
    for source, column in sources:
        if column not in source.columns:
            raise ValueError(f"{column} not found")
        stacked = stacked.unionByName(
            source.select(*series, ts, F.lit(0).alias("_side"), F.struct(column).alias(f"_v_{column}")),
            allowMissingColumns=True,
        )
    w = Window.partitionBy(*series).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    names = [column for _, column in sources]
    carried = stacked.withColumns({f"_v_{c}": F.last(f"_v_{c}", ignorenulls=True).over(w) for c in names})
    return carried.filter("_side = 1").select(
        *series, ts, *[F.col(f"_left.{c}").alias(c) for c in payload],
        *[F.col(f"_v_{c}.{c}").alias(c) for c in names],
    )


def interval_join(
    events: DataFrame,
    points: DataFrame,
    series: Sequence[str],
    start: str,
    end: str,
    ts: str,
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Pairs with ``start <= ts <= end`` (both inclusive).

    Each event is copied to the time buckets it touches and joined on (series, bucket) with
    the exact predicate left over, so the plan is an equi-join that adaptive execution can
    split when one bucket is hot.
    """
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c)) / F.lit(bucket_seconds)).cast("long")
    e = events.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("_bucket", bucket(ts))
    joined = e.join(p, [*series, "_bucket"])
    return joined.filter(F.col(ts).between(F.col(start), F.col(end))).drop("_bucket")


def lookup(
    df: DataFrame, table: DataFrame, key: str, value: str,
    unknown: str = "unknown", noise: str = "noise", noise_key: int = -1,
) -> DataFrame:
    """Left lookup with a default, and a label of its own for the noise key."""
    hit = df.join(table.select(key, value), key, "left")
    fallback = F.when(F.col(key) == noise_key, F.lit(noise)).otherwise(F.lit(unknown))
    return hit.withColumn(value, F.coalesce(F.col(value), fallback))


def hourly_grid(
    df: DataFrame, series: Sequence[str], ts: str, columns: Sequence[str], order: Sequence[str] | None = None
) -> DataFrame:
    """Every hour between the first and last row of a series; last value per hour, then
    carried forward.  ``last`` skips NULL per column, as a resample does."""
    order = F.struct(*(order or [ts]))
    hour = F.date_trunc("hour", F.col(ts))
    last = df.groupBy(*series, hour.alias(ts)).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns]
    )
    span = df.groupBy(*series).agg(F.min(hour).alias("_lo"), F.max(hour).alias("_hi"))
    grid = span.select(*series, F.explode(F.expr("sequence(_lo, _hi, interval 1 hour)")).alias(ts))
    filled = grid.join(last, [*series, ts], "left")
    ly = Layout.of(tuple(series), ts)
    return filled.withColumns({c: ly.ffill(c) for c in columns})


def row_index(
    df: DataFrame, series: Sequence[str], order: Sequence[str], bucket: Column, out: str = "row_index",
    total: str | None = None,
) -> DataFrame:
    """Dense 0-based position inside each series without sorting a series in one task.

    Rows are counted per (series, bucket); the counts, one row per bucket, give each bucket
    its offset; rows are numbered inside their bucket only.  ``bucket`` must not decrease
    along ``order`` (for example the day or the hour of the timestamp).
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*series, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*series).orderBy("_bucket")
    before = counts.select(
        *series, "_bucket",
        (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
        *([F.sum("_n").over(Window.partitionBy(*series)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*series, "_bucket").orderBy(*order)
    return (
        keyed.withColumn("_in", F.row_number().over(inside) - 1)
        .join(before, [*series, "_bucket"])
        .withColumn(out, (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_bucket", "_in", "_before")
    )


def union_keep_first(frames: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Stack by name in the given order and keep the first row of each key.

    Columns that only a later frame has are NULL on the rows an earlier frame supplied.
    """
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    rest = [c for c in stacked.columns if c not in (*key, "_src")]
    return keep_first(stacked, key, ["_src", *rest]).drop("_src")


def flow_totals(df: DataFrame, ts: str, values: Mapping[str, str]) -> DataFrame:
    """Totals per hour over all exchanges; an hour with only missing values sums to 0."""
    return df.groupBy(floor_hour(ts).alias(ts)).agg(
        *[F.coalesce(F.sum(F.col(c)), F.lit(0)).cast("double").alias(out) for c, out in values.items()]
    )


def flow_pivot(df: DataFrame, ts: str, exchange: str, value: str, names: Sequence[str]) -> DataFrame:
    """One column per exchange."""
    return df.groupBy(floor_hour(ts).alias(ts)).pivot(exchange, list(names)).agg(F.sum(value))
