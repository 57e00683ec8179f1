"""Labels, sample weights, sequence windows and folds."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.over import Layout
from ..functions.scalar import dbl
from ..session import cut_lineage
from .align import interval_join
from .draws import sequential_draws


def direction_label(ly: Layout, price: str, horizon: int = 4, open_tail: str = "zero") -> Column:
    """1 when the log return over the next ``horizon`` rows is positive.

    Rows without a future count as 0 (``open_tail='zero'``) or stay NULL (``'null'``).
    """
    up = (ly.lead(dbl(price), horizon) > dbl(price)) & (dbl(price) > 0)
    label = F.when(up, 1).otherwise(0)
    if open_tail == "zero":
        return label
    return F.when(ly.lead(price, horizon).isNotNull(), label)


# ---- concurrency, uniqueness, weights -------------------------------------

def close_open_ends(events: DataFrame, bars: DataFrame, series: Sequence[str], end: str, ts: str) -> DataFrame:
    """An event without an end runs to the last bar of its series."""
    last = bars.groupBy(*series).agg(F.max(ts).alias("_last"))
    return events.join(last, list(series)).withColumn(end, F.coalesce(F.col(end), F.col("_last"))).drop("_last")


def concurrency(
    bars: DataFrame, events: DataFrame, series: Sequence[str],
    ts: str = "ts", start: str = "t_start", end: str = "t_end", out: str = "n_open",
) -> DataFrame:
    """Open events per bar, from the first start to the last end.

    Starts and ends are counted per time first, then one sweep over the bars adds them up:
    no range join and no event-by-bar matrix.
    """
    return _sweep(bars, close_open_ends(events, bars, series, end, ts), series, ts, start, end, out)


def _sweep(
    bars: DataFrame, closed: DataFrame, series: Sequence[str], ts: str, start: str, end: str, out: str = "n_open"
) -> DataFrame:
    opens = closed.groupBy(*series, F.col(start).alias(ts)).agg(F.count(F.lit(1)).alias("_n"))
    ends = closed.groupBy(*series, F.col(end).alias(ts)).agg((-F.count(F.lit(1))).alias("_n"))
    # At equal times: a start is already open on the bar, an end is still open on it.
    line = (
        bars.select(*series, ts, F.lit(1).alias("_kind"), F.lit(0).cast("long").alias("_n"))
        .unionByName(opens.withColumn("_kind", F.lit(0)))
        .unionByName(ends.withColumn("_kind", F.lit(2)))
    )
    w = Window.partitionBy(*series).orderBy(ts, "_kind")
    whole = Window.partitionBy(*series)
    swept = line.withColumns({
        out: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        "_from": F.min(F.when(F.col("_kind") == 0, F.col(ts))).over(whole),
        "_to": F.max(F.when(F.col("_kind") == 2, F.col(ts))).over(whole),
    })
    return swept.filter("_kind = 1").filter(F.col(ts).between(F.col("_from"), F.col("_to"))).select(*series, ts, out)


def indicator_pairs(
    bars: DataFrame, events: DataFrame, series: Sequence[str], event: str = "event_id",
    ts: str = "ts", start: str = "t_start", end: str = "t_end", bucket_seconds: int = 86_400,
) -> DataFrame:
    """Sparse (event, bar) pairs: the bars each event covers."""
    closed = close_open_ends(events, bars, series, end, ts)
    points = bars.select(*series, ts)
    return interval_join(closed, points, series, start, end, ts, bucket_seconds).select(*series, event, ts)


def running_totals_at(
    values: DataFrame, events: DataFrame, series: Sequence[str], columns: Sequence[str],
    ts: str, start: str, end: str,
) -> DataFrame:
    """Add to every event the running totals before its start (``_s_*``) and up to its end
    (``_e_*``) of each column and of the row count ``_rows``.

    Only the distinct event times join the sweep, so many events sharing a series do not
    pile up in one task; the events themselves meet the totals in equi-joins.
    """
    names = [*columns, "_rows"]
    times = (
        events.select(*series, F.col(start).alias(ts)).unionByName(events.select(*series, F.col(end).alias(ts)))
        .distinct()
    )
    rows = values.select(*series, ts, *columns, F.lit(1.0).alias("_rows"), F.lit(0).alias("_kind"))
    line = rows.unionByName(times.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*series).orderBy(ts)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    here = w.rangeBetween(Window.currentRow, Window.currentRow)
    totals = line.withColumns(
        {f"_i_{c}": F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for c in names}
        | {f"_h_{c}": F.coalesce(F.sum(c).over(here), F.lit(0.0)) for c in names}
    ).filter("_kind = 1")
    at_end = totals.select(*series, F.col(ts).alias(end), *[F.col(f"_i_{c}").alias(f"_e_{c}") for c in names])
    at_start = totals.select(
        *series, F.col(ts).alias(start), *[(F.col(f"_i_{c}") - F.col(f"_h_{c}")).alias(f"_s_{c}") for c in names]
    )
    return events.join(at_start, [*series, start]).join(at_end, [*series, end])


def interval_sums(
    values: DataFrame, events: DataFrame, series: Sequence[str], columns: Sequence[str],
    ts: str, start: str, end: str,
) -> DataFrame:
    """Sum of each column (and the row count ``_rows``) over the rows with
    ``start <= ts <= end``: two lookups of running totals instead of a range join."""
    names = [*columns, "_rows"]
    found = running_totals_at(values, events, series, columns, ts, start, end)
    return found.withColumns({c: F.col(f"_e_{c}") - F.col(f"_s_{c}") for c in names}).drop(
        *[f"_{side}_{c}" for side in "es" for c in names]
    )


def _running(line: DataFrame, series: Sequence[str], ts: str, measures: dict[str, Column]) -> DataFrame:
    """Running totals along (time, kind), in two levels: inside a day, and over the days of a series."""
    keyed = line.withColumn("_day", F.date_trunc("day", F.col(ts)))
    names = [*series, "_day"]
    sums = keyed.groupBy(*names).agg(*[F.sum(m).alias(f"_d_{c}") for c, m in measures.items()])
    earlier = Window.partitionBy(*series).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*names, *[F.coalesce(F.sum(f"_d_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in measures])
    inside = Window.partitionBy(*names).orderBy(ts, "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = keyed.join(before, names).withColumns({c: F.col(f"_b_{c}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for c, m in measures.items()})
    return found.drop("_day", *[f"_b_{c}" for c in measures])


def _sums_over_events(
    bars: DataFrame, events: DataFrame, series: Sequence[str], value: Column, ts: str, start: str, end: str,
) -> DataFrame:
    """Every event with the sum of ``value`` / concurrency over the bars it covers (``_sum``) and their number (``_rows``).

    One line holds starts, bars and ends in order; two sweeps along it give the open events of every bar, then the
    running totals that an event finds at its start and at its end.  Nothing is joined but days and, at last, the events.
    """
    closed = cut_lineage(close_open_ends(events, bars, series, end, ts).withColumn("_event", F.monotonically_increasing_id()))
    edge = lambda column, kind, step: closed.select(*series, F.col(column).alias(ts), F.lit(kind).alias("_kind"), F.lit(step).alias("_step"), "_event", F.lit(None).cast("double").alias("_value"))
    rows = bars.select(*series, ts, F.lit(1).alias("_kind"), F.lit(0).alias("_step"), F.lit(None).cast("long").alias("_event"), value.cast("double").alias("_value"))
    # At equal times a start comes before the bar and an end after it: both are open on it.
    line = cut_lineage(rows.unionByName(edge(start, 0, 1)).unionByName(edge(end, 2, -1)))
    swept = _running(line, series, ts, {"_open": F.col("_step")})
    bar = F.col("_kind") == 1
    share = F.when(bar, F.try_divide(F.col("_value"), F.col("_open").cast("double")))
    totals = _running(swept.select(*series, ts, "_kind", "_event", share.alias("_share"), bar.cast("int").alias("_bar")), series, ts,
                      {"_total": F.col("_share"), "_count": F.col("_bar")}).filter("_event IS NOT NULL")
    sign = F.when(F.col("_kind") == 2, 1).otherwise(-1)
    per_event = totals.groupBy("_event").agg(F.sum(sign * F.col("_total")).alias("_sum"), F.sum(sign * F.col("_count")).alias("_rows"))
    return closed.join(per_event, "_event").drop("_event")


def average_uniqueness(
    bars: DataFrame, events: DataFrame, series: Sequence[str], ts: str = "ts",
    start: str = "t_start", end: str = "t_end", out: str = "avg_uniqueness",
) -> DataFrame:
    """Per event, the mean of 1/concurrency over the bars it covers."""
    summed = _sums_over_events(bars, events, series, F.lit(1.0), ts, start, end)
    return summed.withColumn(out, F.try_divide(F.col("_sum"), F.col("_rows"))).drop("_sum", "_rows")


def sample_weights(
    bars: DataFrame, events: DataFrame, series: Sequence[str], price: str = "close", ts: str = "ts",
    start: str = "t_start", end: str = "t_end", decay: float = 0.01, out: str = "weight",
) -> DataFrame:
    """Return-attribution weight with exponential age decay, scaled to sum to the number of
    events of the series."""
    ly = Layout.of(tuple(series), ts)
    summed = cut_lineage(_sums_over_events(bars, events, series, ly.log_return(F.col(price)), ts, start, end))
    # The latest start and the scale are one row per series; aggregating them apart keeps many events off one task.
    latest = summed.groupBy(*series).agg(F.max(start).alias("_latest"))
    age = F.floor((F.unix_seconds("_latest") - F.unix_seconds(F.col(start))) / F.lit(86_400))
    raw = summed.join(latest, list(series)).withColumn("_w", F.abs(F.col("_sum") * F.exp(F.lit(-decay) * age)))
    scale = raw.groupBy(*series).agg(F.try_divide(F.count(F.lit(1)).cast("double"), F.sum("_w")).alias("_scale"))
    return raw.join(scale, list(series)).withColumn(out, F.col("_w") * F.col("_scale")).drop("_sum", "_rows", "_latest", "_w", "_scale")


def sequential_bootstrap(
    bars: DataFrame, events: DataFrame, series: Sequence[str], replicas: int, draws: int | None = None,
    seed: int = 0, event: str = "event_id", ts: str = "ts", start: str = "t_start", end: str = "t_end",
) -> DataFrame:
    """Seeded draws of events, each with probability proportional to its average uniqueness
    given the draws before it.  One chain is sequential; chains run in parallel.

    ``(series, replica, draw, event)``.  A chain works on bar positions of its series' events
    (at most one event per bar), not on an event-by-bar matrix, and a draw changes only the weights of events that
    overlap the drawn one.  Its random numbers are hashes of seed, series, replica and draw.  Events that cover no bar
    are never drawn.
    """
    closed = close_open_ends(events, bars, series, end, ts)
    placed = running_totals_at(bars.select(*series, ts), closed, series, [], ts, start, end)
    ranges = placed.select(
        *series, event, F.col("_s__rows").cast("int").alias("_lo"), F.col("_e__rows").cast("int").alias("_hi")
    ).withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
    fields = [ranges.schema[c] for c in series]
    schema = T.StructType(fields + [
        T.StructField("replica", T.IntegerType()), T.StructField("draw", T.IntegerType()), ranges.schema[event],
    ])
    names = [*series, "replica"]

    def chain(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([event, "_lo", "_hi"], ignore_index=True)
        low, high = rows["_lo"].to_numpy(np.int64), rows["_hi"].to_numpy(np.int64)
        picks = sequential_draws(low, high, len(rows) if draws is None else draws, seed, *key)
        out = pd.DataFrame({n: [v] * len(picks) for n, v in zip(names, key)})
        out["draw"] = np.arange(len(picks), dtype="int32")
        out[event] = rows[event].to_numpy()[picks]
        return out

    return ranges.groupBy(*names).applyInPandas(chain, schema)


def predictability(ly: Layout, label: str, window: int = 5) -> Column:
    """Share of labels equal to the row's own in a centred window, shortened at the ends."""
    half = window // 2
    near = F.collect_list(F.col(label)).over(ly.rows(-half, half))
    same = F.size(F.filter(near, lambda v: v == F.col(label)))
    return same / F.size(near).cast("double")


# ---- sequences ------------------------------------------------------------

def sequences(
    df: DataFrame, ly: Layout, features: Sequence[str], length: int = 20,
    label: str | None = None, weight: str | None = None,
) -> DataFrame:
    """Every full window of ``length`` rows as an array of feature arrays, with the label and
    weight of its last row."""
    ts = ly.order[0]
    w = ly.last(length)
    vector = F.array(*[dbl(f) for f in features])
    built = df.select(
        *ly.keys,
        F.first(ts).over(w).alias("start_ts"),
        F.col(ts).alias("end_ts"),
        F.collect_list(vector).over(w).alias("x"),
        F.count(F.lit(1)).over(w).alias("_rows"),
        *([F.col(label).alias("y")] if label else []),
        *([F.col(weight).alias("weight")] if weight else []),
    )
    return built.filter(F.col("_rows") == length).drop("_rows")


def sequence_table(
    samples: DataFrame, series: Sequence[str], features: Sequence[str], strategies: DataFrame | None = None,
    cluster: str = "cluster_id", start: str = "start_ts",
) -> DataFrame:
    """Long table: one row per (sample, step) with a time index, the sample's target, cluster
    and strategy; noise (-1) and missing (-2) clusters are left out.

    The index of a step counts from its sample's ``start``: hours since the first start of the series where that is
    a timestamp, the number itself (without its fraction) where it is one.
    """
    w = Window.partitionBy(*series).orderBy(start)
    if isinstance(samples.schema[start].dataType, (T.TimestampType, T.TimestampNTZType)):
        at = lambda c: F.unix_seconds(c.cast("timestamp"))
        base = F.floor((at(F.col(start)) - at(F.min(start).over(Window.partitionBy(*series)))) / F.lit(3600)).cast("long")
    else:
        base = F.col(start).cast("long")
    tagged = samples.withColumns({
        "group_id": (F.row_number().over(w) - 1).cast("string"),
        "_base": base,
        "original_cluster_id": F.coalesce(F.col(cluster), F.lit(-2)) if cluster in samples.columns else F.lit(-2),
    })
    tagged = tagged.filter(~F.col("original_cluster_id").isin(-1, -2))
    if strategies is not None:
        names = strategies.select(F.col(cluster).alias("original_cluster_id"), "strategy_name")
        tagged = tagged.join(names, "original_cluster_id", "left")
        tagged = tagged.withColumn("strategy_name", F.coalesce("strategy_name", F.lit("unknown")))
    else:
        tagged = tagged.withColumn("strategy_name", F.lit("unknown"))
    steps = tagged.select(*series, "group_id", "_base", F.col("y").cast("double").alias("target"),
                          "original_cluster_id", "strategy_name", F.posexplode("x").alias("_t", "_v"))
    return steps.select(
        *series, "group_id", (F.col("_base") + F.col("_t")).alias("time_idx"), "target",
        *[F.col("_v")[i].alias(f) for i, f in enumerate(features)],
        "original_cluster_id", "strategy_name",
    )


def window_statistics(
    df: DataFrame, ly: Layout, columns: Sequence[str], length: int, sub_ratio: float = 0.5,
    times: Sequence[str] = (), gaps: bool = False,
) -> DataFrame:
    """Statistics of every full window of ``length`` rows, one output row per window end.

    All frames share one partitioning and order.  ``gaps=True`` computes the lag-1
    autocorrelation over the non-missing values of each window; without missing values the
    frame form is the same and cheaper.
    """
    k = int(length * sub_ratio)
    full = ly.last(length)
    subs = {} if k <= 0 or k >= length else {
        "first": ly.rows(-length + 1, -length + k), "last": ly.rows(-k + 1, 0),
    }
    work = df.withColumns({f"_t_{t}": F.floor(F.unix_micros(F.col(t)) / F.lit(1_000_000)).cast("double") for t in times})
    work = work.withColumns({f"_prev_{c}": ly.lag(dbl(c)) for c in columns})
    out: dict[str, Column] = {}

    def basic(prefix: str, x: Column, w, sub: bool) -> None:
        out[f"{prefix}_mean"] = F.avg(x).over(w)
        out[f"{prefix}_std"] = F.stddev_samp(x).over(w)
        out[f"{prefix}_min"] = F.min(x).over(w)
        out[f"{prefix}_max"] = F.max(x).over(w)
        if sub:
            out[f"{prefix}_last"] = F.last(x, ignorenulls=True).over(w)
            out[f"{prefix}_diff"] = F.when(
                F.count(x).over(w) > 1, F.last(x, ignorenulls=True).over(w) - F.first(x, ignorenulls=True).over(w)
            )
        else:
            present = F.count(x).over(w) > 0
            out[f"{prefix}_last"] = F.when(present, x)
            out[f"{prefix}_diff"] = F.when(present, x - F.first(x).over(w))

    for c in columns:
        x = dbl(c)
        basic(c, x, full, False)
        n = F.count(x).over(full).cast("double")
        flat = F.max(x).over(full) == F.min(x).over(full)
        g1, g2 = F.skewness(x).over(full), F.kurtosis(x).over(full)
        out[f"{c}_skew"] = F.when(n >= 3, F.when(flat, 0.0).otherwise(
            g1 * F.sqrt(n * (n - 1)) / (n - 2)))
        out[f"{c}_kurtosis"] = F.when(n >= 4, F.when(flat, 0.0).otherwise(
            (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))
        if gaps:
            out[f"{c}_autocorr1"] = _array_autocorr(F.collect_list(x).over(full))
        else:
            pairs, prev = ly.rows(-length + 2, 0), F.col(f"_prev_{c}")
            varies = (F.max(x).over(pairs) > F.min(x).over(pairs)) & (F.max(prev).over(pairs) > F.min(prev).over(pairs))
            out[f"{c}_autocorr1"] = F.when(varies, F.corr(x, prev).over(pairs))
        for q in (10, 25, 50, 75, 90):
            out[f"{c}_p{q}"] = F.percentile(x, F.lit(q / 100)).over(full)
        for name, w in subs.items():
            basic(f"{c}_sub_{name}", x, w, True)
    for t in times:
        x = F.col(f"_t_{t}")
        basic(t, x, full, False)
        for name, w in subs.items():
            basic(f"{t}_sub_{name}", x, w, True)
    rows = work.select(*ly.keys, *ly.order, F.count(F.lit(1)).over(full).alias("_rows"),
                       *[v.alias(n) for n, v in out.items()])
    return rows.filter(F.col("_rows") == length).drop("_rows")


def _array_autocorr(values: Column) -> Column:
    """Correlation of an array with itself shifted by one; NULL when either side is flat."""
    n = F.size(values)
    a, b = F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0)))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    m = (n - 1).cast("double")
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    ma, mb = F.try_divide(total(a), m), F.try_divide(total(b), m)
    product = lambda f: F.aggregate(pairs, F.lit(0.0), lambda s, p: s + f(p))
    cov = product(lambda p: (p["a"] - ma) * (p["b"] - mb))
    va = product(lambda p: (p["a"] - ma) * (p["a"] - ma))
    vb = product(lambda p: (p["b"] - mb) * (p["b"] - mb))
    return F.when(n > 2, F.try_divide(cov, F.sqrt(va * vb)))


# ---- folds ----------------------------------------------------------------

def walk_forward_folds(df: DataFrame, row: str, total: str, folds: int = 5) -> DataFrame:
    """Expanding folds from a dense row index: one copy of a row per fold it belongs to,
    tagged ``fold`` and ``role`` (train/test)."""
    size = F.floor(F.col(total) / F.lit(folds + 1))
    tagged = df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    begin = F.col(total) - (F.lit(folds) - F.col("fold")) * size
    role = F.when(F.col(row) < begin, "train").when(F.col(row) < begin + size, "test")
    return tagged.withColumn("role", role).filter(F.col("role").isNotNull())


def hour_index(ts: str) -> Column:
    """Whole hours since the epoch."""
    return F.floor(F.unix_seconds(F.col(ts)) / F.lit(3600)).cast("long")
