"""Traded volume by price level, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

VALUE_AREA_SHARE = 0.7


def _span_and_vwap(df: DataFrame, series: Sequence[str], low: str, high: str, price: str | None, volume: str) -> DataFrame:
    """First read of the bars: price range, and the volume-weighted mean price where a price is given."""
    v = F.col(volume).cast("double")
    weighted = [] if price is None else [F.try_divide(F.sum(F.col(price).cast("double") * v), F.sum(v)).alias("vwap"), F.sum(v).alias("_weight")]
    return df.groupBy(*series).agg(
        F.min(F.col(low)).cast("double").alias("_lo"), F.max(F.col(high)).cast("double").alias("_hi"), *weighted)


def _filled_bins(
    df: DataFrame, span: DataFrame, series: Sequence[str], low: str, high: str, price: str | None, volume: str, num_bins: int,
) -> DataFrame:
    """Second read: every bin with its volume, and the bin's part of the weighted squares around ``vwap`` (``_square``).

    A row adds its volume at the first bin that its range overlaps (open comparisons) and takes it off behind the last;
    running sums over the bins give the volumes.  A row makes two entries however many bins it covers, and they are
    summed map-side before the exchange.
    """
    n = F.lit(num_bins)
    step = (F.col("_hi") - F.col("_lo")) / n
    edge = lambda i: F.when(i >= n, F.col("_hi")).otherwise(F.col("_lo") + i * step)
    guess = lambda c: F.coalesce(F.floor(F.try_divide(F.col(c) - F.col("_lo"), step)).cast("int"), F.lit(0))
    square = F.lit(0.0) if price is None else F.pow(F.col(price).cast("double") - F.col("vwap"), F.lit(2.0)) * F.col(volume).cast("double")
    rows = df.join(span, list(series)).select(
        *series, "_lo", "_hi", F.col(low).cast("double").alias("_l"), F.col(high).cast("double").alias("_h"),
        F.col(volume).cast("double").alias("_v"), square.alias("_square"))
    rows = rows.withColumns({"_f": guess("_l"), "_t": guess("_h")})  # right but for rounding at an edge
    f, t = F.col("_f"), F.col("_t")
    first = F.greatest(F.when(edge(f) > F.col("_l"), f - 1).when(edge(f + 1) > F.col("_l"), f).otherwise(f + 1), F.lit(0))
    last = F.least(F.when(edge(t) >= F.col("_h"), t - 1).when(edge(t + 1) < F.col("_h"), t + 1).otherwise(t), n - 1)
    rows = rows.withColumns({"_first": first, "_last": last})
    hit = F.col("_l").isNotNull() & F.col("_h").isNotNull() & (F.col("_first") <= F.col("_last"))
    entry = lambda at, value, square: F.struct(at.alias("bin"), value.alias("_add"), square.alias("_square"))
    entries = F.when(hit, F.array(entry(F.col("_first"), F.col("_v"), F.col("_square")), entry(F.col("_last") + 1, -F.col("_v"), F.lit(0.0)))).otherwise(
        F.array(entry(F.lit(0), F.lit(0.0), F.col("_square"))))
    sums = rows.select(*series, F.explode(entries).alias("_e")).groupBy(*series, F.col("_e.bin").alias("bin")).agg(
        F.sum("_e._add").alias("_add"), F.sum("_e._square").alias("_square"))
    all_bins = span.withColumn("bin", F.explode(F.sequence(F.lit(0), n - 1)))
    upto = Window.partitionBy(*series).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per bin
    bin_ = F.col("bin")
    return all_bins.join(sums, [*series, "bin"], "left").select(
        *series, "bin", edge(bin_).alias("lower"), edge(bin_ + 1).alias("upper"),
        F.coalesce(F.sum("_add").over(upto), F.lit(0.0)).alias("volume"), "_square",
        *([] if price is None else ["vwap", "_weight"]))


def volume_bins(
    df: DataFrame, series: Sequence[str], low: str = "low", high: str = "high", volume: str = "volume_USD",
    num_bins: int = 20,
) -> DataFrame:
    """``(series, bin, lower, upper, volume)`` for equal bins over the price range.

    A row counts with its full volume in every bin its range overlaps (open comparisons); empty bins are kept.
    """
    span = _span_and_vwap(df, series, low, high, None, volume)
    return _filled_bins(df, span, series, low, high, None, volume, num_bins).drop("_square")


def bin_statistics(bins: DataFrame, series: Sequence[str], *more: Column) -> DataFrame:
    """Mean/max/deviation over bins, point of control, value area bounds.

    Ties go to the lower bin for the point of control and to the higher bin in the value
    area.  When the top bin alone passes the share the area is empty and its bounds NULL.
    """
    mid = (F.col("lower") + F.col("upper")) / F.lit(2.0)
    by_volume = Window.partitionBy(*series).orderBy(F.desc("volume"), F.desc("bin"))
    ranked = bins.withColumns({
        "_mid": mid,
        "_cum": F.sum("volume").over(by_volume.rowsBetween(Window.unboundedPreceding, 0)),
        "_total": F.sum("volume").over(by_volume.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    inside = F.when(F.col("_cum") <= F.col("_total") * F.lit(VALUE_AREA_SHARE), F.col("_mid"))
    return ranked.groupBy(*series).agg(
        F.avg("volume").alias("vbp_mean"),
        F.max("volume").alias("vbp_max"),
        F.stddev_pop("volume").alias("vbp_std"),
        F.min_by("_mid", F.struct(-F.col("volume"), F.col("bin"))).alias("poc_price"),
        F.max(inside).alias("vah_price"),
        F.min(inside).alias("val_price"),
        *more,
    )


def vwap(
    df: DataFrame, series: Sequence[str], price: str = "close", volume: str = "volume_USD"
) -> DataFrame:
    """Volume-weighted mean price and its weighted deviation."""
    p, v = F.col(price).cast("double"), F.col(volume).cast("double")
    mean = df.groupBy(*series).agg(F.try_divide(F.sum(p * v), F.sum(v)).alias("vwap"))
    spread = df.select(*series, p.alias("_p"), v.alias("_v")).join(mean, list(series)).groupBy(*series).agg(
        F.first("vwap").alias("vwap"),
        F.sqrt(F.try_divide(
            F.sum(F.pow(F.col("_p") - F.col("vwap"), F.lit(2.0)) * F.col("_v")), F.sum("_v")
        )).alias("vwap_std"),
    )
    return spread


def volume_profile(
    df: DataFrame, series: Sequence[str], num_bins: int = 20, low: str = "low", high: str = "high", volume: str = "volume_USD", close: str = "close",
) -> DataFrame:
    """One row per series with the bin statistics and VWAP, from two reads of the bars."""
    span = _span_and_vwap(df, series, low, high, close, volume)
    bins = _filled_bins(df, span, series, low, high, close, volume, num_bins)
    spread = F.sqrt(F.try_divide(F.sum("_square"), F.first("_weight")))
    return bin_statistics(bins, series, F.first("vwap").alias("vwap"), spread.alias("vwap_std"))
