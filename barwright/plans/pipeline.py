"""Bundles that attach a table to a table: profile, sentiment, everything together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.over import Layout
from ..functions.scalar import dbl
from ..operators.align import hourly_grid, join_all, merge_slow_series
from ..operators.clean import chronological_split, finite_columns, numeric_columns
from ..operators.cusum import cusum_flags_resetting
from ..operators.fit import category_codes, scaler_over
from ..operators.labels import direction_label
from ..operators.profile import volume_profile
from .onchain import activity_features
from .orderbook import orderbook_features
from .price import price_features

PROFILE_COLUMNS = ("vbp_mean", "vbp_max", "vbp_std", "poc_price", "vah_price", "val_price", "vwap", "vwap_std")


def profile_features(df: DataFrame, ly: Layout, num_bins: int = 20) -> DataFrame:
    """Volume-profile constants of the series on every row, with their means and lags."""
    ly = ly.layered()
    profile = volume_profile(df, list(ly.keys), num_bins)
    x = df.join(profile, list(ly.keys))
    layer = {f"{c}_MA_t_{n}": ly.mean(c, n) for c in PROFILE_COLUMNS for n in (6, 24)}
    layer |= {f"{c}_Lag_t_{n}": ly.lag(c, n) for c in PROFILE_COLUMNS[:-1] for n in (1, 3)}
    return ly.add(x, layer)


def sentiment_features(df: DataFrame, series: Sequence[str], ts: str = "date") -> DataFrame:
    """Sentiment index on a full hourly grid with mean, deviation, change and lags."""
    coded = category_codes(df, "fg_label", "fg_label_num")
    grid = hourly_grid(coded, series, ts, ["fg_index", "fg_label", "fg_label_num"])
    ly = Layout.of(tuple(series), ts).layered()
    x = ly.add(grid, {"fg_index_ma": ly.mean("fg_index", 24), "_p": ly.ffill(dbl("fg_index"))})
    x = ly.add(x, {
        "fg_index_diff": dbl("fg_index") - F.col("fg_index_ma"), "fg_index_change": ly.pct_change("_p")})
    names = ("fg_index", "fg_index_ma", "fg_index_diff", "fg_index_change")
    return ly.add(x, {f"{c}_lag{n}": ly.lag(c, n) for c in names for n in (1, 2)}).drop("_p")


def all_features(df: DataFrame, ly: Layout, drop: str = "all") -> DataFrame:
    """Profile, activity, price and order-flow bundles in that order."""
    x = profile_features(df, ly)
    x = activity_features(x, ly, drop)
    x = price_features(x, ly, drop)
    return orderbook_features(x, ly)


def merge_sources(price: DataFrame, activity: DataFrame, trades: DataFrame, sentiment: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows present in all four tables."""
    return join_all([price, activity, trades, sentiment], on, "inner")


def with_labels(df: DataFrame, ly: Layout, price: str = "close", horizons: Sequence[int] = (1, 3, 6)) -> DataFrame:
    return df.withColumns({f"labels_{h}h": direction_label(ly, price, h) for h in horizons})


def with_slow_series(df: DataFrame, sources: Sequence[tuple[DataFrame, str]], series: Sequence[str], ts: str) -> DataFrame:
    return merge_slow_series(df, sources, series, ts)


def scale_features(df: DataFrame, ly: Layout, train: Column, skip: Sequence[str]) -> DataFrame:
    """Standardise every numeric column except ``skip`` with training-row parameters."""
    ly = ly.layered()
    names = [c for c in numeric_columns(df) if c not in (*skip, *ly.keys, *ly.order)]
    x = finite_columns(df, names)
    return ly.add(x, {c: scaler_over(ly, c, train) for c in names})


def split_and_scale(
    df: DataFrame, ly: Layout, split_day: str, labels: Sequence[str], skip: Sequence[str] = (), overlap: str = "disjoint",
    change_columns: Sequence[str] = (), change_threshold: float = 2.0,
) -> tuple[DataFrame, DataFrame]:
    """(train, test): infinities removed, numeric features scaled with the training rows,
    change flags added to each half on its own."""
    ts = ly.order[0]
    before = F.date_add(F.to_date(F.lit(split_day)), 1 if overlap == "reference" else 0).cast("timestamp")
    scaled = scale_features(df, ly, F.col(ts) < before, (*labels, *skip))
    halves = chronological_split(scaled, ts, split_day, overlap)
    for column in change_columns:
        halves = tuple(cusum_flags_resetting(h, ly, column, change_threshold) for h in halves)
    return halves
