"""Trades to fixed-width bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BAR_COLUMNS = [
    "price_first", "price_last", "price_max", "price_min", "price_mean",
    "qty_sum", "qty_count", "qty_mean", "amount_sum",
    "buy_qty_sum", "buy_qty_mean", "sell_qty_sum", "sell_qty_mean",
    "buy_trade_sum", "sell_trade_sum",
]


def trade_order(ts: Column, trade_id: Column) -> Column:
    """One fixed-width ordering value for (time, trade id).

    A struct would push ``min_by``/``max_by`` into a sort-based aggregate; a decimal keeps the
    hash aggregate and its map-side combine.  Ids are non-negative and below 1e19.
    """
    micros = F.unix_micros(ts).cast("decimal(18,0)")
    high = (micros * F.lit("100000000000000000000").cast("decimal(21,0)")).cast("decimal(38,0)")
    return (high + trade_id.cast("decimal(19,0)")).cast("decimal(38,0)")


def ticks_to_bars(
    ticks: DataFrame,
    series: list[str],
    ts: str = "timestamp",
    trade_id: str = "trade_id",
    unit: str = "hour",
    out: str = "date",
) -> DataFrame:
    """Aggregate trades (``price, qty, is_buyer_maker``) into bars per series.

    One partial + final hash aggregate and one exchange of at most (series x bars) rows per
    map task, so a single hot series is combined before it is shuffled.  Empty bars do not
    appear.  Side means divide by all trades of the bar.
    """
    price, qty = F.col("price").cast("double"), F.col("qty").cast("double")
    maker = F.col("is_buyer_maker")
    zero = F.lit(0.0)
    buy, sell = F.when(~maker, qty).otherwise(zero), F.when(maker, qty).otherwise(zero)
    order = trade_order(F.col(ts), F.col(trade_id))
    return ticks.groupBy(*series, F.date_trunc(unit, F.col(ts)).alias(out)).agg(
        F.min_by(price, order).alias("price_first"),
        F.max_by(price, order).alias("price_last"),
        F.max(price).alias("price_max"),
        F.min(price).alias("price_min"),
        F.avg(price).alias("price_mean"),
        F.sum(qty).alias("qty_sum"),
        F.count(qty).alias("qty_count"),
        F.avg(qty).alias("qty_mean"),
        F.sum(price * qty).alias("amount_sum"),
        F.sum(buy).alias("buy_qty_sum"),
        F.avg(buy).alias("buy_qty_mean"),
        F.sum(sell).alias("sell_qty_sum"),
        F.avg(sell).alias("sell_qty_mean"),
        F.sum(F.when(~maker, 1).otherwise(0)).alias("buy_trade_sum"),
        F.sum(F.when(maker, 1).otherwise(0)).alias("sell_trade_sum"),
    )


# ---- bars that take in more trades -------------------------------------------

#: Sums and extremes that merge; the rest of a bar follows from them.
_EARLY, _LATE = "_first_order", "_last_order"
_SUMS = ("_price", "_n_price", "qty_sum", "qty_count", "amount_sum", "buy_qty_sum", "_n_buy", "sell_qty_sum", "_n_sell", "buy_trade_sum", "sell_trade_sum")


def partial_bars(ticks: DataFrame, by: list[str], ts: str = "timestamp", trade_id: str = "trade_id", unit: str = "hour", out: str = "date") -> DataFrame:
    """What the trades of a bar add up to, per ``by`` and bar, in a form that ``merge_bars`` can merge."""
    price, qty, maker = F.col("price").cast("double"), F.col("qty").cast("double"), F.col("is_buyer_maker")
    buy, sell = F.when(~maker, qty).otherwise(0.0), F.when(maker, qty).otherwise(0.0)
    order = trade_order(F.col(ts), F.col(trade_id))
    sums = (F.sum(price), F.count(price), F.sum(qty), F.count(qty), F.sum(price * qty), F.sum(buy), F.count(buy), F.sum(sell), F.count(sell),
            F.sum(F.when(~maker, 1).otherwise(0)), F.sum(F.when(maker, 1).otherwise(0)))
    return ticks.groupBy(*by, F.date_trunc(unit, F.col(ts)).alias(out)).agg(
        F.min_by(price, order).alias("price_first"), F.min(order).alias(_EARLY), F.max_by(price, order).alias("price_last"), F.max(order).alias(_LATE),
        F.max(price).alias("price_max"), F.min(price).alias("price_min"), *[s.alias(n) for n, s in zip(_SUMS, sums)])


def merge_bars(partials: DataFrame, by: list[str], out: str = "date") -> DataFrame:
    """Bars from any number of partial bars; the columns of ``ticks_to_bars``."""
    merged = partials.groupBy(*by, out).agg(
        F.min_by("price_first", _EARLY).alias("price_first"), F.max_by("price_last", _LATE).alias("price_last"),
        F.max("price_max").alias("price_max"), F.min("price_min").alias("price_min"), *[F.sum(n).alias(n) for n in _SUMS])
    mean = lambda total, n: F.try_divide(F.col(total), F.col(n).cast("double"))
    means = {"price_mean": mean("_price", "_n_price"), "qty_mean": mean("qty_sum", "qty_count"),
             "buy_qty_mean": mean("buy_qty_sum", "_n_buy"), "sell_qty_mean": mean("sell_qty_sum", "_n_sell")}
    return merged.withColumns(means).select(*by, out, *BAR_COLUMNS)
