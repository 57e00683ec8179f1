"""Order-flow features of trade bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.over import Layout
from ..functions.scalar import dbl, flag, ratio, sign
from ..operators.fit import quantile_flag

EPS = 1e-8

# Rolling means per column.
FLOW_MEANS = {
    "price_mean": (6, 12, 24, 48, 72, 96, 168),
    "buy_qty_sum": (6, 12, 24),
    "sell_qty_sum": (6, 24),
    "buy_sell_ratio": (6, 24),
}


def orderbook_features(df: DataFrame, ly: Layout, train=None) -> DataFrame:
    """Ratios, imbalances, z-scores, flags, moving averages, lags and gaps of trade bars.

    ``train`` (a boolean column) restricts the low-liquidity quantile to training rows; by
    default it looks at the whole series.
    """
    ly = ly.layered()
    c, eps = dbl, F.lit(EPS)
    buy, sell = c("buy_qty_sum"), c("sell_qty_sum")
    n_buy, n_sell = c("buy_trade_sum"), c("sell_trade_sum")
    spread = ratio(c("price_max") - c("price_min"), c("price_mean"))
    x = ly.add(df, {
        "_day": ly.sum("price_mean", 24),
        "buy_sell_ratio": ratio(buy, sell + eps),
        "volatility": spread,
        "price_change": c("price_last") - c("price_first"),
        "pseudo_spread": spread,
        "avg_trade_size": ratio(c("qty_sum"), c("qty_count")),
        "avg_buy_size": ratio(buy, n_buy + eps),
        "avg_sell_size": ratio(sell, n_sell + eps),
        "buy_trade_ratio": ratio(n_buy, n_buy + n_sell + eps),
        "buy_sell_imbalance": buy - sell,
        "order_imbalance_norm": ratio(buy - sell, buy + sell + eps),
    })
    layer = {
        f"{name}_MA_t_{n}": ly.mean(name, n) if n <= 24 else ly.mean_of_parts("_day", n, 24)
        for name, sizes in FLOW_MEANS.items() for n in sizes
    }
    layer |= {f"{name}_Lag_t_{n}": ly.lag(c(name), n) for name in ("price_mean", "buy_qty_sum", "sell_qty_sum") for n in (1, 3)}
    layer |= {
        "delta_buy_qty": ly.diff(buy), "delta_sell_qty": ly.diff(sell),
        "delta_buy_sell_ratio": ly.diff("buy_sell_ratio"),
        "buy_pressure_momentum": ly.diff("buy_sell_ratio", 2),
        "depth_imbalance": F.col("avg_buy_size") - F.col("avg_sell_size"),
        "buy_qty_z": ly.zscore(buy, 24, 0.0), "sell_qty_z": ly.zscore(sell, 24, 0.0),
        "buy_sell_diff_smooth": ly.mean("buy_sell_imbalance", 6),
        "ratio_short_long": ratio(ly.mean("buy_sell_ratio", 6), ly.mean("buy_sell_ratio", 72) + eps),
        "buy_dominant_flag": flag(F.col("order_imbalance_norm") > 0),
        "imbalance_flip_flag": flag(
            F.abs(sign(F.col("buy_sell_imbalance")) - sign(ly.lag("buy_sell_imbalance"))) > 0),
        "low_liquidity_flag": quantile_flag(ly, "volatility", 0.8, ">", train),
        "_spread": ly.ffill("pseudo_spread"),
    }
    x = ly.add(x, layer)
    layer = {
        "spread_change_rate": ly.pct_change("_spread"),
        "buy_sell_diff_smooth_rate": ly.diff("buy_sell_diff_smooth"),
        "buy_overheat_flag": flag(F.col("buy_qty_z") > 2.0),
        "sell_overheat_flag": flag(F.col("sell_qty_z") < -2.0),
    }
    layer |= {f"{name}_MA_slope": ly.diff(f"{name}_MA_t_24") for name in FLOW_MEANS}
    layer |= {
        f"{name}_Diff_t_{n}": c(name) - F.col(f"{name}_MA_t_{n}")
        for name in ("price_mean", "buy_qty_sum", "sell_qty_sum") for n in (6, 24)
    }
    x = ly.add(x, layer)
    return x.withColumn("spread_spike_flag", flag(F.abs(F.col("spread_change_rate")) > 0.5)).drop("_spread", "_day")
