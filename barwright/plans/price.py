"""Price, volume, hysteresis and deviation features of an OHLCV table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.calendar import calendar_columns
from ..functions.over import Layout
from ..functions.scalar import clip, dbl, flag, ratio, sign, zero_to
from ..operators.clean import clip_columns, drop_null_rows, drop_sparse_columns
from ..operators.scan import Atr, Macd, Rsi, RunningQuantile, SeededEma, scan
from ..session import cut_lineage

MA_WINDOWS = (6, 12, 24, 48, 72, 96, 168, 336)
DAY = 24
EPS = 1e-8

# Bounds applied to the finished columns.
PRICE_BOUNDS = {
    "log_return_1h": (-0.2, 0.2), "log_return_6h": (-0.5, 0.5), "log_return_12h": (-0.8, 0.8),
    "momentum_6h": (-1e5, 1e5), "acceleration_6h": (-1e5, 1e5),
    "volatility_6h": (0.0, 1.0), "volatility_change_6h": (-1.0, 1.0),
    "trend_strength_6_24": (-2.0, 2.0), "trend_slope_6h": (-1.0, 1.0),
    "bb_width_20": (0.0, 1.0), "bb_width_change_6": (-1.0, 1.0),
    "vol_norm_6h": (0.0, 10.0), "flow_strength_6h": (-10.0, 10.0), "vol_price_corr_6h": (-1.0, 1.0),
    "z_move_6h": (-10.0, 10.0), "volume_pchg_6h": (-1.0, 5.0), "price_volume_ratio_6h": (-50.0, 50.0),
    "bb_compression_ratio": (0.0, 10.0), "bb_reexpansion_speed_6h": (-5.0, 5.0),
}


def date_features(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns(calendar_columns(F.col(ts)))


def settle(df: DataFrame, drop: str, always: tuple[str, ...]) -> DataFrame:
    """End of a bundle.  ``none`` keeps everything; ``rows`` drops incomplete rows; ``all``
    first drops columns that are mostly missing, which needs one aggregate over the result
    (the lineage is cut so the features are not computed twice)."""
    if drop == "all":
        df = drop_sparse_columns(cut_lineage(df), 0.5, always)
    return df if drop == "none" else drop_null_rows(df)


def indicator_base(df: DataFrame, ly: Layout) -> DataFrame:
    """Narrow window columns followed by one grouped pass for every recurrence."""
    ly = ly.layered()
    close = dbl("close")
    base = ly.add(df, {
        "_c": ly.ffill(close),
        "_day": ly.sum(close, DAY),
        "bb_width_20": ratio(
            F.lit(2.0) * ly.std(close, 20, 1), F.abs(ly.mean(close, 20, 1)) + F.lit(EPS)),
        "_bb": ratio(
            ly.std(close, 20, 10) * F.lit(2.0), F.abs(ly.mean(close, 20, 10)) + F.lit(EPS)),
    })
    base = ly.add(base, {"ret_1h": ly.pct_change("_c")})
    base = ly.add(base, {"_std24": ly.std("ret_1h", 24, 12)})
    return scan(base, ly, [
        Rsi("close"), Macd("close"), SeededEma("close", "EMA_12", 12), SeededEma("close", "EMA_26", 26),
        Atr("high", "low", "close", "ATR24", 24),
        RunningQuantile("bb_width_20", "_bb_med_168", 0.5, 24, 168),
        RunningQuantile("_std24", "_vol_med", 0.5, 24),
        RunningQuantile("_bb", "_bb_q20", 0.2, 100),
    ])


def price_features(df: DataFrame, ly: Layout, drop: str = "all") -> DataFrame:
    """About a hundred price and volume columns from ``close, high, low`` and, where present,
    ``volume_USD``, ``volume_ETH`` and ``ATR``.

    Windows are layered so every layer is one Window node over the same partitioning and
    order.
    """
    ly = ly.layered()
    has = set(df.columns)
    usd, eth = "volume_USD" in has, "volume_ETH" in has
    close, high, low = dbl("close"), dbl("high"), dbl("low")
    given = list(df.columns)

    first = {f"log_return_{n}h": ly.log_return(close, n) for n in (1, 3, 6, 24)}
    first |= {f"momentum_{n}h": ly.diff(close, n) for n in (6, 12)}
    first |= {f"volatility_{n}h": ly.std(close, n) for n in (6, 12)}
    first |= {
        f"MA_t_{n}": ly.mean(close, n) if n <= DAY else ly.mean_of_parts("_day", n, DAY) for n in MA_WINDOWS}
    first |= {"ma_6h": ly.mean(close, 6), "ma_24h": ly.mean(close, 24)}
    first |= {f"Lag_t_{n}": ly.lag(close, n) for n in (1, 3)}
    first |= {f"ma_{n}": ly.mean(close, n, 1) for n in (6, 24, 72)}
    mid, dev = ly.mean(close, 20), ly.std_pop(close, 20)
    first |= {"upper": mid + dev * 2.0, "middle": mid, "lower": mid - dev * 2.0}
    first |= {
        "ret_6h": ly.pct_change("_c", 6), "ret_12h": ly.pct_change("_c", 12),
        "_chg": ly.diff(close), "_hh": ly.max(high, 14), "_ll": ly.min(low, 14),
        "_max_before": ly.fold("max", F.max, -24, -1, close), "_min_before": ly.fold("min", F.min, -24, -1, close),
        "_bbw": ly.ffill("bb_width_20"), "_bbp": ly.ffill("_bb"),
    }
    if usd:
        first["volume_zscore_24h"] = ly.zscore("volume_USD", 24, 1e-9)
    if eth:
        first |= {"_ve": ly.ffill(dbl("volume_ETH")), "volume_6h_mean": ly.mean("volume_ETH", 6, 1)}
    x = ly.add(indicator_base(df, ly), first)

    col = F.col
    step = {n: ly.diff(f"MA_t_{n}") for n in MA_WINDOWS}
    r1 = F.coalesce(col("log_return_1h"), F.lit(0.0))
    rise, fall = F.greatest(col("_chg"), F.lit(0.0)), F.greatest(-col("_chg"), F.lit(0.0))
    moved = col("_chg").isNotNull()
    raw_k = F.when(col("_hh") == col("_ll"), F.when(col("_hh").isNotNull() & close.isNotNull(), 0.0)).otherwise(
        F.try_divide(close - col("_ll"), col("_hh") - col("_ll")) * 100.0)
    second = {f"MA_t_{n}_slope": step[n] for n in MA_WINDOWS}
    second |= {
        "acceleration_6h": ly.diff("momentum_6h"),
        "_vol6": ly.ffill("volatility_6h"),
        "trend_slope_6h": ly.diff("ma_6h"),
        "_sgn": sign(F.coalesce(col("_chg"), F.lit(0.0))),
        "_k": raw_k,
        "_gain": ly.mean(F.when(moved, rise), 14, 1), "_loss": ly.mean(F.when(moved, fall), 14, 1),
        "momentum_persistence_flag_cont": ly.count_true(col("log_return_1h") > 0, 5),
        "breakout_flag_cont": ly.count_true(close > col("upper"), 3),
        "_r1_std": ly.std(r1, 6, 1),
        "bb_width_change_6": ly.pct_change("_bbw", 6),
        "_bb_pct6": ly.pct_change("_bbp", 6),
    }
    for a, b in ((6, 24), (12, 48), (24, 72)):
        second[f"MA_{a}_{b}_cross_flag"] = ly.step_of_flag(flag(col(f"MA_t_{a}") > col(f"MA_t_{b}")))
    if eth:
        second |= {"volume_pchg_6h": ly.pct_change("_ve", 6), "_r1_mean": ly.mean("log_return_1h", 6, 3)}
    x = ly.add(x, second)

    rsi = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ratio(col("_gain"), col("_loss") + F.lit(EPS)))
    third = {
        "sign_entropy_24": ly.sign_entropy("_sgn", 24), "sign_entropy_12": ly.sign_entropy("_sgn", 12),
        "volatility_change_6h": ly.pct_change("_vol6", 6),
        "_slowk": ly.mean("_k", 3),
        "_rsi": rsi,
    }
    third |= {f"_pad_{n}": ly.ffill(f"MA_t_{n}_slope") for n in MA_WINDOWS}
    if eth:
        third["vol_price_corr_6h"] = ly.corr("volume_ETH", "_r1_mean", 6, 3)
    x = ly.add(x, third)

    fourth = {f"MA_t_{n}_slope_pct_change": ly.pct_change(f"_pad_{n}") for n in MA_WINDOWS}
    fourth |= {f"sign_entropy_{n}_ma3": ly.mean(f"sign_entropy_{n}", 3) for n in (12, 24)}
    fourth |= {
        "slowd": ly.mean("_slowk", 3),
        "rsi_overbought_flag": ly.latch(col("_rsi"), 70.0, 60.0),
        "rsi_oversold_flag": ly.latch(F.lit(100.0) - col("_rsi"), 70.0, 60.0),
    }
    x = ly.add(x, fourth)

    slope = lambda n: col(f"MA_t_{n}_slope")
    bend = lambda n: col(f"MA_t_{n}_slope_pct_change")
    ma = lambda n: col(f"MA_t_{n}")
    last = {f"sign_entropy_{n}_ma3_slope": ly.diff(f"sign_entropy_{n}_ma3") for n in (12, 24)}
    last |= {
        "trend_strength_6_24": col("ma_6h") - col("ma_24h"),
        "BB_width": col("upper") - col("lower"),
        "EMA_ratio": ratio(col("EMA_12"), col("EMA_26") + F.lit(1e-9)),
        "slowk": F.when(col("slowd").isNotNull(), col("_slowk")),
        "Diff_t_6": close - ma(6), "Diff_t_24": close - ma(24),
        "MA_convergence_divergence": ma(6) - ma(24),
        "MA_6_24_72_trend_flag": flag(
            (ma(6) > ma(24)) & (ma(24) > ma(72)) & (slope(6) > 0) & (slope(24) > 0) & (slope(72) > 0)),
        "pullback_condition_cont": flag((close > ma(24)) & col("RSI").between(45, 65)).cast("double"),
        "z_move_6h": clip(ratio(r1, zero_to(col("_r1_std"), EPS)), -10, 10),
        "bb_compression_ratio": ratio(col("bb_width_20"), col("_bb_med_168") + F.lit(EPS)),
        "bb_reexpansion_speed_6h": col("bb_width_change_6"),
        "ma_order_flag": flag((col("ma_6") > col("ma_24")) & (col("ma_24") > col("ma_72"))),
        "high_vol_flag": flag(col("_std24") > col("_vol_med") * 1.5),
        "squeeze_flag": flag(col("_bb") < col("_bb_q20")),
        "squeeze_reexp_flag": flag(col("_bb_pct6") > 0.3),
        "break_up_flag": flag(close > col("_max_before")),
        "break_down_flag": flag(close < col("_min_before")),
    }
    for a, b in ((6, 24), (12, 48), (24, 72)):
        last[f"MA_slope_{a}_{b}_change_flag"] = flag(slope(a) * slope(b) < 0)
        last[f"MA_slope_pct_change_{a}_{b}_change_flag"] = flag(bend(a) * bend(b) < 0)
    if "ATR" in has:
        last["trend_strength_vol_flag_cont"] = ratio(ma(6) - ma(24), dbl("ATR") + F.lit(1e-9))
    if usd:
        loud = col("volume_zscore_24h") > 1.0
        last["bullish_volume_condition_cont"] = flag(loud & (col("log_return_1h") > 0)).cast("double")
        last["bearish_volume_condition_cont"] = flag(loud & (col("log_return_1h") < 0)).cast("double")
    if eth:
        norm = ratio(dbl("volume_ETH"), col("volume_6h_mean") + F.lit(EPS))
        last["vol_norm_6h"] = norm
        last["flow_strength_6h"] = norm * sign(F.coalesce(col("log_return_6h"), F.lit(0.0)))
        last["price_volume_ratio_6h"] = ratio(
            col("log_return_6h"), zero_to(col("volume_pchg_6h"), EPS) + F.lit(EPS))
    x = ly.add(x, last)
    made = [c for c in x.columns if c not in given and not c.startswith("_")]
    out = clip_columns(x.select(*given, *made), PRICE_BOUNDS)
    return settle(out, drop, (*ly.keys, *ly.order))


# ---- persistence -----------------------------------------------------------

PERSISTENT_FLAGS = (
    "MA_6_24_cross_flag", "MA_12_48_cross_flag", "MA_24_72_cross_flag", "MA_6_24_72_trend_flag",
    "MA_slope_6_24_change_flag", "MA_slope_12_48_change_flag",
)


def all_of_last(ly: Layout, cond, n: int):
    """1 when the condition held on each of the last ``n`` rows."""
    return flag(ly.count_true(cond, n) == n)


def persistence_features(df: DataFrame, ly: Layout) -> DataFrame:
    """Persistence flags over whatever base columns are present."""
    ly = ly.layered()
    has, col = set(df.columns), F.col
    out = {f"{c}_hysteresis": flag(ly.sum(c, 4, 3) >= 3) for c in PERSISTENT_FLAGS if c in has}
    if {"close", "MA_t_24"} <= has:
        ma = zero_to(dbl("MA_t_24"), None)
        out["close_MA_24_deviation_1pct_persist_3h"] = all_of_last(
            ly, F.abs(ratio(dbl("close") - dbl("MA_t_24"), ma)) >= 0.01, 3)
    if "momentum_6h" in has:
        out["momentum_6h_positive_persist_3h"] = all_of_last(ly, col("momentum_6h") > 1e-9, 3)
    if "active_receivers_diff" in has:
        out["active_receivers_diff_positive_persist_3h"] = all_of_last(ly, col("active_receivers_diff") > 1e-9, 3)
    if "active_ratio" in has:
        out["active_ratio_above_1.5_persist_3h"] = all_of_last(ly, col("active_ratio") > 1.5, 3)
    return ly.add(df, out)


def price_features_with_hysteresis(df: DataFrame, ly: Layout, drop: str = "all") -> DataFrame:
    """Price features, incomplete rows removed, then persistence flags over what remains."""
    return persistence_features(price_features(df, ly, drop), ly)


def deviation_features(df: DataFrame, ly: Layout, drop: str = "rows") -> DataFrame:
    """Distance from eight moving averages, its rolling statistics, signs and turns; whale and
    depth columns where their inputs exist.  Expects ``close`` and ``MA_t_*``."""
    ly = ly.layered()
    has, col = set(df.columns), F.col
    names = [f"deviation_pct_MA_{n}" for n in MA_WINDOWS]
    layer = {
        d: ratio(dbl("close") - dbl(f"MA_t_{n}"), zero_to(dbl(f"MA_t_{n}"), None))
        for d, n in zip(names, MA_WINDOWS)
    }
    book = {"buy_qty_sum", "sell_qty_sum"} <= has
    if book:
        layer["total_orderbook_depth_proxy"] = dbl("buy_qty_sum") + dbl("sell_qty_sum")
    x = ly.add(df, layer)
    layer = {}
    for d in names:
        for n in (6, 24):
            layer[f"{d}_MA_{n}"] = ly.mean(d, n)
            layer[f"{d}_std_{n}"] = ly.std(d, n)
        layer[f"{d}_sign"] = sign(col(d)).cast("int")
        layer[f"{d}_slope"] = ly.diff(d)
    if "whale_tx_count" in has:
        w = "whale_tx_count"
        layer |= {
            f"{w}_MA_24": ly.mean(w, 24), f"{w}_deviation_MA_24": dbl(w) - ly.mean(w, 24),
            f"{w}_sum_72h": ly.sum(w, 72), f"{w}_max_72h": ly.max(w, 72),
        }
    if book:
        t = "total_orderbook_depth_proxy"
        layer |= {"_t": ly.ffill(t), f"{t}_MA_6": ly.mean(t, 6), f"{t}_deviation_MA_6": col(t) - ly.mean(t, 6)}
    x = ly.add(x, layer)
    layer = {f"{d}_slope_change_flag": ly.sign_changed(f"{d}_slope") for d in names}
    if book:
        layer["total_orderbook_depth_proxy_pct_change"] = ly.pct_change("_t")
    x = ly.add(x, layer).drop("_t")
    return settle(x, drop, (*ly.keys, *ly.order))
