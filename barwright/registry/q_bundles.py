"""Feature bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import macro as M
from ..plans import onchain, pipeline
from ..plans.orderbook import FLOW_MEANS, orderbook_features
from ..plans.price import MA_WINDOWS, PERSISTENT_FLAGS, PRICE_BOUNDS, deviation_features, persistence_features, price_features
from . import inputs as I
from .core import finish, query, rounded
from .q_tables import SENTIMENT, sentiment
from .q_windows import seeded
from .sql import Win, clip, finite, flag, ratio, scan_ema

PAIRS = ((6, 24), (12, 48), (24, 72))

# ---- price -----------------------------------------------------------------


def price_ctes(src: str, key: str, tag: str = "") -> tuple[str, list[str], list[str]]:
    """CTEs ending in ``price<tag>`` (all rows), integer columns, double columns."""
    w = Win(key)
    t = lambda n: f"{n}{tag}"
    bb = ratio(f"{w.std('close', 20, 10)} * 2", f"abs({w.mean('close', 20, 10)}) + 1e-8")
    bw = ratio(f"2.0 * {w.std('close', 20, 1)}", f"abs({w.mean('close', 20, 1)}) + 1e-8")
    layer1 = {f"log_return_{n}h": w.logret("close", n) for n in (1, 3, 6, 24)}
    layer1 |= {f"ret_{n}h": w.pct("close", n) for n in (1, 6, 12)}
    layer1 |= {f"momentum_{n}h": w.diff("close", n) for n in (6, 12)}
    layer1 |= {f"volatility_{n}h": w.std("close", n) for n in (6, 12)}
    layer1 |= {f'"MA_t_{n}"': w.mean("close", n) for n in MA_WINDOWS}
    layer1 |= {"ma_6h": w.mean("close", 6), "ma_24h": w.mean("close", 24)}
    layer1 |= {f'"Lag_t_{n}"': w.lag("close", n) for n in (1, 3)}
    layer1 |= {f"ma_{n}": w.mean("close", n, 1) for n in (6, 24, 72)}
    layer1 |= {
        "upper": f"{w.mean('close', 20)} + 2 * {w.std_pop('close', 20)}", "middle": w.mean("close", 20),
        "lower": f"{w.mean('close', 20)} - 2 * {w.std_pop('close', 20)}",
        "hh": w.max("high", 14), "ll": w.min("low", 14), "chg": w.diff("close"), "prev": w.lag("close"),
        "top24": f"max(close) {w.rows(24, -1)}", "low24": f"min(close) {w.rows(24, -1)}",
        "volume_zscore_24h": w.zscore('"volume_USD"', 24, "1e-9"),
        "volume_6h_mean": w.mean('"volume_ETH"', 6, 1), "volume_pchg_raw": w.pct('"volume_ETH"', 6),
        "bb_width_20": bw, "bb": bb,
    }
    ma = lambda n: f'"MA_t_{n}"'
    layer2 = {f'"MA_t_{n}_slope"': w.diff(ma(n)) for n in MA_WINDOWS}
    gain = "CASE WHEN chg IS NOT NULL THEN greatest(chg, 0.0) END"
    loss = "CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0.0) END"
    layer2 |= {
        "acceleration_6h": w.diff("momentum_6h"), "volatility_change_6h": w.pct("volatility_6h", 6),
        "trend_slope_6h": w.diff("ma_6h"), "sgn": "sign(coalesce(chg, 0.0))",
        "k": "CASE WHEN hh = ll THEN 0.0 ELSE 100.0 * (close - ll) / (hh - ll) END",
        "rsi2": f"100.0 - 100.0 / (1.0 + {w.mean(gain, 14, 1)} / ({w.mean(loss, 14, 1)} + 1e-8))",
        "momentum_persistence_flag_cont": w.count_true("log_return_1h > 0", 5),
        "breakout_flag_cont": w.count_true("close > upper", 3),
        "r1sd": w.std("coalesce(log_return_1h, 0.0)", 6, 1), "r1mean": w.mean("log_return_1h", 6, 3),
        "bb_width_change_6": w.pct("bb_width_20", 6), "bbpct": w.pct("bb", 6),
        "sd24": w.std("ret_1h", 24, 12), "q20": w.expanding("bb", 0.2, 100), "med168": w.quantile("bb_width_20", 0.5, 168, 24),
    }
    layer2 |= {f'"MA_{a}_{b}_cross_flag"': w.step(flag(f"{ma(a)} > {ma(b)}")) for a, b in PAIRS}
    sl = lambda n: f'"MA_t_{n}_slope"'
    pc = lambda n: f'"MA_t_{n}_slope_pct_change"'
    fr = w.last(6)
    both = 'CASE WHEN r1mean IS NOT NULL THEN "volume_ETH" END'
    varies = f"max({both}) {fr} > min({both}) {fr} AND max(r1mean) {fr} > min(r1mean) {fr}"
    layer3 = {pc(n): w.pct(sl(n)) for n in MA_WINDOWS}
    layer3 |= {
        "sign_entropy_24": w.entropy("sgn", 24), "sign_entropy_12": w.entropy("sgn", 12), "sk": w.mean("k", 3),
        "vol_price_corr_6h": f'(CASE WHEN count(r1mean) {fr} >= 3 AND {varies} THEN corr("volume_ETH", r1mean) {fr} END)',
        "med": w.expanding("sd24", 0.5, 24),
        "rsi_overbought_flag": w.latch("rsi2", 70, 60), "rsi_oversold_flag": w.latch("100.0 - rsi2", 70, 60),
    }
    layer4 = {f"sign_entropy_{n}_ma3": w.mean(f"sign_entropy_{n}", 3) for n in (12, 24)} | {"slowd": w.mean("sk", 3)}
    loud = "volume_zscore_24h > 1.0"
    norm = ratio('"volume_ETH"', "volume_6h_mean + 1e-8")
    layer5 = {f"sign_entropy_{n}_ma3_slope": w.diff(f"sign_entropy_{n}_ma3") for n in (12, 24)}
    layer5 |= {
        "trend_strength_6_24": "ma_6h - ma_24h", '"BB_width"': "upper - lower",
        "slowk": "CASE WHEN slowd IS NOT NULL THEN sk END",
        '"Diff_t_6"': f"close - {ma(6)}", '"Diff_t_24"': f"close - {ma(24)}", '"MA_convergence_divergence"': f"{ma(6)} - {ma(24)}",
        '"MA_6_24_72_trend_flag"': flag(f"{ma(6)} > {ma(24)} AND {ma(24)} > {ma(72)} AND {sl(6)} > 0 AND {sl(24)} > 0 AND {sl(72)} > 0"),
        "z_move_6h": clip("coalesce(log_return_1h, 0.0) / (CASE WHEN r1sd = 0 THEN 1e-8 ELSE r1sd END)", -10, 10),
        "bb_compression_ratio": ratio("bb_width_20", "med168 + 1e-8"), "bb_reexpansion_speed_6h": "bb_width_change_6",
        "ma_order_flag": flag("ma_6 > ma_24 AND ma_24 > ma_72"), "high_vol_flag": flag("sd24 > med * 1.5"),
        "squeeze_flag": flag("bb < q20"), "squeeze_reexp_flag": flag("bbpct > 0.3"),
        "break_up_flag": flag("close > top24"), "break_down_flag": flag("close < low24"),
        "bullish_volume_condition_cont": f"CAST({flag(f'{loud} AND log_return_1h > 0')} AS DOUBLE)",
        "bearish_volume_condition_cont": f"CAST({flag(f'{loud} AND log_return_1h < 0')} AS DOUBLE)",
        "vol_norm_6h": norm, "flow_strength_6h": f"{norm} * sign(coalesce(log_return_6h, 0.0))",
        "volume_pchg_6h": "volume_pchg_raw",
        "price_volume_ratio_6h": ratio("log_return_6h", "(CASE WHEN volume_pchg_raw = 0 THEN 1e-8 ELSE volume_pchg_raw END) + 1e-8"),
    }
    for a, b in PAIRS:
        layer5[f'"MA_slope_{a}_{b}_change_flag"'] = flag(f"{sl(a)} * {sl(b)} < 0")
        product = f"CASE WHEN isnan({pc(a)} * {pc(b)}) THEN NULL ELSE {pc(a)} * {pc(b)} END"
        layer5[f'"MA_slope_pct_change_{a}_{b}_change_flag"'] = flag(f"{product} < 0")
    text, prior = f", {t('b0')} AS MATERIALIZED (SELECT *, {w.rn()} AS rn FROM {src})", t("b0")
    for i, layer in enumerate((layer1, layer2, layer3, layer4, layer5), 1):
        text += f",\n{t(f'b{i}')} AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {n}' for n, e in layer.items())} FROM {prior})"
        prior = t(f"b{i}")
    b1 = t("b1")
    rec = f""",
{t('ud')} AS MATERIALIZED (SELECT {key}, rn, greatest(chg, 0.0) AS up, greatest(-chg, 0.0) AS down,
  greatest(high - low, abs(high - prev), abs(low - prev)) AS tr FROM {b1} WHERE prev IS NOT NULL),
{t('rs')}({key}, rn, u, d) AS (
  SELECT {key}, 15::BIGINT, avg(up), avg(down) FROM {t('ud')} WHERE rn <= 15 GROUP BY {key} HAVING count(*) = 14
  UNION ALL SELECT b.{key}, b.rn, (r.u * 13 + b.up) / 14, (r.d * 13 + b.down) / 14
  FROM {t('rs')} r JOIN {t('ud')} b ON b.{key} = r.{key} AND b.rn = r.rn + 1),
{t('atr')}({key}, rn, a) AS (
  SELECT {key}, 25::BIGINT, avg(tr) FROM {t('ud')} WHERE rn <= 25 GROUP BY {key} HAVING count(*) = 24
  UNION ALL SELECT b.{key}, b.rn, (r.a * 23 + b.tr) / 24 FROM {t('atr')} r JOIN {t('ud')} b ON b.{key} = r.{key} AND b.rn = r.rn + 1),
{seeded(t('e12'), b1, 'close', 12, 12, 'v', key)}, {seeded(t('e26'), b1, 'close', 26, 26, 'v', key)},
{seeded(t('mf'), b1, 'close', 12, 26, 'v', key)},
{t('ml')} AS MATERIALIZED (SELECT f.{key}, f.rn, f.v - s.v AS m FROM {t('mf')} f JOIN {t('e26')} s USING ({key}, rn)),
{seeded(t('mg'), t('ml'), 'm', 9, 34, 'v', key)},
{t('price')} AS (
  SELECT b.*, CASE WHEN u + d = 0 THEN 0.0 ELSE 100 * u / (u + d) END AS "RSI", CASE WHEN mg.v IS NOT NULL THEN m END AS "MACD",
         mg.v AS "MACD_signal", m - mg.v AS "MACD_hist", e12.v AS "EMA_12", e26.v AS "EMA_26", e12.v / (e26.v + 1e-9) AS "EMA_ratio",
         a AS "ATR24", CAST({flag(f'close > {ma(24)} AND (CASE WHEN u + d = 0 THEN 0.0 ELSE 100 * u / (u + d) END) BETWEEN 45 AND 65')} AS DOUBLE)
         AS pullback_condition_cont
  FROM {t('b5')} b LEFT JOIN {t('rs')} USING ({key}, rn) LEFT JOIN {t('atr')} USING ({key}, rn)
  LEFT JOIN {t('e12')} e12 USING ({key}, rn) LEFT JOIN {t('e26')} e26 USING ({key}, rn)
  LEFT JOIN {t('ml')} USING ({key}, rn) LEFT JOIN {t('mg')} mg USING ({key}, rn))"""
    hidden = {"hh", "ll", "chg", "prev", "top24", "low24", "volume_pchg_raw", "bb", "sgn", "k", "rsi2", "r1sd", "r1mean", "bbpct",
              "sd24", "q20", "med168", "sk", "med"}
    names = [n for layer in (layer1, layer2, layer3, layer4, layer5) for n in layer if n not in hidden]
    names += ['"RSI"', '"MACD"', '"MACD_signal"', '"MACD_hist"', '"EMA_12"', '"EMA_26"', '"EMA_ratio"', '"ATR24"', "pullback_condition_cont"]
    ints = [n for n in names if n.strip('"').endswith("_flag")]
    doubles = [n for n in names if n not in ints]
    clipped = ", ".join(
        f"{clip(n, *PRICE_BOUNDS[n])} AS {n}" if n in PRICE_BOUNDS else n for n in names)
    given = f"{t('price')}.* EXCLUDE ({', '.join(sorted(hidden) + names + ['rn'])})"
    full = " AND ".join(f"{n} IS NOT NULL" for n in names)
    text += rec + f""",
{t('priced_out')} AS MATERIALIZED (SELECT {given}, {clipped} FROM {t('price')} WHERE {full})"""
    return text, ints, doubles


PX, PX_INTS, PX_DOUBLES = price_ctes("daily", "series")
DAILY_GIVEN = ["high", "low", "close", '"volume_ETH"', '"volume_USD"']


@query("b2_price_features", finish(I.DAILY_SQL + PX, "priced_out", ["series", "date", *PX_INTS], [*DAILY_GIVEN, *PX_DOUBLES]))
def b2(spark, sf):
    return rounded(price_features(I.ohlcv_daily(spark, sf), I.DAILY, drop="rows"))


D = Win("series")
BASE9 = [c for c in PERSISTENT_FLAGS]
HYST = {f'"{c}_hysteresis"': flag(f'{D.sum(chr(34) + c + chr(34), 4, 3)} >= 3') for c in BASE9}
HYST |= {
    '"close_MA_24_deviation_1pct_persist_3h"': flag(f"""{D.count_true('abs((close - "MA_t_24") / nullif("MA_t_24", 0)) >= 0.01', 3)} = 3"""),
    '"momentum_6h_positive_persist_3h"': flag(f"{D.count_true('momentum_6h > 1e-9', 3)} = 3"),
}


@query("b9_persistence_features", finish(
    I.DAILY_SQL + PX + f", x AS (SELECT series, date, {', '.join(f'{e} AS {n}' for n, e in HYST.items())} FROM priced_out)",
    "x", ["series", "date", *HYST], []))
def b9(spark, sf):
    base = price_features(I.ohlcv_daily(spark, sf), I.DAILY, drop="rows")
    x = persistence_features(base, I.DAILY)
    return x.select("series", "date", *[n.strip('"') for n in HYST])


DEV = [f'"deviation_pct_MA_{n}"' for n in MA_WINDOWS]
q = lambda d, tail: f'"{d.strip(chr(34))}_{tail}"'
L1 = {d: ratio(f'close - "MA_t_{n}"', f'nullif("MA_t_{n}", 0)') for d, n in zip(DEV, MA_WINDOWS)}
L2 = {}
for d in DEV:
    for n in (6, 24):
        L2[q(d, f"MA_{n}")], L2[q(d, f"std_{n}")] = D.mean(d, n), D.std(d, n)
    L2[q(d, "slope")] = D.diff(d)
SIGNS = {q(d, "sign"): f"CAST(sign({d}) AS INT)" for d in DEV}
TURNS = {
    q(d, "slope_change_flag"): f"CASE WHEN {q(d, 'slope')} IS NOT NULL AND {D.lag(q(d, 'slope'))} IS NOT NULL AND "
                               f"sign({q(d, 'slope')}) = sign({D.lag(q(d, 'slope'))}) THEN 0 ELSE 1 END" for d in DEV}
cols = lambda layer: ", ".join(f"{e} AS {n}" for n, e in layer.items())
DEV_SQL = I.DAILY_SQL + PX + f""",
d1 AS (SELECT *, {cols(L1)} FROM priced_out), d2 AS (SELECT *, {cols(L2 | SIGNS)} FROM d1), d3 AS (SELECT *, {cols(TURNS)} FROM d2)"""


@query("b10_deviation_features", finish(
    DEV_SQL, "d3", ["series", "date", *SIGNS, *TURNS], [*L1, *L2],
    where="WHERE " + " AND ".join(f"{n} IS NOT NULL" for n in (*L1, *L2, *SIGNS))))
def b10(spark, sf):
    base = price_features(I.ohlcv_daily(spark, sf), I.DAILY, drop="rows")
    x = deviation_features(base, I.DAILY)
    return rounded(x.select("series", "date", *[n.strip('"') for n in (*L1, *L2, *SIGNS, *TURNS)]))


# ---- order flow ------------------------------------------------------------


def book_ctes(src: str, key: str, tag: str = "") -> tuple[str, list[str], list[str]]:
    w = Win(key)
    e = "1e-8"
    l1 = {
        "buy_sell_ratio": f"buy_qty_sum / (sell_qty_sum + {e})", "volatility": "(price_max - price_min) / price_mean",
        "price_change": "price_last - price_first", "pseudo_spread": "(price_max - price_min) / price_mean",
        "avg_trade_size": "qty_sum / qty_count", "avg_buy_size": f"buy_qty_sum / (buy_trade_sum + {e})",
        "avg_sell_size": f"sell_qty_sum / (sell_trade_sum + {e})",
        "buy_trade_ratio": f"buy_trade_sum / (buy_trade_sum + sell_trade_sum + {e})",
        "buy_sell_imbalance": "buy_qty_sum - sell_qty_sum",
        "order_imbalance_norm": f"(buy_qty_sum - sell_qty_sum) / (buy_qty_sum + sell_qty_sum + {e})",
    }
    l2 = {f'"{c}_MA_t_{n}"': w.mean(c, n) for c, ns in FLOW_MEANS.items() for n in ns}
    l2 |= {f'"{c}_Lag_t_{n}"': w.lag(c, n) for c in ("price_mean", "buy_qty_sum", "sell_qty_sum") for n in (1, 3)}
    l2 |= {
        "delta_buy_qty": w.diff("buy_qty_sum"), "delta_sell_qty": w.diff("sell_qty_sum"), "delta_buy_sell_ratio": w.diff("buy_sell_ratio"),
        "buy_pressure_momentum": w.diff("buy_sell_ratio", 2), "depth_imbalance": "avg_buy_size - avg_sell_size",
        "spread_change_rate": w.pct("pseudo_spread"), "buy_qty_z": w.zscore("buy_qty_sum", 24, ""), "sell_qty_z": w.zscore("sell_qty_sum", 24, ""),
        "buy_sell_diff_smooth": w.mean("buy_sell_imbalance", 6),
        "ratio_short_long": ratio(w.mean("buy_sell_ratio", 6), f"{w.mean('buy_sell_ratio', 72)} + {e}"),
    }
    f2 = {
        "buy_dominant_flag": flag("order_imbalance_norm > 0"),
        "imbalance_flip_flag": flag(f"abs(sign(buy_sell_imbalance) - sign({w.lag('buy_sell_imbalance')})) > 0"),
        "low_liquidity_flag": flag(f"volatility > {w.qwhole('volatility', 0.8)}"),
    }
    l3 = {f'"{c}_MA_slope"': w.diff(f'"{c}_MA_t_24"') for c in FLOW_MEANS} | {"buy_sell_diff_smooth_rate": w.diff("buy_sell_diff_smooth")}
    l3 |= {f'"{c}_Diff_t_{n}"': f'{c} - "{c}_MA_t_{n}"' for c in ("price_mean", "buy_qty_sum", "sell_qty_sum") for n in (6, 24)}
    f3 = {"buy_overheat_flag": flag("buy_qty_z > 2"), "sell_overheat_flag": flag("sell_qty_z < -2"),
          "spread_spike_flag": flag("abs(spread_change_rate) > 0.5")}
    t = lambda n: f"{n}{tag}"
    text = f""", {t('k1')} AS MATERIALIZED (SELECT *, {cols(l1)} FROM {src}), {t('k2')} AS MATERIALIZED (SELECT *, {cols(l2 | f2)} FROM {t('k1')}),
{t('book')} AS MATERIALIZED (SELECT *, {cols(l3 | f3)} FROM {t('k2')})"""
    return text, [*f2, *f3], [*l1, *l2, *l3]


BOOK, BOOK_INTS, BOOK_DOUBLES = book_ctes("bars", "symbol")
BOOK1, *_ = book_ctes("both_sides", "series_id")
BOTH_SIDES = I.SERIES_SQL + ", both_sides AS (SELECT * REPLACE (sell_qty_sum + 1.0 AS sell_qty_sum, buy_qty_sum + 1.0 AS buy_qty_sum, sell_trade_sum + 1 AS sell_trade_sum, buy_trade_sum + 1 AS buy_trade_sum) FROM bars1)"


def both_sides(spark, sf):
    """Bars whose sides are never empty, so ratios keep enough digits to compare."""
    return I.series_bars(spark, sf).withColumns({
        **{c: F.col(c) + 1.0 for c in ("sell_qty_sum", "buy_qty_sum")}, **{c: F.col(c) + 1 for c in ("sell_trade_sum", "buy_trade_sum")}})



@query("b8_orderbook_features", finish(BOTH_SIDES + BOOK1, "book", ["series_id", "date", *BOOK_INTS], BOOK_DOUBLES))
def b8(spark, sf):
    x = orderbook_features(both_sides(spark, sf), I.SERIES)
    return rounded(x.select("series_id", "date", *[n.strip('"') for n in (*BOOK_INTS, *BOOK_DOUBLES)]))


@query("f13_order_flow_flags", finish(I.BARS_SQL + BOOK, "book", ["symbol", "date", *BOOK_INTS], []))
def f13(spark, sf):
    return orderbook_features(I.bars(spark, sf), I.BARS).select("symbol", "date", *BOOK_INTS)


# ---- profile ---------------------------------------------------------------

from .q_tables import STATS  # noqa: E402

PROFILE_ALL = STATS + ", profile AS (SELECT stats.*, vwap, vwap_std FROM stats JOIN wav USING (series))"
PROF = {f'"{c}_MA_t_{n}"': D.mean(c, n) for c in pipeline.PROFILE_COLUMNS for n in (6, 24)}
PROF |= {f'"{c}_Lag_t_{n}"': D.lag(c, n) for c in pipeline.PROFILE_COLUMNS[:-1] for n in (1, 3)}


@query("b3_volume_profile_features", finish(
    PROFILE_ALL + f", x AS (SELECT *, {cols(PROF)} FROM daily JOIN profile USING (series))", "x", ["series", "date"],
    [*pipeline.PROFILE_COLUMNS, *PROF]))
def b3(spark, sf):
    x = pipeline.profile_features(I.ohlcv_daily(spark, sf), I.DAILY)
    return rounded(x.select("series", "date", *pipeline.PROFILE_COLUMNS, *[n.strip('"') for n in PROF]))


# ---- activity --------------------------------------------------------------

A = onchain.ACTIVITY_COLUMNS


def activity_ctes(src: str, key: str, given_full: list[str], tag: str = "", persist: bool = False) -> tuple[str, list[str], list[str]]:
    w = Win(key)
    t = lambda n: f"{n}{tag}"
    l1: dict[str, str] = {}
    for c in A:
        l1[f"{c}_diff"] = w.diff(c)
        for name, n in ((6, 7), (12, 12), (24, 24), (48, 48), (72, 72), (96, 96), (168, 168)):
            l1[f'"{c}_MA_t_{name}"'] = w.mean(c, n)
        for n in (1, 3):
            l1[f'"{c}_Lag_t_{n}"'] = w.lag(c, n)
        l1[f"{c}_rolling_std_7"] = f"(CASE WHEN count({c}) {w.rows(3, 3)} >= 7 THEN stddev_samp({c}) {w.rows(3, 3)} END)"
        l1[f"{c}_rolling_std_30"] = f"(CASE WHEN count({c}) {w.rows(15, 14)} >= 30 THEN stddev_samp({c}) {w.rows(15, 14)} END)"
        l1[f"{c}_pct_change"] = w.pct(c)
    l1["w3"] = w.diff("whale_tx_count", 3)
    l2: dict[str, str] = {}
    for c in A:
        l2[f'"{c}_MA_t_6_slope"'] = w.diff(f'"{c}_MA_t_6"')
        for n in (6, 24):
            l2[f'"{c}_Diff_t_{n}"'] = f'{c} - "{c}_MA_t_{n}"'
    l2["active_ratio"] = "active_receivers / (active_senders + 1e-8)"
    l2["growth"] = ratio('"active_receivers_MA_t_6" - "active_receivers_MA_t_24"', 'nullif("active_receivers_MA_t_24", 0) + 1e-9')
    f2 = {"whale_activity_surge_flag": flag(f"{ratio('w3', w.std('w3', 12) + ' + 1e-9')} > 2")}
    f3 = {"active_receivers_growth_flag":
          f"CASE WHEN growth > {w.qwhole('growth', 0.9)} THEN 1 WHEN growth < {w.qwhole('growth', 0.1)} THEN -1 ELSE 0 END"}
    names = [n for n in (*l1, *l2) if n not in ("w3", "growth")]
    ints = [*f2, *f3]
    full = " AND ".join(f"{n} IS NOT NULL" for n in (*names, *given_full))
    pc = lambda c: f"coalesce({w.pct(c)}, 0.0)"
    move = lambda c: clip(f"r_{c} / (CASE WHEN sd_{c} = 0 THEN 1e-8 ELSE sd_{c} END)", -10, 10)
    extra = {
        "active_senders_growth_6h": clip(w.pct("active_senders", 6), -1, 3), "active_senders_z_24h": move("active_senders"),
        "active_receivers_growth_6h": clip(w.pct("active_receivers", 6), -1, 3), "active_receivers_z_24h": move("active_receivers"),
        "dex_volume_zmove_24h": move("dex_volume"),
    }
    movers = ("active_senders", "active_receivers", "dex_volume")
    text = f""",
{t('a1')} AS MATERIALIZED (SELECT *, {cols(l1)} FROM {src}), {t('a2')} AS MATERIALIZED (SELECT *, {cols(l2 | f2)} FROM {t('a1')}),
{t('a3')} AS MATERIALIZED (SELECT * EXCLUDE (w3, growth), {cols(f3)} FROM {t('a2')}),
{t('a4')} AS MATERIALIZED (SELECT * FROM {t('a3')} WHERE {full}),
{t('a5')} AS MATERIALIZED (SELECT *, {', '.join(f'{pc(c)} AS r_{c}' for c in movers)} FROM {t('a4')}),
{t('a6')} AS MATERIALIZED (SELECT *, {', '.join(f"{w.std(f'r_{c}', 24, 1)} AS sd_{c}" for c in movers)} FROM {t('a5')}),
{t('act')} AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(f'r_{c}, sd_{c}' for c in movers)}), {cols(extra)} FROM {t('a6')})"""
    return text, ints, [*names, *extra]


ACT, ACT_INTS, ACT_DOUBLES = activity_ctes("activity", "series_id", [])


@query("b4_activity_features", finish(I.ACTIVITY_SQL + ACT, "act", ["series_id", "date", *ACT_INTS], ACT_DOUBLES))
def b4(spark, sf):
    x = onchain.activity_features(I.activity(spark, sf), I.SERIES, drop="rows")
    return rounded(x.select("series_id", "date", *[n.strip('"') for n in (*ACT_INTS, *ACT_DOUBLES)]))


@query("b4_activity_features_default", finish(I.ACTIVITY_SQL + ACT, "act", ["series_id", "date", *ACT_INTS], ACT_DOUBLES))
def b4_default(spark, sf):
    """As a caller has it who leaves the defaults: a column that is mostly missing goes first, so that its rows stay."""
    given = I.activity(spark, sf).withColumn("seldom", F.when(F.dayofmonth("date") % 4 == 0, F.col("total_flow_sum")))
    x = onchain.activity_features(given, I.SERIES)
    assert "seldom" not in x.columns
    return rounded(x.select("series_id", "date", *[n.strip('"') for n in (*ACT_INTS, *ACT_DOUBLES)]))


SA = Win("series_id")
OPT_SRC = I.ACTIVITY_SQL + """,
opt AS MATERIALIZED (
  SELECT series_id, date, address_count_sum + 1 AS active_addresses, total_flow_sum AS transfer_volume, active_senders AS exchange_inflow,
         contract_calls AS exchange_outflow, dex_volume AS supply_on_exchange, total_flow_sum + 500 AS total_supply,
         active_receivers AS top10_holdings, whale_tx_count, address_count_sum AS tx_count, dex_volume AS gas_used,
         active_receivers AS unique_contracts, dex_volume FROM activity)"""


def optional_source(spark, sf):
    c = F.col
    return I.activity(spark, sf).select(
        "series_id", "date", (c("address_count_sum") + 1).alias("active_addresses"), c("total_flow_sum").alias("transfer_volume"),
        c("active_senders").alias("exchange_inflow"), c("contract_calls").alias("exchange_outflow"),
        c("dex_volume").alias("supply_on_exchange"), (c("total_flow_sum") + 500).alias("total_supply"),
        c("active_receivers").alias("top10_holdings"), "whale_tx_count", c("address_count_sum").alias("tx_count"),
        c("dex_volume").alias("gas_used"), c("active_receivers").alias("unique_contracts"), "dex_volume")


def _bounded(name: str, expr: str) -> str:
    lo, hi = onchain.ACTIVITY_BOUNDS[name]
    return clip(expr, lo, hi)


OPT_R = {c: f"coalesce({SA.pct(c)}, 0.0)" for c in
         ("active_addresses", "transfer_volume", "exchange_inflow", "exchange_outflow", "dex_volume", "gas_used")}
OPT_MOVE = lambda c: f"r_{c} / (CASE WHEN sd_{c} = 0 THEN 1e-8 ELSE sd_{c} END)"
OPT = {
    "active_addresses_growth_6h": SA.pct("active_addresses", 6), "active_addresses_z_24h": OPT_MOVE("active_addresses"),
    "transfer_vol_growth_6h": SA.pct("transfer_volume", 6), "dex_vol_ratio": "dex_volume / (transfer_volume + 1e-8)",
    "ex_in_out_ratio": "exchange_inflow / (exchange_outflow + 1e-8)", "ex_netflow": "exchange_inflow - exchange_outflow",
    "ex_netflow_change_6h": SA.diff("exchange_inflow - exchange_outflow", 6), "ex_supply_change_24h": SA.diff("supply_on_exchange", 24),
    "ex_supply_ratio": "supply_on_exchange / (total_supply + 1e-8)", "top10_hold_ratio": "top10_holdings / (total_supply + 1e-8)",
    "whale_tx_ratio": "whale_tx_count / (tx_count + 1e-8)",
    "whale_ratio_ma6": f"{SA.mean('whale_tx_count', 6, 1)} / ({SA.mean('tx_count', 6, 1)} + 1e-8)",
    "whale_ratio_change_6h": SA.pct("whale_tx_count", 6), "gas_used_change_6h": SA.pct("gas_used", 6), "gas_used_z_24h": OPT_MOVE("gas_used"),
    "unique_contracts_growth_24h": SA.pct("unique_contracts", 24),
    "onchain_sentiment": "(ln(greatest(active_addresses, 1.0)) + ln(greatest(transfer_volume, 1.0)) - ln(greatest(exchange_inflow, 1.0))) / 3.0",
} | {f"{c}_zmove_24h": OPT_MOVE(c) for c in ("active_addresses", "transfer_volume", "exchange_inflow", "exchange_outflow", "dex_volume")}
OPT_SQL = OPT_SRC + f""",
o1 AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS r_{c}' for c, e in OPT_R.items())} FROM opt),
o2 AS MATERIALIZED (SELECT *, {', '.join(f"{SA.std(f'r_{c}', 24, 1)} AS sd_{c}" for c in OPT_R)} FROM o1),
o3 AS (SELECT series_id, date, {', '.join(f'{_bounded(n, e)} AS {n}' for n, e in OPT.items())} FROM o2)"""


@query("b4_optional_activity_features", finish(OPT_SQL, "o3", ["series_id", "date"], list(OPT)))
def b4_optional(spark, sf):
    from ..operators.clean import clip_columns

    x = clip_columns(onchain.optional_activity(optional_source(spark, sf), I.SERIES), onchain.ACTIVITY_BOUNDS)
    return rounded(x.select("series_id", "date", *OPT))


# ---- fitted scores and flags -----------------------------------------------

FIT_COLS = ("total_flow_sum", "address_count_sum", "active_receivers", "active_senders", "dex_volume", "contract_calls",
            "whale_tx_count")
# Columns of b7 and f17; their ..._all_columns forms have all seven, whose small counts tie at quantiles.
FLAG_COLS = ("total_flow_sum", "active_receivers", "dex_volume")
TRAIN = f"({SA.rn()} <= floor(count(*) {SA.whole} * 0.7::DOUBLE))"


def scores_sql() -> tuple[str, list[str]]:
    w = SA
    alphas = {f"{c}_ema_{tag}": (c, a) for c in FIT_COLS for tag, a in (("s", 2 / 7), ("m", 2 / 25))}
    l1, l2, l3, l4, l5, l6, l7 = ({} for _ in range(7))
    l1["t"] = TRAIN
    tr = lambda x: f"(CASE WHEN t THEN {x} END)"
    zn = lambda x: (f"(({x}) - avg({tr(x)}) {w.whole}) / (CASE WHEN coalesce(stddev_samp({tr(x)}) {w.whole}, 0) = 0 THEN 1.0 "
                    f"ELSE stddev_samp({tr(x)}) {w.whole} END)")
    ws = lambda x: f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {w.qwhole(tr(x), 0.005)}), {w.qwhole(tr(x), 0.995)}) END)"
    out, scaled = [], []
    for c in FIT_COLS:
        l1 |= {f"{c}_log1p": f"ln(1 + {c})", f"{c}_ma_s6": w.mean(c, 6, 1), f"{c}_ma_m24": w.mean(c, 24, 1), f"{c}_ma_l72": w.mean(c, 72, 1),
               f"{c}_std_s6": f"nullif({w.std(c, 6, 1)}, 0)", f"{c}_std_m24": f"nullif({w.std(c, 24, 1)}, 0)",
               f"{c}_slope_s6": f"{w.diff(c, 6)} / (6 + 1e-8)", f"{c}_pct1": w.pct(c), f"{c}_pct6": w.pct(c, 6), f"{c}_pct24": w.pct(c, 24)}
        l2 |= {f"{c}_z_short": f"({c} - {c}_ma_s6) / {c}_std_s6", f"{c}_z_mid": f"({c} - {c}_ma_m24) / {c}_std_m24",
               f"{c}_ratio_s_m": f"{c}_ma_s6 / ({c}_ma_m24 + 1e-8)", f"{c}_ratio_s_l": f"{c}_ma_s6 / ({c}_ma_l72 + 1e-8)",
               f"{c}_dev_s_m": f"abs({c}_ma_s6 / ({c}_ma_m24 + 1e-8) - 1)", f"{c}_dev_s_l": f"abs({c}_ma_s6 / ({c}_ma_l72 + 1e-8) - 1)",
               f"{c}_ema_cross": f"{c}_ema_s - {c}_ema_m"}
        l3[f"w_{c}"] = ws(f"{c}_pct6")
        l4[f"{c}_event_score"] = f"greatest({zn(f'{c}_z_short')}, {zn(f'w_{c}')})"
        l4[f"{c}_regime_score"] = f"greatest({zn(f'{c}_z_mid')}, {zn(f'{c}_dev_s_m')})"
        scaled += [f"{c}_{x}" for x in ("z_short", "z_mid", "pct6", "pct24", "ema_cross", "slope_s6", "ratio_s_m", "ratio_s_l",
                                        "event_score", "regime_score", "log1p", "ma_s6", "ma_m24", "ma_l72")]
    l5 = {f"w_{n}": ws(n) for n in scaled}
    l6 = {f"{n}_zn": zn(f"w_{n}") for n in scaled}
    out = [n for layer in (l1, l2, l4, l6) for n in layer if n != "t"] + list(alphas)
    text = I.ACTIVITY_SQL + f", n0 AS MATERIALIZED (SELECT *, {w.rn()} AS rn FROM activity)," + scan_ema("em", "n0", "series_id", alphas)
    text += ", s0 AS MATERIALIZED (SELECT * FROM n0 JOIN em USING (series_id, rn))"
    for i, layer in enumerate((l1, l2, l3, l4, l5, l6), 1):
        text += f",\ns{i} AS MATERIALIZED (SELECT *, {cols(layer)} FROM s{i - 1})"
    return text, out


SCORES, SCORE_COLS = scores_sql()


@query("b6_fitted_scores", finish(SCORES, "s6", ["series_id", "date"], SCORE_COLS))
def b6(spark, sf):
    x, _ = onchain.fitted_scores(I.activity(spark, sf), I.SERIES, FIT_COLS)
    return rounded(x.select("series_id", "date", *SCORE_COLS))


def flags_sql(columns: tuple[str, ...] = FLAG_COLS, digits: int | None = None) -> tuple[str, list[str], list[str]]:
    w = SA
    tr = lambda x: f"(CASE WHEN t THEN {x} END)"
    z = lambda x: f"(({x}) - avg({tr(x)}) {w.whole}) / (CASE WHEN stddev_samp({tr(x)}) {w.whole} = 0 THEN 1.0 ELSE stddev_samp({tr(x)}) {w.whole} END)"
    tie = lambda x: x if digits is None else f"round({x}, {digits})"
    l1, l2, l3, ints, doubles = {"t": TRAIN, "rn": w.rn()}, {}, {}, [], []
    states = []
    for c in columns:
        l1 |= {f"{c}_z_mid": f"({c} - {w.mean(c, 24, 1)}) / nullif({w.std(c, 24, 1)}, 0)",
               f"{c}_z_short": f"({c} - {w.mean(c, 6, 1)}) / nullif({w.std(c, 6, 1)}, 0)",
               f"{c}_ratio_s_over_m": finite(ratio(w.mean(c, 6, 1), f"nullif({w.mean(c, 24, 1)}, 0)")), f"{c}_pctchg_6": w.pct(c, 6)}
        l2 |= {f"e_{c}": tie(f"greatest({z(f'{c}_z_short')}, {z(f'{c}_pctchg_6')})"),
               f"s_{c}": tie(f"greatest({c}_z_mid, abs({c}_ratio_s_over_m - 1.0))")}
        for name, src, on, off in ((f"{c}_spike_flag", f"e_{c}", 0.85, 0.7), (f"{c}_state_flag", f"s_{c}", 0.6, 0.45)):
            l3 |= {f"{name}_enter": tie(w.qwhole(tr(src), on)), f"{name}_exit": tie(w.qwhole(tr(src), off))}
            states.append((name, src))
            ints.append(name)
            doubles += [f"{name}_enter", f"{name}_exit"]
    step = ", ".join(
        f"CASE WHEN r.{n} = 0 AND b.{s} >= b.{n}_enter THEN 1 WHEN r.{n} = 1 AND b.{s} <= b.{n}_exit THEN 0 ELSE r.{n} END" for n, s in states)
    text = I.ACTIVITY_SQL + f""",
h1 AS MATERIALIZED (SELECT *, {cols(l1)} FROM activity), h2 AS MATERIALIZED (SELECT *, {cols(l2)} FROM h1), h3 AS MATERIALIZED (SELECT *, {cols(l3)} FROM h2),
r(series_id, rn, {', '.join(n for n, _ in states)}) AS (
  SELECT DISTINCT series_id, 0::BIGINT, {', '.join('0' for _ in states)} FROM h3
  UNION ALL SELECT b.series_id, b.rn, {step} FROM r JOIN h3 b ON b.series_id = r.series_id AND b.rn = r.rn + 1),
x AS (SELECT * FROM h3 JOIN r USING (series_id, rn))"""
    doubles += [n for n in l1 if n not in ("t", "rn")]
    return text, ints, doubles


FLAGS, FLAG_INTS, FLAG_DOUBLES = flags_sql()


@query("b7_fitted_flags", finish(FLAGS, "x", ["series_id", "date", *FLAG_INTS], FLAG_DOUBLES))
def b7(spark, sf):
    x, _ = onchain.fitted_flags(I.activity(spark, sf), I.SERIES, FLAG_COLS, thresholds=True)
    return rounded(x.select("series_id", "date", *FLAG_INTS, *FLAG_DOUBLES))


@query("f17_event_state_flags", finish(FLAGS, "x", ["series_id", "date", *FLAG_INTS], []))
def f17(spark, sf):
    x, names = onchain.fitted_flags(I.activity(spark, sf), I.SERIES, FLAG_COLS)
    return x.select("series_id", "date", *names)


ALL_FLAGS, ALL_FLAG_INTS, ALL_FLAG_DOUBLES = flags_sql(FIT_COLS, 9)


@query("b7_fitted_flags_all_columns", finish(ALL_FLAGS, "x", ["series_id", "date", *ALL_FLAG_INTS], ALL_FLAG_DOUBLES))
def b7_all(spark, sf):
    x, _ = onchain.fitted_flags(I.activity(spark, sf), I.SERIES, FIT_COLS, thresholds=True, digits=9)
    return rounded(x.select("series_id", "date", *ALL_FLAG_INTS, *ALL_FLAG_DOUBLES))


@query("f17_event_state_flags_all_columns", finish(ALL_FLAGS, "x", ["series_id", "date", *ALL_FLAG_INTS], []))
def f17_all(spark, sf):
    x, names = onchain.fitted_flags(I.activity(spark, sf), I.SERIES, FIT_COLS, digits=9)
    return x.select("series_id", "date", *names)


# ---- drivers ---------------------------------------------------------------


def macro_sql(configs: tuple[M.Macro, ...]) -> tuple[str, list[str], list[str]]:
    w = SA
    text = I.DRIVERS_SQL + ", v0 AS MATERIALIZED (SELECT *, " + w.rn() + " AS rn FROM drivers)"
    l1, l2, ints, doubles, joins = {}, {}, [], [], ""
    for i, m in enumerate(configs):
        c = f'"{m.column}"'
        l1[f'"{m.level}"'], l1[f'"{m.delta}"'] = w.zscore(c, m.z_window), w.diff(c)
        doubles += [f'"{m.level}"', f'"{m.delta}"']
        l1[f"v{i}"] = w.ffill(c) if m.pad else c
        if m.spans:
            text += f", f{i} AS MATERIALIZED (SELECT series_id, {w.rn()} AS rn, v FROM (SELECT series_id, date, {w.ffill(c)} AS v FROM v0) WHERE v IS NOT NULL),"
            text += scan_ema(f"e{i}", f"f{i}", "series_id", {f"es{i}": ("v", 2 / (m.spans[0] + 1)), f"el{i}": ("v", 2 / (m.spans[1] + 1))})
            joins += f" LEFT JOIN e{i} ON e{i}.series_id = v1.series_id AND e{i}.rn = v1.rn - lead_in{i}"
            l1[f"lead_in{i}"] = f"coalesce(min(rn) FILTER ({c} IS NOT NULL) {w.whole} - 1, 0)"
            l2[f'"{m.prefix}_regime_up_flag"'] = flag(f"es{i} > el{i}")
            l2[f'"{m.prefix}_regime_down_flag"'] = flag(f"es{i} < el{i}")
        if m.sigma is not None:
            p = f"v{i}"
            l2[f'"{m.prefix}_cusum_up_flag"'] = flag(f"{p} - mu{i} > {m.sigma} * sd{i}")
            l2[f'"{m.prefix}_cusum_down_flag"'] = flag(f"mu{i} - {p} > {m.sigma} * sd{i}")
    ints = list(l2)
    stats = ", ".join(f"{w.mean(f'v{i}', M.DRIFT_WINDOW, M.DRIFT_NEED)} AS mu{i}, {w.std(f'v{i}', M.DRIFT_WINDOW, M.DRIFT_NEED)} AS sd{i}"
                      for i, m in enumerate(configs) if m.sigma is not None)
    text += f", v1a AS MATERIALIZED (SELECT *, {cols(l1)} FROM v0), v1 AS MATERIALIZED (SELECT *{', ' + stats if stats else ''} FROM v1a)"
    text += f", x AS (SELECT v1.*{', ' + cols(l2) if l2 else ''} FROM v1{joins})"
    return text, ints, doubles


def macro_query(name: str, configs: tuple[M.Macro, ...]) -> None:
    text, ints, doubles = macro_sql(configs)
    names = [n.strip('"') for n in (*ints, *doubles)]

    @query(name, finish(text, "x", ["series_id", "date", *ints], doubles))
    def run(spark, sf):
        x = I.drivers(spark, sf).select("series_id", "date", *[m.column for m in configs])
        return rounded(M.macro_features(x, I.SERIES, configs).select("series_id", "date", *names))


for _name, _configs in {
    "b11_vix_features": M.VIX, "b12_funding_features": M.FUNDING, "b13_liquidity_features": M.LIQUIDITY,
    "b14_btc_dominance_features": M.BTC_DOMINANCE, "b15_stablecoin_features": M.STABLECOIN, "b16_dex_features": M.DEX,
    "b17_activity_features": M.ACTIVITY, "b20_long_short_features": M.LONG_SHORT,
}.items():
    macro_query(_name, _configs)

RV, RV_I, RV_D = macro_sql(M.REALIZED_VOL)


@query("b18_realized_vol_features", finish(RV + f""", y AS (SELECT *, {flag(f"realized_vol_24h >= {SA.qwhole('realized_vol_24h', 0.7)}")} AS high_vol_flag,
  {flag(f"realized_vol_24h <= {SA.qwhole('realized_vol_24h', 0.3)}")} AS low_vol_flag FROM x)""", "y",
                                           ["series_id", "date", "high_vol_flag", "low_vol_flag"], RV_D))
def b18(spark, sf):
    x = M.realized_vol_features(I.drivers(spark, sf).select("series_id", "date", "realized_vol_24h"), I.SERIES)
    return rounded(x.drop("realized_vol_24h"))


VD, VD_I, VD_D = macro_sql(M.VOLUME_DOMINANCE)


@query("b19_volume_dominance_features", finish(VD, "x", [
    "series_id", "date", *VD_I, f"{flag('eth_volume_dominance > 0.5')} AS alt_season_flag",
    f"{flag('eth_volume_dominance < 0.5')} AS btc_season_flag"], VD_D))
def b19(spark, sf):
    x = M.volume_dominance_features(I.drivers(spark, sf).select("series_id", "date", "eth_volume_dominance"), I.SERIES)
    return rounded(x.drop("eth_volume_dominance"))


C = "velocity_usd_24h"


def velocity_sql() -> str:
    w = SA
    # Weighted sum and weight sum both follow s = q*s' + value.
    qs, ql = 1 - 2 / 25, 1 - 2 / 73
    return I.DRIVERS_SQL + f""",
v0 AS MATERIALIZED (SELECT series_id, date, {C} AS v, {w.rn()} AS rn FROM drivers),
e(series_id, rn, sn, sw, ln, lw) AS (
  SELECT series_id, rn, v, 1.0::DOUBLE, v, 1.0::DOUBLE FROM v0 WHERE rn = 1
  UNION ALL SELECT b.series_id, b.rn, {qs!r}::DOUBLE * e.sn + b.v, {qs!r}::DOUBLE * e.sw + 1, {ql!r}::DOUBLE * e.ln + b.v, {ql!r}::DOUBLE * e.lw + 1
  FROM e JOIN v0 b ON b.series_id = e.series_id AND b.rn = e.rn + 1),
v1 AS MATERIALIZED (SELECT *, {w.mean('v', 200)} AS mu, {w.std('v', 200)} AS sd, {w.zscore('v', 200)} AS z, {w.diff('v')} AS d,
  {', '.join(f'{w.lag("v", n)} AS {C}_lag{n}' for n in (1, 2, 3))} FROM v0),
x AS (SELECT v1.series_id, date, z AS {C}_zn, {C}_lag1, {C}_lag2, {C}_lag3, d AS delta_{C}, {w.diff('d')} AS delta2_{C}, {w.diff('z')} AS delta_{C}_zn,
  {flag('v > mu + 2 * sd')} AS {C}_spike_flag, {flag('v < mu - 2 * sd')} AS {C}_crash_flag,
  {flag('e.sn / e.sw > e.ln / e.lw + 1e-12')} AS {C}_regime_up_flag, {flag('e.sn / e.sw < e.ln / e.lw - 1e-12')} AS {C}_regime_down_flag,
  {flag('v - mu > 0.5 * v1.sd')} AS {C}_cusum_up_flag, {flag('mu - v > 0.5 * v1.sd')} AS {C}_cusum_down_flag
  FROM v1 JOIN e USING (series_id, rn))"""


VEL_D = [f"{C}_zn", f"{C}_lag1", f"{C}_lag2", f"{C}_lag3", f"delta_{C}", f"delta2_{C}", f"delta_{C}_zn"]
VEL_I = [f"{C}_{x}_flag" for x in ("spike", "crash", "regime_up", "regime_down", "cusum_up", "cusum_down")]


@query("b5_velocity_features", finish(velocity_sql(), "x", ["series_id", "date", *VEL_I], VEL_D))
def b5(spark, sf):
    x = M.velocity_features(I.drivers(spark, sf).select("series_id", "date", C), I.SERIES)
    return rounded(x.drop(C))


# ---- sentiment -------------------------------------------------------------

SENT = SENTIMENT + """,
codes AS (SELECT fg_label, CAST(dense_rank() OVER (ORDER BY fg_label) - 1 AS INT) AS fg_label_num FROM (SELECT DISTINCT fg_label FROM sentiment)),
g AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 HOUR)) AS date FROM sentiment),
s0 AS (SELECT 0 AS series_id, g.date, last_value(fg_index IGNORE NULLS) OVER (ORDER BY g.date) AS fg_index,
         last_value(fg_label IGNORE NULLS) OVER (ORDER BY g.date) AS fg_label, last_value(fg_label_num IGNORE NULLS) OVER (ORDER BY g.date) AS fg_label_num
       FROM g LEFT JOIN (SELECT * FROM sentiment JOIN codes USING (fg_label)) USING (date))""" + f""",
s1 AS (SELECT *, {SA.mean('fg_index', 24)} AS fg_index_ma, {SA.pct('fg_index::DOUBLE')} AS fg_index_change FROM s0),
s2 AS (SELECT *, fg_index - fg_index_ma AS fg_index_diff FROM s1),
s3 AS (SELECT *, {', '.join(f'{SA.lag(c, n)} AS {c}_lag{n}' for c in ('fg_index', 'fg_index_ma', 'fg_index_diff', 'fg_index_change') for n in (1, 2))} FROM s2)"""
SENT_D = ["fg_index_ma", "fg_index_change", "fg_index_diff"] + [
    f"{c}_lag{n}" for c in ("fg_index_ma", "fg_index_diff", "fg_index_change") for n in (1, 2)]


@query("b21_sentiment_features", finish(SENT, "s3", [
    "series_id", "date", "fg_index", "fg_label", "fg_label_num", "CAST(fg_index_lag1 AS DOUBLE) AS fg_index_lag1", "CAST(fg_index_lag2 AS DOUBLE) AS fg_index_lag2"], SENT_D))
def b21(spark, sf):
    s = sentiment(spark, sf).withColumn("series_id", F.lit(0))
    x = pipeline.sentiment_features(s, ["series_id"])
    return rounded(x.withColumns({f"fg_index_lag{n}": F.col(f"fg_index_lag{n}").cast("double") for n in (1, 2)}))


# ---- everything together ---------------------------------------------------

COMBINED_SQL = BOTH_SIDES + """,
daily AS (
  SELECT series_id AS series, date, price_max AS high, price_min AS low, price_last AS close, qty_sum AS "volume_ETH", amount_sum AS "volume_USD",
         price_first, price_last, price_max, price_min, price_mean, qty_sum, qty_count, buy_qty_sum, sell_qty_sum, buy_trade_sum, sell_trade_sum,
         amount_sum AS total_flow_sum, CAST(qty_count AS DOUBLE) AS address_count_sum, buy_trade_sum + 1.0::DOUBLE AS active_receivers,
         sell_trade_sum + 1.0::DOUBLE AS active_senders, buy_qty_sum + 1.0 AS dex_volume, sell_qty_sum + 1.0 AS contract_calls,
         floor(price_max) + 1.0 AS whale_tx_count FROM both_sides)"""


def combined(spark, sf, bars=both_sides):
    c = F.col
    b = bars(spark, sf)
    return b.select(
        c("series_id").alias("series"), "date", c("price_max").alias("high"), c("price_min").alias("low"), c("price_last").alias("close"),
        c("qty_sum").alias("volume_ETH"), c("amount_sum").alias("volume_USD"), "price_first", "price_last", "price_max", "price_min", "price_mean",
        "qty_sum", "qty_count", "buy_qty_sum", "sell_qty_sum", "buy_trade_sum", "sell_trade_sum", c("amount_sum").alias("total_flow_sum"),
        c("qty_count").cast("double").alias("address_count_sum"), (c("buy_trade_sum") + 1.0).alias("active_receivers"),
        (c("sell_trade_sum") + 1.0).alias("active_senders"), (c("buy_qty_sum") + 1.0).alias("dex_volume"),
        (c("sell_qty_sum") + 1.0).alias("contract_calls"), (F.floor("price_max") + 1.0).alias("whale_tx_count"))


_prof = PROFILE_ALL[len(I.DAILY_SQL):]
_act, _act_i, _act_d = activity_ctes("profiled", "series", list(PROF) + list(pipeline.PROFILE_COLUMNS), "_z")
_px, _px_i, _px_d = price_ctes("act_z", "series", "_z")
_bk, _bk_i, _bk_d = book_ctes("priced_out_z", "series", "_z")
ALL_SQL = COMBINED_SQL + _prof + f", profiled AS MATERIALIZED (SELECT *, {cols(PROF)} FROM daily JOIN profile USING (series))" + _act + _px + _bk
ALL_I, ALL_D = [*_act_i, *_px_i, *_bk_i], [*pipeline.PROFILE_COLUMNS, *PROF, *_act_d, *_px_d, *_bk_d]


@query("b22_all_features", finish(ALL_SQL, "book_z", ["series", "date", *ALL_I], ALL_D))
def b22(spark, sf):
    x = pipeline.all_features(combined(spark, sf), I.DAILY, drop="rows")
    return rounded(x.select("series", "date", *[n.strip('"') for n in (*ALL_I, *ALL_D)]))
