"""Window functions, indicators, flags and change detection."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.scalar import clip as sclip, dbl, flag as sflag, ratio as sratio, sign, zero_to
from ..operators import cusum, fit
from ..operators.align import row_index
from ..operators.blocks import ffill_in_blocks, in_blocks, latch_in_blocks, windows_in_blocks
from ..operators.expanding import expanding_quantile_in_blocks
from ..operators.linear import atr_in_blocks, ema_in_blocks, macd_in_blocks, rsi_in_blocks, seeded_ema_in_blocks
from ..operators.scan import Atr, Ema, Macd, Rsi, RunningQuantile, SeededEma, scan
from . import inputs as I
from .core import finish, query, rounded
from .sql import Win, clip, flag, ratio, scan_ema

B = Win("symbol")
LY = I.BARS


def simple(name, sql_columns: dict[str, str], spark_columns, flags: tuple[str, ...] = (), prior: str = "",
           source: str = "hourly", digits: int = 6):
    """Register a one-layer window query over the hourly bars of every symbol."""
    inner = ", ".join(f"{e} AS {n}" for n, e in sql_columns.items())
    doubles = [n for n in sql_columns if n not in flags]
    sql = finish(f"{I.HOURLY_SQL}{prior}, x AS (SELECT symbol, date, {inner} FROM {source})", "x",
                 ["symbol", "date", *[n for n in sql_columns if n in flags]], doubles, digits)

    @query(name, sql)
    def run(spark, sf):
        h = I.hourly(spark, sf)
        return rounded(spark_columns(h).select("symbol", "date", *sql_columns), digits)

    return run


LAGS = (1, 2, 3, 6, 12, 24)
simple("w1_lag", {f"lag_{n}": B.lag("close", n) for n in LAGS},
       lambda h: h.withColumns(dict(**{f"lag_{n}": LY.lag("close", n) for n in LAGS})))
simple("w1b_lead", {"lead_4": B.lead("close", 4)}, lambda h: h.withColumns(dict(lead_4=LY.lead("close", 4))))
simple("w2_difference", {f"diff_{n}": B.diff("close", n) for n in (1, 2, 6, 24)},
       lambda h: h.withColumns(dict(**{f"diff_{n}": LY.diff("close", n) for n in (1, 2, 6, 24)})))

GAPPY = ", gappy AS (SELECT symbol, date, rn, CASE WHEN hour(date) % 5 <> 2 THEN close END AS v FROM hourly)"
PADDED = GAPPY + f", padded AS (SELECT *, {B.ffill('v')} AS p FROM gappy)"


def gappy(h):
    return h.withColumn("v", F.when(F.hour("date") % 5 != 2, F.col("close")))


simple("w3_pct_change", {f"pct_{n}": B.pct("p", n) for n in (1, 6, 12, 24)},
       lambda h: gappy(h).withColumn("p", LY.ffill("v")).withColumns({f"pct_{n}": LY.pct_change("p", n) for n in (1, 6, 12, 24)}),
       prior=PADDED, source="padded")
simple("w4_log_return", {f"logret_{n}": B.logret("close", n) for n in (1, 3, 6, 24)},
       lambda h: h.withColumns(dict(**{f"logret_{n}": LY.log_return("close", n) for n in (1, 3, 6, 24)})))
SIZES = (3, 6, 7, 12, 20, 24, 48, 72, 96, 168, 200, 336)
simple("w5_rolling_mean_full", {f"mean_{n}": B.mean("close", n) for n in SIZES},
       lambda h: h.withColumns(dict(**{f"mean_{n}": LY.mean("close", n) for n in SIZES})))
simple("w6_rolling_mean_partial", {f"mean_{n}": B.mean("v", n, 1) for n in (6, 20, 24, 72)},
       lambda h: gappy(h).withColumns({f"mean_{n}": LY.mean("v", n, 1) for n in (6, 20, 24, 72)}), prior=GAPPY, source="gappy")
STDS = ((6, 6), (12, 12), (20, 1), (24, 12), (20, 10), (200, 50))
simple("w7_rolling_std", {f"std_{n}_{k}": B.std("v", n, k) for n, k in STDS},
       lambda h: gappy(h).withColumns({f"std_{n}_{k}": LY.std("v", n, k) for n, k in STDS}), prior=GAPPY, source="gappy")
simple("w8_centered_std",
       {"std_7": f"(CASE WHEN count(close) {B.rows(3, 3)} >= 7 THEN stddev_samp(close) {B.rows(3, 3)} END)",
        "std_30": f"(CASE WHEN count(close) {B.rows(15, 14)} >= 30 THEN stddev_samp(close) {B.rows(15, 14)} END)"},
       lambda h: h.withColumns(dict(std_7=LY.std_centered("close", 7), std_30=LY.std_centered("close", 30))))
simple("w9_rolling_sum_max_min",
       {"sum_72": B.sum("close", 72), "max_72": B.max("close", 72), "max_24": B.max("close", 24, 1), "min_24": B.min("close", 24, 1)},
       lambda h: h.withColumns(dict(sum_72=LY.sum("close", 72), max_72=LY.max("close", 72), max_24=LY.max("close", 24, 1), min_24=LY.min("close", 24, 1))))
simple("w10_rolling_median", {"median_168": B.quantile("v", 0.5, 168, 24)},
       lambda h: gappy(h).withColumn("median_168", LY.median("v", 168, 24)), prior=GAPPY, source="gappy")
simple("w11_expanding_quantile", {"median": B.expanding("v", 0.5, 24), "q20": B.expanding("v", 0.2, 100)},
       lambda h: scan(gappy(h).select("symbol", "date", "v"), LY,
                      [RunningQuantile("v", "median", 0.5, 24), RunningQuantile("v", "q20", 0.2, 100)]),
       prior=GAPPY, source="gappy")


@query("w11_expanding_quantile_in_blocks", finish(I.HOURLY_SQL + GAPPY + f", x AS (SELECT symbol, date, {B.expanding('v', 0.5, 24)} AS median FROM gappy)", "x",
                                                  ["symbol", "date"], ["median"]))
def w11_blocks(spark, sf):
    h = row_index(I.hourly(spark, sf).select("symbol", "date", "close", "volume"), ["symbol"], ["date"], F.date_trunc("day", "date"))
    x = expanding_quantile_in_blocks(gappy(h).select("symbol", "date", "row_index", "v"), ["symbol"], "v", "median", 0.5, 24, block_rows=64)
    return rounded(x.select("symbol", "date", "median"))


MEANS = f", m AS (SELECT symbol, date, volume, {B.mean('close', 6, 3)} AS r FROM hourly)"
FR = B.last(6)
VARIES = (f"max(CASE WHEN r IS NOT NULL THEN volume END) {FR} > min(CASE WHEN r IS NOT NULL THEN volume END) {FR} "
          f"AND max(r) {FR} > min(r) {FR}")
simple("w12_rolling_correlation", {"corr_6": f"(CASE WHEN count(r) {FR} >= 3 AND {VARIES} THEN corr(volume, r) {FR} END)"},
       lambda h: h.withColumn("r", LY.mean("close", 6, 3)).withColumn("corr_6", LY.corr("volume", "r", 6, 3)),
       prior=MEANS, source="m")
ZS = (24, 168, 200, 252, 336)
simple("w13_rolling_zscore", {**{f"z_{n}": B.zscore("close", n) for n in ZS}, "z_24_raw": B.zscore("close", 24, "")},
       lambda h: h.withColumns(dict(**{f"z_{n}": LY.zscore("close", n) for n in ZS}, z_24_raw=LY.zscore("close", 24, 0.0))))
CHANGES = f""", c AS (SELECT symbol, date, coalesce({B.pct('close')}, 0.0) AS r FROM hourly),
c2 AS (SELECT *, CASE WHEN {B.std('r', 24, 1)} = 0 THEN 1e-8 ELSE {B.std('r', 24, 1)} END AS sd FROM c)"""
simple("w13b_volatility_normalised_move", {"z_move": clip("r / sd", -10, 10)},
       lambda h: h.withColumn("r", F.coalesce(LY.pct_change("close"), F.lit(0.0))).withColumn(
           "z_move", sclip(sratio(F.col("r"), zero_to(LY.std("r", 24, 1), 1e-8)), -10, 10)),
       prior=CHANGES, source="c2")

# ---- exponential means -----------------------------------------------------

ROWS = ", base AS MATERIALIZED (SELECT symbol, date, rn + 1 AS rn, close, high, low, volume FROM hourly)"
EMAS = {"ema_a6": ("close", 2 / 7), "ema_a24": ("close", 2 / 25), "ema_10": ("close", 2 / 11), "ema_168": ("close", 2 / 169)}
EMA_SQL = finish(I.HOURLY_SQL + ROWS + "," + scan_ema("e", "base", "symbol", EMAS), "e JOIN base USING (symbol, rn)",
                 ["symbol", "date"], list(EMAS))


@query("w14_ema", EMA_SQL)
def w14(spark, sf):
    x = scan(I.hourly(spark, sf).select("symbol", "date", "close"), LY, [
        Ema("close", "ema_a6", alpha=2 / 7), Ema("close", "ema_a24", alpha=2 / 25), Ema("close", "ema_10", span=10),
        Ema("close", "ema_168", span=168)])
    return rounded(x.drop("close"))


def indexed(spark, sf):
    h = I.hourly(spark, sf).select("symbol", "date", "close", "volume")
    return row_index(h, ["symbol"], ["date"], F.date_trunc("day", "date"))


@query("w14_ema_in_blocks", finish(I.HOURLY_SQL + ROWS + "," + scan_ema("e", "base", "symbol", EMAS),
                                   "e JOIN base USING (symbol, rn)", ["symbol", "date"], ["ema_168"]))
def w14_blocks(spark, sf):
    x = ema_in_blocks(indexed(spark, sf), ["symbol"], "close", "ema_168", 168, block_rows=128)
    return rounded(x.select("symbol", "date", "ema_168"))


def gap_ema(alpha: float) -> str:
    """Weights of every earlier observation, position by position (missing rows still age them)."""
    q = 1.0 - alpha
    return f"""
g AS (
  SELECT a.symbol, a.date,
         sum(b.v * pow({q!r}::DOUBLE, a.rn - b.rn)) / sum(CASE WHEN b.v IS NOT NULL THEN pow({q!r}::DOUBLE, a.rn - b.rn) END) AS ema_24
  FROM gappy a JOIN gappy b ON b.symbol = a.symbol AND b.rn <= a.rn GROUP BY a.symbol, a.date)"""


@query("w15_ema_adjusted", finish(I.HOURLY_SQL + GAPPY + "," + gap_ema(2 / 25), "g", ["symbol", "date"], ["ema_24"]))
def w15(spark, sf):
    x = gappy(I.hourly(spark, sf)).select("symbol", "date", "v")
    return rounded(scan(x, LY, [Ema("v", "ema_24", span=24, adjust=True)]).drop("v"))


@query("w15_ema_adjusted_in_blocks", finish(I.HOURLY_SQL + GAPPY + "," + gap_ema(2 / 25), "g", ["symbol", "date"], ["ema_24"]))
def w15_blocks(spark, sf):
    x = gappy(indexed(spark, sf)).select("symbol", "date", "row_index", "v")
    return rounded(ema_in_blocks(x, ["symbol"], "v", "ema_24", 24, block_rows=64, adjust=True).select("symbol", "date", "ema_24"))


# ---- persistence, entropy, memory ------------------------------------------

RISES = f", c AS (SELECT symbol, date, close, volume, {B.diff('close')} AS d FROM hourly)"
rises = lambda h: h.withColumn("d", LY.diff("close"))
simple("w16_k_of_l_persistence",
       {"rises_5": B.count_true("d > 0", 5), "k3_of_5": B.k_of_l("d > 0", 3, 5), "k3_of_4": B.k_of_l("d > 0", 3, 4, 3)},
       lambda h: rises(h).withColumns({
           "rises_5": LY.count_true(F.col("d") > 0, 5), "k3_of_5": LY.k_of_l(F.col("d") > 0, 3, 5),
           "k3_of_4": LY.k_of_l(F.col("d") > 0, 3, 4, 3)}),
       flags=("k3_of_5", "k3_of_4"), prior=RISES, source="c")
simple("w16b_all_of_l_persistence", {"all_3": flag(f"{B.count_true('d > 1e-9', 3)} = 3")},
       lambda h: rises(h).withColumn("all_3", sflag(LY.count_true(F.col("d") > 1e-9, 3) == 3)),
       flags=("all_3",), prior=RISES, source="c")
simple("w17_sign_entropy", {"entropy_12": B.entropy("s", 12), "entropy_24": B.entropy("s", 24)},
       lambda h: h.withColumn("s", sign(F.coalesce(LY.diff("close"), F.lit(0.0)))).withColumns({
           "entropy_12": LY.sign_entropy("s", 12), "entropy_24": LY.sign_entropy("s", 24)}),
       prior=f", c AS (SELECT symbol, date, sign(coalesce({B.diff('close')}, 0)) AS s FROM hourly)", source="c")


def frac_sql(d: float = 0.4, cutoff: float = 0.01) -> str:
    # (-1)^k times d over k, by the gamma function: gamma(k - d) / (gamma(-d) gamma(k + 1)).
    exact = [math.gamma(k - d) / (math.gamma(-d) * math.gamma(k + 1)) for k in range(100)]
    weights = exact[:next(k for k, w in enumerate(exact) if abs(w) < cutoff)]
    terms = " + ".join(f"{w!r}::DOUBLE * {B.lag('close', i) if i else 'close'}" for i, w in enumerate(weights))
    return f"(CASE WHEN rn + 1 >= {len(weights)} THEN {terms} ELSE 0.0 END)"


simple("w18_fractional_difference", {"close_fracdiff": frac_sql()}, lambda h: h.withColumns(dict(close_fracdiff=LY.frac_diff("close", 0.4))))
simple("w19_forward_fill", {"filled": B.ffill("v")}, lambda h: gappy(h).withColumn("filled", LY.ffill("v")), prior=GAPPY, source="gappy")
MAS = f", c AS (SELECT symbol, date, close, {B.mean('close', 6)} AS s, {B.mean('close', 24)} AS m FROM hourly)"
mas = lambda h: h.withColumns({"s": LY.mean("close", 6), "m": LY.mean("close", 24)})
simple("w20_slope", {"slope_6": f"{B.diff('close', 6)} / (6 + 1e-8)", "ma_slope": B.diff("s")},
       lambda h: mas(h).withColumns({"slope_6": LY.diff("close", 6) / F.lit(6 + 1e-8), "ma_slope": LY.diff("s")}),
       prior=MAS, source="c")
simple("w21_ratio_deviation",
       {"ratio_s_m": ratio("s", "m"), "dev_s_m": f"abs({ratio('s', 'm')} - 1)", "dev_pct": ratio("close - m", "m"), "gap": "close - m"},
       lambda h: mas(h).withColumns({
           "ratio_s_m": sratio(F.col("s"), F.col("m")), "dev_s_m": F.abs(sratio(F.col("s"), F.col("m")) - 1),
           "dev_pct": sratio(F.col("close") - F.col("m"), F.col("m")), "gap": F.col("close") - F.col("m")}),
       prior=MAS, source="c")

# ---- the same windows, one long series cut into blocks ---------------------


@query("w_blocks_with_halo", finish(
    I.HOURLY_SQL + f", x AS (SELECT symbol, date, {B.mean('close', 96)} AS mean_96, {B.std('close', 24)} AS std_24, "
    f"{B.lag('close', 12)} AS lag_12 FROM hourly)", "x", ["symbol", "date"], ["mean_96", "std_24", "lag_12"]))
def w_blocks(spark, sf):
    def build(df, ly):
        return df.withColumns({"mean_96": ly.mean("close", 96), "std_24": ly.std("close", 24), "lag_12": ly.lag("close", 12)})

    x = in_blocks(indexed(spark, sf), ["symbol"], "row_index", build, before=96, block_rows=128)
    return rounded(x.select("symbol", "date", "mean_96", "std_24", "lag_12"))


@query("w_blocks_from_time", f"""WITH {I.HOURLY_SQL}, x AS (SELECT symbol, date, {B.max('close', 24, 1)} AS max_24 FROM hourly)
SELECT symbol, date, max_24 FROM x""")
def w_blocks_from_time(spark, sf):
    def build(df, ly):
        return df.withColumn("max_24", ly.max("close", 24, 1))

    h = I.hourly(spark, sf).select("symbol", "date", "close")
    return windows_in_blocks(h, ["symbol"], "date", build, before=24, block_rows=64).select("symbol", "date", "max_24")


@query("w_blocks_with_both_halos", finish(
    I.HOURLY_SQL + f", x AS (SELECT symbol, date, {B.lead('close', 4)} AS lead_4, stddev_samp(close) {B.rows(3, 3)} AS std_centred, "
    f"{B.diff('close', 30)} AS diff_30 FROM hourly)", "x", ["symbol", "date"], ["lead_4", "std_centred", "diff_30"]))
def w_blocks_both(spark, sf):
    def build(df, ly):
        return df.withColumns({"lead_4": ly.lead("close", 4), "std_centred": ly.fold("std", F.stddev_samp, -3, 3, F.col("close")),
                               "diff_30": ly.diff("close", 30)})

    h = I.hourly(spark, sf).select("symbol", "date", "close")
    x = windows_in_blocks(h, ["symbol"], "date", build, before=30, after=4, block_rows=32)
    return rounded(x.select("symbol", "date", "lead_4", "std_centred", "diff_30"))


@query("w19_forward_fill_in_blocks", f"WITH {I.HOURLY_SQL}{GAPPY} SELECT symbol, date, {B.ffill('v')} AS filled FROM gappy")
def w19_blocks(spark, sf):
    x = ffill_in_blocks(gappy(indexed(spark, sf)), ["symbol"], "row_index", "v", "filled", 128)
    return x.select("symbol", "date", "filled")


# ---- technical indicators --------------------------------------------------

HEAD = I.HOURLY_SQL + f""",
base AS MATERIALIZED (
  SELECT symbol, date, rn + 1 AS rn, close, high, low, {B.lag('close')} AS prev, {B.diff('close')} AS chg FROM hourly)"""
RSI_SQL = HEAD + f""",
ud AS MATERIALIZED (SELECT *, greatest(chg, 0.0) AS up, greatest(-chg, 0.0) AS down FROM base),
r(symbol, rn, u, d) AS (
  SELECT symbol, 15::BIGINT, avg(up), avg(down) FROM ud WHERE rn BETWEEN 2 AND 15 GROUP BY symbol HAVING count(*) = 14
  UNION ALL
  SELECT b.symbol, b.rn, (r.u * 13 + b.up) / 14, (r.d * 13 + b.down) / 14 FROM r JOIN ud b ON b.symbol = r.symbol AND b.rn = r.rn + 1),
x AS (SELECT b.symbol, b.date, CASE WHEN u + d = 0 THEN 0.0 ELSE 100 * u / (u + d) END AS "RSI" FROM base b LEFT JOIN r USING (symbol, rn))"""


def narrow(spark, sf):
    return I.hourly(spark, sf).select("symbol", "date", "close", "high", "low")


@query("ti1_rsi_wilder", finish(RSI_SQL, "x", ["symbol", "date"], ['"RSI"']))
def ti1(spark, sf):
    return rounded(scan(narrow(spark, sf), LY, [Rsi("close")]).select("symbol", "date", "RSI"))


def narrow_rows(spark, sf):
    return row_index(narrow(spark, sf), ["symbol"], ["date"], F.date_trunc("day", "date"))


@query("ti1_rsi_wilder_in_blocks", finish(RSI_SQL, "x", ["symbol", "date"], ['"RSI"']))
def ti1_blocks(spark, sf):
    return rounded(rsi_in_blocks(narrow_rows(spark, sf), ["symbol"], "close", block_rows=64).select("symbol", "date", "RSI"))


SOFT = (f"greatest(chg, 0.0)", f"greatest(-chg, 0.0)")
RSI_SIMPLE = HEAD + f""",
x AS (SELECT symbol, date, rn, 100.0 - 100.0 / (1.0 + {B.mean(f"CASE WHEN chg IS NOT NULL THEN {SOFT[0]} END", 14, 1)} /
      ({B.mean(f"CASE WHEN chg IS NOT NULL THEN {SOFT[1]} END", 14, 1)} + 1e-8)) AS rsi FROM base)"""


def rsi_simple(h):
    x = h.withColumn("chg", LY.diff("close"))
    moved = F.col("chg").isNotNull()
    gain = LY.mean(F.when(moved, F.greatest(F.col("chg"), F.lit(0.0))), 14, 1)
    loss = LY.mean(F.when(moved, F.greatest(-F.col("chg"), F.lit(0.0))), 14, 1)
    return x.withColumn("rsi", F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + sratio(gain, loss + F.lit(1e-8))))


@query("ti1b_rsi_simple", finish(RSI_SIMPLE, "x", ["symbol", "date"], ["rsi"]))
def ti1b(spark, sf):
    return rounded(rsi_simple(narrow(spark, sf)).select("symbol", "date", "rsi"))


def seeded(name: str, source: str, column: str, period: int, first: int, out: str, key: str = "symbol") -> str:
    k = repr(2.0 / (period + 1)) + "::DOUBLE"
    return f"""
{name}({key}, rn, {out}) AS (
  SELECT {key}, {first}::BIGINT, avg({column}) FROM {source} WHERE rn BETWEEN {first - period + 1} AND {first}
  GROUP BY {key} HAVING count(*) = {period}
  UNION ALL
  SELECT b.{key}, b.rn, p.{out} * (1.0 - {k}) + b.{column} * {k} FROM {name} p JOIN {source} b ON b.{key} = p.{key} AND b.rn = p.rn + 1)"""


MACD_SQL = HEAD + "," + seeded("f", "base", "close", 12, 26, "fast") + "," + seeded("s", "base", "close", 26, 26, "slow") + """,
line AS MATERIALIZED (SELECT f.symbol, f.rn, fast - slow AS m FROM f JOIN s USING (symbol, rn)),""" + seeded(
    "g", "line", "m", 9, 34, "sig") + """,
x AS (SELECT b.symbol, b.date, CASE WHEN sig IS NOT NULL THEN m END AS "MACD", sig AS "MACD_signal", m - sig AS "MACD_hist"
      FROM base b LEFT JOIN line USING (symbol, rn) LEFT JOIN g USING (symbol, rn))"""


@query("ti2_macd", finish(MACD_SQL, "x", ["symbol", "date"], ['"MACD"', '"MACD_signal"', '"MACD_hist"']))
def ti2(spark, sf):
    return rounded(scan(narrow(spark, sf), LY, [Macd("close")]).drop("close", "high", "low"))


@query("ti2_macd_in_blocks", finish(MACD_SQL, "x", ["symbol", "date"], ['"MACD"', '"MACD_signal"', '"MACD_hist"']))
def ti2_blocks(spark, sf):
    x = macd_in_blocks(narrow_rows(spark, sf), ["symbol"], "close", block_rows=64)
    return rounded(x.select("symbol", "date", "MACD", "MACD_signal", "MACD_hist"))


simple("ti3_bollinger_bands",
       {"upper": f"{B.mean('close', 20)} + 2.0 * {B.std_pop('close', 20)}", "middle": B.mean("close", 20),
        "lower": f"{B.mean('close', 20)} - 2.0 * {B.std_pop('close', 20)}", "width": f"4.0 * {B.std_pop('close', 20)}"},
       lambda h: h.withColumns(dict(upper=LY.mean("close", 20) + LY.std_pop("close", 20) * 2.0, middle=LY.mean("close", 20),
                    lower=LY.mean("close", 20) - LY.std_pop("close", 20) * 2.0, width=LY.std_pop("close", 20) * 4.0)))

EMA_RATIO_SQL = HEAD + "," + seeded("f", "base", "close", 12, 12, "e12") + "," + seeded("s", "base", "close", 26, 26, "e26") + """,
x AS (SELECT b.symbol, b.date, e12 AS "EMA_12", e26 AS "EMA_26", e12 / (e26 + 1e-9) AS "EMA_ratio"
      FROM base b LEFT JOIN f USING (symbol, rn) LEFT JOIN s USING (symbol, rn))"""


@query("ti4_seeded_ema", finish(EMA_RATIO_SQL, "x", ["symbol", "date"], ['"EMA_12"', '"EMA_26"', '"EMA_ratio"']))
def ti4(spark, sf):
    x = scan(narrow(spark, sf), LY, [SeededEma("close", "EMA_12", 12), SeededEma("close", "EMA_26", 26)])
    x = x.withColumn("EMA_ratio", sratio(F.col("EMA_12"), F.col("EMA_26") + F.lit(1e-9)))
    return rounded(x.drop("close", "high", "low"))


@query("ti4_seeded_ema_in_blocks", finish(EMA_RATIO_SQL, "x", ["symbol", "date"], ['"EMA_12"', '"EMA_26"', '"EMA_ratio"']))
def ti4_blocks(spark, sf):
    x = seeded_ema_in_blocks(narrow_rows(spark, sf), ["symbol"], "close", {"EMA_12": 12, "EMA_26": 26}, block_rows=64)
    x = x.withColumn("EMA_ratio", sratio(F.col("EMA_12"), F.col("EMA_26") + F.lit(1e-9)))
    return rounded(x.select("symbol", "date", "EMA_12", "EMA_26", "EMA_ratio"))


K = f"(CASE WHEN {B.max('high', 14)} = {B.min('low', 14)} THEN 0.0 ELSE 100.0 * (close - {B.min('low', 14)}) / ({B.max('high', 14)} - {B.min('low', 14)}) END)"
STOCH_SQL = HEAD + f""",
k0 AS (SELECT symbol, date, {K} AS k FROM base), k1 AS (SELECT symbol, date, {B.mean('k', 3)} AS sk FROM k0),
k2 AS (SELECT symbol, date, sk, {B.mean('sk', 3)} AS slowd FROM k1),
x AS (SELECT symbol, date, CASE WHEN slowd IS NOT NULL THEN sk END AS slowk, slowd FROM k2)"""


def stochastic(h):
    x = h.withColumns({"hh": LY.max("high", 14), "ll": LY.min("low", 14)})
    span = F.col("hh") - F.col("ll")
    x = x.withColumn("k", F.when(span == 0, 0.0).otherwise(F.try_divide(F.col("close") - F.col("ll"), span) * 100.0))
    x = x.withColumn("sk", LY.mean("k", 3)).withColumn("slowd", LY.mean("sk", 3))
    return x.withColumn("slowk", F.when(F.col("slowd").isNotNull(), F.col("sk")))


@query("ti5_stochastic", finish(STOCH_SQL, "x", ["symbol", "date"], ["slowk", "slowd"]))
def ti5(spark, sf):
    return rounded(stochastic(narrow(spark, sf)).select("symbol", "date", "slowk", "slowd"))


ATR_SQL = HEAD + """,
tr AS MATERIALIZED (SELECT symbol, rn, greatest(high - low, abs(high - prev), abs(low - prev)) AS t FROM base WHERE prev IS NOT NULL),
a(symbol, rn, v) AS (
  SELECT symbol, 25::BIGINT, avg(t) FROM tr WHERE rn BETWEEN 2 AND 25 GROUP BY symbol HAVING count(*) = 24
  UNION ALL
  SELECT b.symbol, b.rn, (a.v * 23 + b.t) / 24 FROM a JOIN tr b ON b.symbol = a.symbol AND b.rn = a.rn + 1),
x AS (SELECT b.symbol, b.date, v AS "ATR24" FROM base b LEFT JOIN a USING (symbol, rn))"""


@query("ti6_atr", finish(ATR_SQL, "x", ["symbol", "date"], ['"ATR24"']))
def ti6(spark, sf):
    return rounded(scan(narrow(spark, sf), LY, [Atr("high", "low", "close", "ATR24", 24)]).select("symbol", "date", "ATR24"))


@query("ti6_atr_in_blocks", finish(ATR_SQL, "x", ["symbol", "date"], ['"ATR24"']))
def ti6_blocks(spark, sf):
    x = atr_in_blocks(narrow_rows(spark, sf), ["symbol"], "high", "low", "close", "ATR24", 24, block_rows=64)
    return rounded(x.select("symbol", "date", "ATR24"))


BW = ratio(f"2.0 * {B.std('close', 20, 1)}", f"abs({B.mean('close', 20, 1)}) + 1e-8")
simple("ti7_band_width",
       {"bb_width_20": "w", "bb_width_change_6": B.pct("w", 6),
        "bb_compression_ratio": ratio("w", f"{B.quantile('w', 0.5, 168, 24)} + 1e-8")},
       lambda h: h.withColumn("bb_width_20", sratio(LY.std("close", 20, 1) * 2.0, F.abs(LY.mean("close", 20, 1)) + F.lit(1e-8)))
       .withColumns({"bb_width_change_6": LY.pct_change("bb_width_20", 6),
                     "bb_compression_ratio": sratio(F.col("bb_width_20"), LY.median("bb_width_20", 168, 24) + F.lit(1e-8))}),
       prior=f", c AS (SELECT symbol, date, {BW} AS w FROM hourly)", source="c")

# ---- flags -----------------------------------------------------------------

GAPS = f", c AS (SELECT symbol, date, close, {B.mean('close', 6)} AS s, {B.mean('close', 24)} AS m, {B.mean('close', 72)} AS l FROM hourly)"
gaps = lambda h: h.withColumns({"s": LY.mean("close", 6), "m": LY.mean("close", 24), "l": LY.mean("close", 72)})
simple("f1_ma_cross",
       {"cross_flag": f"CASE WHEN {B.lag('s - m')} < 0 AND s - m >= 0 THEN 1 WHEN {B.lag('s - m')} > 0 AND s - m <= 0 THEN -1 ELSE 0 END"},
       lambda h: gaps(h).withColumn("g", F.col("s") - F.col("m")).withColumn("cross_flag", LY.ma_cross("g")),
       flags=("cross_flag",), prior=GAPS, source="c")
simple("f1b_cross_step", {"cross_step": B.step(flag("s > m"))},
       lambda h: gaps(h).withColumn("cross_step", LY.step_of_flag(sflag(F.col("s") > F.col("m")))),
       flags=("cross_step",), prior=GAPS, source="c")
SLOPES = GAPS + f", d AS (SELECT *, {B.diff('s')} AS ds, {B.diff('m')} AS dm, {B.diff('l')} AS dl FROM c)"
slopes = lambda h: gaps(h).withColumns({"ds": LY.diff("s"), "dm": LY.diff("m"), "dl": LY.diff("l")})
simple("f2_slope_sign",
       {"disagree": flag("ds * dm < 0"),
        "turned": f"CASE WHEN ds IS NOT NULL AND {B.lag('ds')} IS NOT NULL AND sign(ds) = sign({B.lag('ds')}) THEN 0 ELSE 1 END"},
       lambda h: slopes(h).withColumns({"disagree": sflag(F.col("ds") * F.col("dm") < 0), "turned": LY.sign_changed("ds")}),
       flags=("disagree", "turned"), prior=SLOPES, source="d")
simple("f3_trend_stack", {"stacked": flag("s > m AND m > l AND ds > 0 AND dm > 0 AND dl > 0"), "ordered": flag("s > m AND m > l")},
       lambda h: slopes(h).withColumns({
           "stacked": sflag((F.col("s") > F.col("m")) & (F.col("m") > F.col("l")) & (F.col("ds") > 0) & (F.col("dm") > 0) & (F.col("dl") > 0)),
           "ordered": sflag((F.col("s") > F.col("m")) & (F.col("m") > F.col("l")))}),
       flags=("stacked", "ordered"), prior=SLOPES, source="d")


def low_latch(x, enter, leave):
    return (f"coalesce(last_value(CASE WHEN {x} <= {enter} THEN 1 WHEN {x} >= {leave} THEN 0 END IGNORE NULLS) {B.sofar}, 0)")


simple("f4_hysteresis_latch", {"high_on": B.latch("v", 8, 3), "low_on": low_latch("v", 2, 6)},
       lambda h: gappy(h).withColumns({"high_on": LY.latch(F.col("v"), 8.0, 3.0), "low_on": LY.latch(F.col("v"), 2.0, 6.0, "low")}),
       flags=("high_on", "low_on"), prior=GAPPY, source="gappy")


@query("f4_latch_in_blocks", f"WITH {I.HOURLY_SQL} SELECT symbol, date, {B.latch('close', 8, 3)} AS high_on FROM hourly")
def f4_blocks(spark, sf):
    return latch_in_blocks(indexed(spark, sf), ["symbol"], "row_index", "close", "high_on", 8.0, 3.0, 128).select(
        "symbol", "date", "high_on")


CROSSED_SQL = HEAD + """,
r(symbol, rn, st) AS (
  SELECT symbol, rn, CASE WHEN close >= 3 THEN 1 ELSE 0 END FROM base WHERE rn = 1
  UNION ALL
  SELECT b.symbol, b.rn, CASE WHEN r.st = 0 AND b.close >= 3 THEN 1 WHEN r.st = 1 AND b.close <= 8 THEN 0 ELSE r.st END
  FROM r JOIN base b ON b.symbol = r.symbol AND b.rn = r.rn + 1)
"""


@query("f4_latch_crossed_levels", "WITH RECURSIVE " + CROSSED_SQL + "SELECT symbol, date, st AS state FROM r JOIN base USING (symbol, rn)")
def f4_crossed(spark, sf):
    x = cusum.latch(I.hourly(spark, sf).select("symbol", "date", "close"), LY, "close", "state", 3.0, 8.0)
    return x.select("symbol", "date", "state")


DRIFT_SQL = HEAD + f""",
d AS MATERIALIZED (SELECT symbol, rn, date, close AS v, {B.mean('close', 200, 50)} AS mu, {B.std('close', 200, 50)} * 0.5 AS th FROM base),
r(symbol, rn, pos, neg, up, down) AS (
  SELECT symbol, rn, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM d WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, pos, neg, CAST(coalesce(pos > th, false) AS INT), CAST(coalesce(neg > th, false) AS INT) FROM (
    SELECT d.symbol, d.rn, d.th, CASE WHEN v - mu > th THEN r.pos + v - mu ELSE 0.0 END AS pos,
           CASE WHEN mu - v > th THEN r.neg + mu - v ELSE 0.0 END AS neg
    FROM r JOIN d ON d.symbol = r.symbol AND d.rn = r.rn + 1))
"""


@query("f5_run_sum_cusum_flags", "WITH RECURSIVE " + DRIFT_SQL + "SELECT symbol, date, up AS up_flag, down AS down_flag FROM r JOIN base USING (symbol, rn)")
def f5(spark, sf):
    up, down = cusum.drift_flags(LY, "close", LY.mean("close", 200, 50), LY.std("close", 200, 50) * 0.5)
    return I.hourly(spark, sf).select("symbol", "date", up.alias("up_flag"), down.alias("down_flag"))


RESET_SQL = HEAD + f""",
d AS MATERIALIZED (SELECT symbol, rn, date, close - avg(close) {B.whole} AS v FROM base),
r(symbol, rn, pos, neg, up, down) AS (
  SELECT symbol, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0, 0 FROM d GROUP BY symbol
  UNION ALL
  SELECT symbol, rn, CASE WHEN p > 20 THEN 0.0 ELSE p END, CASE WHEN p <= 20 AND n < -20 THEN 0.0 ELSE n END,
         CAST(p > 20 AS INT), CAST(p <= 20 AND n < -20 AS INT) FROM (
    SELECT d.symbol, d.rn, greatest(0.0, r.pos + v) AS p, least(0.0, r.neg + v) AS n
    FROM r JOIN d ON d.symbol = r.symbol AND d.rn = r.rn + 1))
"""
RESET_OUT = "WITH RECURSIVE " + RESET_SQL + "SELECT symbol, date, up AS close_cusum_up_flag, down AS close_cusum_down_flag FROM r JOIN base USING (symbol, rn)"


@query("f6_resetting_cusum_flags", RESET_OUT)
def f6(spark, sf):
    x = cusum.add_cusum_flags(I.hourly(spark, sf).select("symbol", "date", "close"), LY, {"close": 20.0, "absent": 1.0})
    return x.drop("close")


@query("f6_resetting_cusum_in_blocks", RESET_OUT)
def f6_blocks(spark, sf):
    x = indexed(spark, sf).join(I.hourly(spark, sf).groupBy("symbol").agg(F.avg("close").alias("mu")), "symbol")
    x = x.withColumn("dev", F.col("close") - F.col("mu"))
    out = cusum.cusum_in_blocks(x, ["symbol"], "dev", 20.0, "close_cusum_up_flag", "close_cusum_down_flag", block_rows=128)
    return out.select("symbol", "date", "close_cusum_up_flag", "close_cusum_down_flag")


EVENT_SQL = HEAD + f""",
d AS MATERIALIZED (SELECT symbol, rn, date, close, chg, {B.qwhole('abs(chg)', 0.9)} AS th FROM base),
r(symbol, rn, pos, neg, ev) AS (
  SELECT symbol, rn, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM d WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN p > th THEN 0.0 ELSE p END, CASE WHEN p <= th AND n < -th THEN 0.0 ELSE n END,
         CAST(p > th OR n < -th AS INT) FROM (
    SELECT d.symbol, d.rn, d.th, greatest(0.0, r.pos + chg) AS p, least(0.0, r.neg + chg) AS n
    FROM r JOIN d ON d.symbol = r.symbol AND d.rn = r.rn + 1))
SELECT symbol, date, close FROM r JOIN d USING (symbol, rn) WHERE ev = 1"""


@query("f7_cusum_event_sampler", "WITH RECURSIVE " + EVENT_SQL)
def f7(spark, sf):
    return cusum.cusum_events(I.hourly(spark, sf).select("symbol", "date", "close"), LY, "close", 0.9)


@query("f7_cusum_event_sampler_in_blocks", "WITH RECURSIVE " + EVENT_SQL)
def f7_blocks(spark, sf):
    x = cusum.cusum_events_in_blocks(indexed(spark, sf).drop("volume"), ["symbol"], "close", 0.9, block_rows=64)
    return x.select("symbol", "date", "close")


ADAPT_SQL = HEAD + f""",
c AS (SELECT symbol, rn, date, close, chg, {B.pct('close')} AS pc FROM base),
d AS MATERIALIZED (SELECT *, 0.01 + 0.5 * coalesce({B.std('pc', 50)}, 0.0) AS th FROM c),
r(symbol, rn, pos, neg, ev) AS (
  SELECT symbol, rn, 0.0::DOUBLE, 0.0::DOUBLE, 1 FROM d WHERE rn = 1
  UNION ALL
  SELECT symbol, rn, CASE WHEN p > th OR n < -th THEN 0.0 ELSE p END, CASE WHEN p > th OR n < -th THEN 0.0 ELSE n END,
         CAST(p > th OR n < -th AS INT) FROM (
    SELECT d.symbol, d.rn, d.th, greatest(0.0, r.pos + chg) AS p, least(0.0, r.neg + chg) AS n
    FROM r JOIN d ON d.symbol = r.symbol AND d.rn = r.rn + 1)),
x AS (SELECT symbol, date, close, th AS threshold FROM r JOIN d USING (symbol, rn) WHERE ev = 1)"""


@query("f8_adaptive_cusum_sampler", finish(ADAPT_SQL, "x", ["symbol", "date", "close"], ["threshold"]))
def f8(spark, sf):
    return rounded(cusum.cusum_events_adaptive(I.hourly(spark, sf).select("symbol", "date", "close"), LY, "close"))


simple("f9_breakouts",
       {"break_up": flag(f"close > max(close) {B.rows(24, -1)}"), "break_down": flag(f"close < min(close) {B.rows(24, -1)}")},
       lambda h: h.withColumns(dict(break_up=sflag(F.col("close") > F.max("close").over(LY.rows(-24, -1))),
                    break_down=sflag(F.col("close") < F.min("close").over(LY.rows(-24, -1))))),
       flags=("break_up", "break_down"))
REGIME = {"es": ("close", 2 / 11), "el": ("close", 2 / 31)}


@query("f10_ema_regime", f"WITH RECURSIVE {I.HOURLY_SQL}{ROWS}," + scan_ema("e", "base", "symbol", REGIME) + f"""
SELECT symbol, date, {flag('es > el')} AS regime_up_flag, {flag('es < el')} AS regime_down_flag FROM e JOIN base USING (symbol, rn)""")
def f10(spark, sf):
    x = scan(I.hourly(spark, sf).select("symbol", "date", "close"), LY, [Ema("close", "es", span=10), Ema("close", "el", span=30)])
    return x.select("symbol", "date", sflag(F.col("es") > F.col("el")).alias("regime_up_flag"),
                    sflag(F.col("es") < F.col("el")).alias("regime_down_flag"))


MS = f", c AS (SELECT symbol, date, close, {B.mean('close', 200)} AS mu, {B.std('close', 200)} AS sd FROM hourly)"
simple("f11_spike_crash", {"spike": flag("close > mu + 2 * sd"), "crash": flag("close < mu - 2 * sd")},
       lambda h: h.withColumns({"mu": LY.mean("close", 200), "sd": LY.std("close", 200)}).withColumns({
           "spike": sflag(F.col("close") > F.col("mu") + F.col("sd") * 2), "crash": sflag(F.col("close") < F.col("mu") - F.col("sd") * 2)}),
       flags=("spike", "crash"), prior=MS, source="c")
BB = ratio(f"{B.std('close', 20, 10)} * 2", f"abs({B.mean('close', 20, 10)}) + 1e-8")
VOLS = f""", c0 AS (SELECT symbol, date, close, {B.pct('close')} AS r, {BB} AS bb FROM hourly),
c AS (SELECT *, {B.std('r', 24, 12)} AS sd FROM c0)"""
simple("f12_volatility_flags",
       {"high_vol_flag": flag(f"sd > 1.5 * {B.expanding('sd', 0.5, 24)}"), "squeeze_flag": flag(f"bb < {B.expanding('bb', 0.2, 100)}"),
        "reexp_flag": flag(f"{B.pct('bb', 6)} > 0.3")},
       lambda h: scan(
           h.select("symbol", "date", "close").withColumns({
               "r": LY.pct_change("close"),
               "bb": sratio(LY.std("close", 20, 10) * 2, F.abs(LY.mean("close", 20, 10)) + F.lit(1e-8))})
           .withColumn("sd", LY.std("r", 24, 12)), LY,
           [RunningQuantile("sd", "med", 0.5, 24), RunningQuantile("bb", "q20", 0.2, 100)]).withColumns({
               "high_vol_flag": sflag(F.col("sd") > F.col("med") * 1.5), "squeeze_flag": sflag(F.col("bb") < F.col("q20")),
               "reexp_flag": sflag(LY.pct_change("bb", 6) > 0.3)}),
       flags=("high_vol_flag", "squeeze_flag", "reexp_flag"), prior=VOLS, source="c")
SURGE = f", c AS (SELECT symbol, date, {B.diff('volume', 3)} AS d FROM hourly)"
simple("f14_surge_flag", {"surge": flag(f"{ratio('d', B.std('d', 12) + ' + 1e-9')} > 2")},
       lambda h: h.withColumn("d", LY.diff("volume", 3)).withColumn(
           "surge", sflag(sratio(F.col("d"), LY.std("d", 12) + F.lit(1e-9)) > 2)),
       flags=("surge",), prior=SURGE, source="c")
GROWTH = MAS + f", g AS (SELECT symbol, date, {ratio('s - m', 'm + 1e-9')} AS g FROM c)"
simple("f15_growth_tails",
       {"growth_flag": f"CASE WHEN g > {B.qwhole('g', 0.9)} THEN 1 WHEN g < {B.qwhole('g', 0.1)} THEN -1 ELSE 0 END"},
       lambda h: mas(h).withColumn("g", sratio(F.col("s") - F.col("m"), F.col("m") + F.lit(1e-9))).withColumn(
           "growth_flag", fit.ternary_quantile_flag(LY, "g")),
       flags=("growth_flag",), prior=GROWTH, source="g")
CONF = f""", c0 AS (SELECT symbol, date, close, {B.mean('close', 20)} + 2 * {B.std_pop('close', 20)} AS upper, {B.logret('close')} AS r,
  {B.zscore('volume', 24, '1e-9')} AS z, {B.mean('close', 24)} AS m FROM hourly)"""
simple("f16_breakout_agreement",
       {"breakout_count": B.count_true("close > upper", 3), "above_mean": flag("close > m"), "bullish": flag("z > 1 AND r > 0"), "bearish": flag("z > 1 AND r < 0")},
       lambda h: h.withColumns({
           "upper": LY.mean("close", 20) + LY.std_pop("close", 20) * 2, "r": LY.log_return("close"),
           "z": LY.zscore("volume", 24, 1e-9), "m": LY.mean("close", 24)}).withColumns({
               "breakout_count": LY.count_true(F.col("close") > F.col("upper"), 3), "above_mean": sflag(F.col("close") > F.col("m")),
               "bullish": sflag((F.col("z") > 1) & (F.col("r") > 0)), "bearish": sflag((F.col("z") > 1) & (F.col("r") < 0))}),
       flags=("above_mean", "bullish", "bearish"), prior=CONF, source="c0")
simple("f18_level_flags",
       {"over_half": flag("volume / 97.0 > 0.5"), "under_half": flag("volume / 97.0 < 0.5"), "high_level": flag(f"volume >= {B.qwhole('volume', 0.7)}"),
        "low_level": flag(f"volume <= {B.qwhole('volume', 0.3)}")},
       lambda h: h.withColumns(dict(over_half=sflag(dbl("volume") / 97.0 > 0.5), under_half=sflag(dbl("volume") / 97.0 < 0.5),
                    high_level=fit.quantile_flag(LY, "volume", 0.7, ">="), low_level=fit.quantile_flag(LY, "volume", 0.3, "<="))),
       flags=("over_half", "under_half", "high_level", "low_level"))
