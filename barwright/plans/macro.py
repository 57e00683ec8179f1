"""One operator for slow driver series, configured per series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.over import Layout
from ..functions.scalar import dbl, flag
from ..operators.cusum import drift_flags
from ..operators.fit import quantile_flag
from ..operators.scan import Ema, scan

DRIFT_WINDOW, DRIFT_NEED = 200, 50


@dataclass(frozen=True)
class Macro:
    """``level`` names the z-score column, ``delta`` the difference; ``prefix`` the flags.
    ``spans`` (short, long) turns on regime flags, ``sigma`` the drift flags; ``pad`` carries
    values forward for the flags."""

    column: str
    z_window: int
    level: str
    delta: str
    prefix: str
    spans: tuple[int, int] | None = None
    sigma: float | None = None
    pad: bool = True


WEEK, FORTNIGHT = 24 * 7, 24 * 14

# Windows, spans and thresholds per driver series.
VIX = (Macro("VIX_close", 252, "VIX_zn", "delta_VIX", "VIX", (10, 30), 0.5, pad=False),)
FUNDING = (Macro("fundingRate", 200, "funding_zn", "delta_funding", "funding", (10, 30), 0.5, pad=False),)
LIQUIDITY = (Macro("GLI_norm", 252, "gli_zn", "delta_gli", "gli", (30, 90), 0.5, pad=False),)
BTC_DOMINANCE = (Macro("btc_dominance", 252, "btc_dom_zn", "delta_btc_dom", "btc_dom", (20, 60), 0.5, pad=False),)
STABLECOIN = (
    Macro("stablecoin_volume_usd", WEEK, "stablecoin_volume_usd_zn", "delta_stablecoin_volume_usd", ""),
    Macro("velocity_stablecoin_24h", WEEK, "velocity_stablecoin_24h_zn", "delta_velocity_stablecoin_24h",
          "velocity_stablecoin_24h", (24, WEEK), 0.5),
)
DEX = (Macro("dex_volume_usd", WEEK, "dex_volume_usd_zn", "delta_dex_volume_usd", "dex_volume", (24, WEEK), 0.5),)
ACTIVITY = (
    Macro("median_gas_price", WEEK, "median_gas_price_zn", "delta_median_gas_price", "gas_fee", (12, 84), 0.5),
    Macro("tx_count", WEEK, "tx_count_zn", "delta_tx_count", "tx", (24, WEEK), 2.0),
)
REALIZED_VOL = (Macro("realized_vol_24h", FORTNIGHT, "realized_vol_24h_zn", "delta_realized_vol_24h", ""),)
VOLUME_DOMINANCE = (
    Macro("eth_volume_dominance", FORTNIGHT, "eth_volume_dominance_zn", "delta_eth_volume_dominance", "eth_dom",
          None, 0.5),
)
LONG_SHORT = (
    Macro("long_short_imbalance", WEEK, "long_short_imbalance_zn", "delta_long_short_imbalance", "funding",
          (24, WEEK), 0.5),
)


def macro_features(df: DataFrame, ly: Layout, configs: Sequence[Macro]) -> DataFrame:
    """Level, change, regime and drift columns of every configured series.

    All exponential means run in one grouped pass and all windows in two layers, however
    many series are configured.
    """
    ly = ly.layered()
    missing = [m.column for m in configs if m.column not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    given = set(df.columns)
    means = [
        Ema(m.column, f"_ema{i}_{side}", span=span, pad=m.pad)
        for i, m in enumerate(configs) if m.spans for side, span in zip("sl", m.spans)
    ]
    x = df.withColumns({m.column: dbl(m.column) for m in configs})
    x = scan(x, ly, means) if means else x
    layer: dict[str, Column] = {}
    for i, m in enumerate(configs):
        layer[m.level] = ly.zscore(m.column, m.z_window)
        layer[m.delta] = ly.diff(m.column)
        if m.spans:
            s, l = F.col(f"_ema{i}_s"), F.col(f"_ema{i}_l")
            layer[f"{m.prefix}_regime_up_flag"] = flag(s > l)
            layer[f"{m.prefix}_regime_down_flag"] = flag(s < l)
        if m.sigma is not None:
            layer[f"_v{i}"] = ly.ffill(m.column) if m.pad else F.col(m.column)
    x = ly.add(x, layer)
    layer = {}
    for i, m in enumerate(configs):
        if m.sigma is not None:
            v = F.col(f"_v{i}")
            up, down = drift_flags(
                ly, v, ly.mean(v, DRIFT_WINDOW, DRIFT_NEED), ly.std(v, DRIFT_WINDOW, DRIFT_NEED) * F.lit(m.sigma))
            layer[f"{m.prefix}_cusum_up_flag"], layer[f"{m.prefix}_cusum_down_flag"] = up, down
    x = ly.add(x, layer)
    return x.drop(*[c for c in x.columns if c.startswith(("_ema", "_v")) and c not in given])


def realized_vol_features(df: DataFrame, ly: Layout, high: float = 0.7, low: float = 0.3, train=None) -> DataFrame:
    """Level and change plus quantile regime flags (whole series, or training rows only)."""
    name = REALIZED_VOL[0].column
    return macro_features(df, ly, REALIZED_VOL).withColumns({
        "high_vol_flag": quantile_flag(ly, name, high, ">=", train),
        "low_vol_flag": quantile_flag(ly, name, low, "<=", train),
    })


def volume_dominance_features(df: DataFrame, ly: Layout) -> DataFrame:
    name = VOLUME_DOMINANCE[0].column
    return macro_features(df, ly, VOLUME_DOMINANCE).withColumns({
        "alt_season_flag": flag(F.col(name) > 0.5), "btc_season_flag": flag(F.col(name) < 0.5),
    })


def velocity_features(df: DataFrame, ly: Layout, column: str = "velocity_usd_24h") -> DataFrame:
    """Level, lags, first and second differences, spike/crash, regime and drift flags."""
    ly = ly.layered()
    c = column
    x = scan(df.withColumn(c, dbl(c)), ly, [
        Ema(c, "_ema_s", span=24, adjust=True), Ema(c, "_ema_l", span=72, adjust=True)])
    v = F.col(c)
    x = ly.add(x, {
        "_mu": ly.mean(v, 200), "_sd": ly.std(v, 200),
        **{f"{c}_lag{n}": ly.lag(v, n) for n in (1, 2, 3)},
        f"delta_{c}": ly.diff(v),
    })
    mu, sd = F.col("_mu"), F.col("_sd")
    up, down = drift_flags(ly, v, mu, sd * 0.5)
    x = ly.add(x, {
        f"{c}_zn": ratio_level(v, mu, sd),
        f"delta2_{c}": ly.diff(f"delta_{c}"),
        f"{c}_spike_flag": flag(v > mu + sd * 2.0), f"{c}_crash_flag": flag(v < mu - sd * 2.0),
        f"{c}_regime_up_flag": flag(F.col("_ema_s") > F.col("_ema_l")),
        f"{c}_regime_down_flag": flag(F.col("_ema_s") < F.col("_ema_l")),
        f"{c}_cusum_up_flag": up, f"{c}_cusum_down_flag": down,
    })
    return ly.add(x, {f"delta_{c}_zn": ly.diff(f"{c}_zn")}).drop("_mu", "_sd", "_ema_s", "_ema_l")


def ratio_level(v: Column, mu: Column, sd: Column) -> Column:
    return (v - mu) / (sd + F.lit(1e-8))
