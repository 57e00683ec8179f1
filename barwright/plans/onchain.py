"""Activity-series features: raw transforms, fitted scores, two-threshold flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.over import Layout, log_clipped
from ..functions.scalar import clip, dbl, finite, flag, ratio, zero_to
from ..operators.clean import clip_columns
from ..operators.fit import (
    on_train, quantile_flag, quantile_over, standard_over, ternary_quantile_flag, train_mask, winsor_over,
)
from ..operators.scan import Ema, scan
from .price import settle

EPS = 1e-8

# The seven activity columns, and bounds of the derived ones.
ACTIVITY_COLUMNS = (
    "total_flow_sum", "address_count_sum", "active_receivers", "active_senders",
    "dex_volume", "contract_calls", "whale_tx_count",
)
ACTIVITY_BOUNDS = {
    "active_addresses_growth_6h": (-1.0, 3.0), "active_senders_growth_6h": (-1.0, 3.0),
    "active_receivers_growth_6h": (-1.0, 3.0),
    "active_addresses_z_24h": (-10.0, 10.0), "active_senders_z_24h": (-10.0, 10.0),
    "active_receivers_z_24h": (-10.0, 10.0),
    "transfer_vol_growth_6h": (-1.0, 3.0), "dex_vol_ratio": (0.0, 10.0),
    "ex_in_out_ratio": (0.0, 10.0), "ex_netflow": (-1e12, 1e12), "ex_netflow_change_6h": (-1e12, 1e12),
    "ex_supply_change_24h": (-1e12, 1e12), "ex_supply_ratio": (0.0, 1.0), "top10_hold_ratio": (0.0, 1.0),
    "whale_tx_ratio": (0.0, 1.0), "whale_ratio_ma6": (0.0, 1.0), "whale_ratio_change_6h": (-1.0, 3.0),
    "gas_used_change_6h": (-1.0, 3.0), "gas_used_z_24h": (-10.0, 10.0),
    "unique_contracts_growth_24h": (-1.0, 3.0), "onchain_sentiment": (-20.0, 20.0),
    "active_addresses_zmove_24h": (-10.0, 10.0), "transfer_volume_zmove_24h": (-10.0, 10.0),
    "exchange_inflow_zmove_24h": (-10.0, 10.0), "exchange_outflow_zmove_24h": (-10.0, 10.0),
    "dex_volume_zmove_24h": (-10.0, 10.0),
}


def activity_features(df: DataFrame, ly: Layout, drop: str = "all", columns: Sequence[str] = ACTIVITY_COLUMNS) -> DataFrame:
    """Differences, changes, means, lags and deviations of the activity columns, surge and
    growth flags; after incomplete rows are removed, growth, ratio and move columns for
    whichever optional inputs exist."""
    ly = ly.layered()
    always = (*ly.keys, *ly.order)
    given = list(df.columns)
    df = ly.add(df, {f"_day_{c}": ly.sum(c, 24) for c in columns})
    layer = {}
    for c in columns:
        layer[f"{c}_diff"] = ly.diff(dbl(c))
        layer[f"_pad_{c}"] = ly.ffill(dbl(c))
        for name, n in ((6, 7), (12, 12), (24, 24), (48, 48), (72, 72), (96, 96), (168, 168)):
            layer[f"{c}_MA_t_{name}"] = ly.mean(c, n) if n <= 24 else ly.mean_of_parts(f"_day_{c}", n, 24)
        for n in (1, 3):
            layer[f"{c}_Lag_t_{n}"] = ly.lag(dbl(c), n)
        for n in (7, 30):
            layer[f"{c}_rolling_std_{n}"] = ly.std_centered(c, n)
    layer["_whale3"] = ly.diff(dbl("whale_tx_count"), 3)
    persist = "buy_sell_imbalance" in given
    if persist:
        layer["_lopsided"] = quantile_flag(ly, "buy_sell_imbalance", 0.75, ">")
    x = ly.add(df, layer)
    layer = {}
    for c in columns:
        layer[f"{c}_pct_change"] = ly.pct_change(f"_pad_{c}")
        layer[f"{c}_MA_t_6_slope"] = ly.diff(f"{c}_MA_t_6")
        for n in (6, 24):
            layer[f"{c}_Diff_t_{n}"] = dbl(c) - F.col(f"{c}_MA_t_{n}")
    slow, quick = F.col("active_receivers_MA_t_24"), F.col("active_receivers_MA_t_6")
    layer |= {
        "active_ratio": ratio(dbl("active_receivers"), dbl("active_senders") + F.lit(EPS)),
        "whale_activity_surge_flag": flag(ratio(F.col("_whale3"), ly.std("_whale3", 12) + F.lit(1e-9)) > 2.0),
        "_growth": ratio(quick - slow, zero_to(slow, None) + F.lit(1e-9)),
    }
    if persist:
        layer["dex_flow_imbalance_persistence_flag"] = flag(ly.sum("_lopsided", 5, 3) >= 3)
    x = ly.add(x, layer)
    x = ly.add(x, {"active_receivers_growth_flag": ternary_quantile_flag(ly, "_growth")})
    made = [c for c in x.columns if c not in given and not c.startswith("_")]
    x = settle(x.select(*given, *made), drop, always)
    return clip_columns(optional_activity(x, ly), ACTIVITY_BOUNDS)


def _move(padded_change: Column, ly: Layout, n: int = 24) -> Column:
    """A one-row change in units of its recent deviation."""
    spread = ly.std(padded_change, n, 1)
    return clip(ratio(padded_change, zero_to(spread, EPS)), -10, 10)


def optional_activity(df: DataFrame, ly: Layout) -> DataFrame:
    """Columns that depend on which activity inputs are present."""
    ly = ly.layered()
    has = set(df.columns)
    both = lambda *names: set(names) <= has
    safe = lambda a, b: ratio(dbl(a), dbl(b) + F.lit(EPS))
    growers = [c for c in ("active_addresses", "active_senders", "active_receivers") if c in has]
    movers = [c for c in (
        "active_addresses", "transfer_volume", "exchange_inflow", "exchange_outflow", "dex_volume") if c in has]
    padded = {*growers, *movers, *(c for c in ("gas_used", "unique_contracts", "whale_tx_count") if c in has)}
    x = ly.add(df, {f"_p_{c}": ly.ffill(dbl(c)) for c in sorted(padded)})
    x = ly.add(x, {f"_r_{c}": F.coalesce(ly.pct_change(f"_p_{c}"), F.lit(0.0)) for c in sorted(padded)})
    out: dict[str, Column] = {}
    change = lambda c, n: ly.pct_change(f"_p_{c}", n)
    for c in growers:
        out[f"{c}_growth_6h"] = change(c, 6)
        out[f"{c}_z_24h"] = _move(F.col(f"_r_{c}"), ly)
    if both("transfer_volume"):
        out["transfer_vol_growth_6h"] = change("transfer_volume", 6)
    if both("dex_volume", "transfer_volume"):
        out["dex_vol_ratio"] = safe("dex_volume", "transfer_volume")
    if both("exchange_inflow", "exchange_outflow"):
        net = dbl("exchange_inflow") - dbl("exchange_outflow")
        out |= {
            "ex_in_out_ratio": safe("exchange_inflow", "exchange_outflow"), "ex_netflow": net,
            "ex_netflow_change_6h": ly.diff(net, 6),
        }
    if both("supply_on_exchange"):
        out["ex_supply_change_24h"] = ly.diff(dbl("supply_on_exchange"), 24)
        if both("total_supply"):
            out["ex_supply_ratio"] = safe("supply_on_exchange", "total_supply")
    if both("top10_holdings", "total_supply"):
        out["top10_hold_ratio"] = safe("top10_holdings", "total_supply")
    if both("whale_tx_count", "tx_count"):
        out |= {
            "whale_tx_ratio": safe("whale_tx_count", "tx_count"),
            "whale_ratio_ma6": ratio(
                ly.mean("whale_tx_count", 6, 1), zero_to(ly.mean("tx_count", 6, 1), EPS) + F.lit(EPS)),
            "whale_ratio_change_6h": change("whale_tx_count", 6),
        }
    if both("gas_used"):
        out |= {"gas_used_change_6h": change("gas_used", 6), "gas_used_z_24h": _move(F.col("_r_gas_used"), ly)}
    if both("unique_contracts"):
        out["unique_contracts_growth_24h"] = change("unique_contracts", 24)
    mood = [
        s * log_clipped(F.col(c))
        for c, s in (("active_addresses", 1), ("transfer_volume", 1), ("exchange_inflow", -1)) if c in has
    ]
    if len(mood) >= 2:
        out["onchain_sentiment"] = sum(mood[1:], mood[0]) / F.lit(float(len(mood)))
    for c in movers:
        out[f"{c}_zmove_24h"] = _move(F.col(f"_r_{c}"), ly)
    x = ly.add(x, out)
    return x.drop(*[c for c in x.columns if c.startswith(("_p_", "_r_"))])


# ---- fitted scores ---------------------------------------------------------

def fitted_scores(
    df: DataFrame, ly: Layout, columns: Sequence[str], train: Column | None = None,
    short: int = 6, mid: int = 24, long: int = 72,
    alpha_short: float = 2 / 7, alpha_mid: float = 2 / 25, winsor: tuple[float, float] = (0.005, 0.995),
) -> tuple[DataFrame, list[str]]:
    """Rolling, ratio, change and exponential columns per input, event and regime scores, and
    a train-fitted standard version (``_zn``) of fourteen of them.

    Returns the table and the ``_zn`` names; ``fit.fit_params`` gives the parameters as a
    table.  Fits are whole-partition windows, so they add no exchange.
    """
    ly = ly.layered()
    present = [c for c in columns if c in df.columns]
    x = scan(df, ly, [
        Ema(c, f"{c}_ema_{tag}", alpha=a) for c in present for tag, a in (("s", alpha_short), ("m", alpha_mid))
    ])
    layer: dict[str, Column] = {"_train": train_mask(ly) if train is None else F.coalesce(train, F.lit(False))}
    for c in present:
        v = dbl(c)
        layer |= {
            f"{c}_log1p": F.log1p(v),
            f"{c}_ma_s{short}": ly.mean(v, short, 1), f"{c}_ma_m{mid}": ly.mean(v, mid, 1),
            f"{c}_ma_l{long}": ly.mean(v, long, 1),
            f"{c}_std_s{short}": zero_to(ly.std(v, short, 1), None), f"{c}_std_m{mid}": zero_to(ly.std(v, mid, 1), None),
            f"{c}_slope_s{short}": ly.diff(v, short) / F.lit(short + EPS),
            f"_pad_{c}": ly.ffill(v),
        }
    x = ly.add(x, layer)
    layer = {}
    for c in present:
        quick, slow, slowest = F.col(f"{c}_ma_s{short}"), F.col(f"{c}_ma_m{mid}"), F.col(f"{c}_ma_l{long}")
        sm, sl = ratio(quick, slow + F.lit(EPS)), ratio(quick, slowest + F.lit(EPS))
        layer |= {
            f"{c}_z_short": ratio(dbl(c) - quick, F.col(f"{c}_std_s{short}")),
            f"{c}_z_mid": ratio(dbl(c) - slow, F.col(f"{c}_std_m{mid}")),
            f"{c}_ratio_s_m": sm, f"{c}_ratio_s_l": sl,
            f"{c}_dev_s_m": F.abs(sm - 1.0), f"{c}_dev_s_l": F.abs(sl - 1.0),
            f"{c}_ema_cross": F.col(f"{c}_ema_s") - F.col(f"{c}_ema_m"),
        }
        for name, n in ((f"{c}_pct1", 1), (f"{c}_pct{short}", short), (f"{c}_pct{mid}", mid)):
            layer[name] = ly.pct_change(f"_pad_{c}", n)
    x = ly.add(x, layer)
    mask = F.col("_train")
    x = ly.add(x, {f"_w_{c}": winsor_over(ly, finite(f"{c}_pct{short}"), mask, *winsor) for c in present})
    layer = {}
    for c in present:
        fitted = lambda name: standard_over(ly, finite(name), mask)
        layer[f"{c}_event_score"] = F.greatest(fitted(f"{c}_z_short"), fitted(f"_w_{c}"))
        layer[f"{c}_regime_score"] = F.greatest(fitted(f"{c}_z_mid"), fitted(f"{c}_dev_s_m"))
    x = ly.add(x, layer)
    scaled = [
        f"{c}_{tail}" for c in present for tail in (
            "z_short", "z_mid", f"pct{short}", f"pct{mid}", "ema_cross", f"slope_s{short}", "ratio_s_m", "ratio_s_l",
            "event_score", "regime_score", "log1p", f"ma_s{short}", f"ma_m{mid}", f"ma_l{long}")
    ]
    x = ly.add(x, {f"_w_{n}": winsor_over(ly, finite(n), mask, *winsor) for n in scaled})
    x = ly.add(x, {f"{n}_zn": standard_over(ly, f"_w_{n}", mask) for n in scaled})
    keep = [c for c in x.columns if not c.startswith(("_w_", "_pad_")) and c != "_train"]
    return x.select(*keep), [f"{n}_zn" for n in scaled]


# ---- two-threshold flags ---------------------------------------------------

def fitted_flags(
    df: DataFrame, ly: Layout, columns: Sequence[str], train: Column | None = None, short: int = 6, mid: int = 24,
    event: tuple[float, float] = (0.85, 0.70), state: tuple[float, float] = (0.60, 0.45),
    event_default: tuple[float, float] = (1.5, 0.5), state_default: tuple[float, float] = (0.5, 0.2),
    thresholds: bool = False, digits: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Spike and state flags with enter/exit levels fitted on the training rows.

    ``digits`` rounds scores and levels before they are compared, so that small counts, which often tie with a level,
    do not fall to a side by the last bits of a sum.

    ``thresholds=True`` also returns the levels as ``<flag>_enter`` and ``<flag>_exit``.
    """
    ly = ly.layered()
    present = [c for c in columns if c in df.columns]
    layer: dict[str, Column] = {"_train": train_mask(ly) if train is None else F.coalesce(train, F.lit(False))}
    for c in present:
        v = dbl(c)
        for tag, n in (("s", short), ("m", mid)):
            layer[f"_mu_{tag}_{c}"] = ly.mean(v, n, 1)
            layer[f"_sd_{tag}_{c}"] = zero_to(ly.std(v, n, 1), None)
        layer[f"_pad_{c}"] = ly.ffill(v)
    x = ly.add(df, layer)
    layer = {}
    for c in present:
        v, mu_s, mu_m = dbl(c), F.col(f"_mu_s_{c}"), F.col(f"_mu_m_{c}")
        layer |= {
            f"{c}_z_mid": ratio(v - mu_m, F.col(f"_sd_m_{c}")), f"{c}_z_short": ratio(v - mu_s, F.col(f"_sd_s_{c}")),
            f"{c}_ratio_s_over_m": finite(ratio(mu_s, zero_to(mu_m, None))),
            f"{c}_pctchg_{short}": ly.pct_change(f"_pad_{c}", short),
        }
    x = ly.add(x, layer)
    mask = F.col("_train")

    def centred(name: str) -> Column:
        v = finite(name)
        t = on_train(v, mask)
        sd = ly.fold("std", F.stddev_samp, None, None, t)
        return ratio(v - ly.fold("avg", F.avg, None, None, t), F.when(sd == 0.0, 1.0).otherwise(sd))

    def tied(v: Column) -> Column:
        return v if digits is None else F.round(v, digits)

    layer = {}
    for c in present:
        layer[f"_e_{c}"] = tied(F.greatest(centred(f"{c}_z_short"), centred(f"{c}_pctchg_{short}")))
        layer[f"_s_{c}"] = tied(F.greatest(F.col(f"{c}_z_mid"), F.abs(F.col(f"{c}_ratio_s_over_m") - 1.0)))
    x = ly.add(x, layer)
    plan = [(f"{c}_spike_flag", f"_e_{c}", event, event_default) for c in present]
    plan += [(f"{c}_state_flag", f"_s_{c}", state, state_default) for c in present]
    layer = {}
    for name, source, levels, defaults in plan:
        for side, q, fallback in zip(("enter", "exit"), levels, defaults):
            layer[f"{name}_{side}"] = F.coalesce(tied(finite(quantile_over(ly, source, mask, q))), F.lit(fallback))
    x = ly.add(x, layer)
    # A reading equal to both levels flips the switch, so ties are counted besides the
    # readings that settle it.
    layer = {}
    for name, source, *_ in plan:
        v, on, off = F.col(source), F.col(f"{name}_enter"), F.col(f"{name}_exit")
        tie = (v == on) & (v == off)
        layer[f"_d_{name}"] = F.when(tie, None).when(v >= on, 1).when(v <= off, 0)
        layer[f"_n_{name}"] = ly.fold("sum", F.sum, Window.unboundedPreceding, 0, F.when(tie, 1).otherwise(0))
    x = ly.add(x, layer)
    latest = lambda c: F.coalesce(ly.ffill(c), F.lit(0))
    x = ly.add(x, {
        name: (
            (latest(F.col(f"_d_{name}")) + F.col(f"_n_{name}")
             - latest(F.when(F.col(f"_d_{name}").isNotNull(), F.col(f"_n_{name}")))) % 2
        ).cast("int") for name, *_ in plan
    })
    levels = [f"{name}_{side}" for name, *_ in plan for side in ("enter", "exit")]
    hidden = [c for c in x.columns if c.startswith("_") and c not in df.columns]
    flags = sorted((name for name, *_ in plan), key=lambda n: columns.index(n.rsplit("_", 2)[0]))
    return x.drop(*hidden, *([] if thresholds else levels)), flags
