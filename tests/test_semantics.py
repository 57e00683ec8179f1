"""Hand-made series: missing values, zero denominators, ties, short and interleaved series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright import Layout
from barwright.functions.over import frac_weights
from barwright.functions.scalar import clip, finite, flag, ratio, safe_div
from barwright.operators import align, bars, blocks, clean, cusum, fit, labels, metrics, profile
from barwright.operators.scan import Atr, Ema, Macd, Rsi, RunningQuantile, SeededEma, ema_in_blocks, scan
from barwright.plans import macro, report, training
from barwright.plans.price import price_features

LY = Layout.of("s", "t")


def frame(spark, series: dict, column: str = "x"):
    rows = [(s, i, None if v is None else float(v)) for s, vs in series.items() for i, v in enumerate(vs)]
    # interleave the series
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[1], r[0])), f"s string, t int, {column} double")


def values(df, column, series="a"):
    rows = df.filter(F.col("s") == series).orderBy("t").select(column).collect()
    return [r[0] for r in rows]


def same(got, want, tol=1e-9):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        w = None if w is None or (isinstance(w, float) and math.isnan(w)) else w
        if w is None or g is None:
            assert g is None and w is None, (got, want)
        else:
            assert g == pytest.approx(w, abs=tol) or g == w, (got, want)


def random_series(n, seed, gaps=0.2, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) if step is None else rng.integers(-step, step + 1, n).astype(float)
    return [None if rng.random() < gaps else float(v) for v in x]


def test_ratio_and_flags(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 2.0), (3.0, 2.0)], "n double, d double")
    got = df.select(ratio(F.col("n"), F.col("d")).alias("r"), safe_div(F.col("n"), F.col("d")).alias("s"),
                    finite(ratio(F.col("n"), F.col("d"))).alias("f"), flag(F.col("n") > 0).alias("g"),
                    clip(F.col("n"), -0.5, 2.0).alias("c")).collect()
    assert [r.r for r in got] == [math.inf, -math.inf, None, None, 1.5]
    assert [r.s for r in got] == [None, None, None, None, 1.5]
    assert [r.f for r in got] == [None, None, None, None, 1.5]
    assert [r.g for r in got] == [1, 0, 0, 0, 1]
    assert [r.c for r in got] == [1.0, -0.5, 0.0, None, 2.0]


@pytest.mark.parametrize("n,need", [(3, 3), (3, 1), (6, 2)])
def test_rolling_against_pandas(spark, n, need):
    data = {"a": random_series(40, 1), "b": [1.0] * 10, "c": [2.0]}
    df = frame(spark, data).withColumns({
        "mean": LY.mean("x", n, need), "std": LY.std("x", n, need), "sum": LY.sum("x", n, need),
        "med": LY.median("x", n, need)})
    for s, xs in data.items():
        roll = pd.Series(xs, dtype=float).rolling(n, min_periods=need)
        same(values(df, "mean", s), roll.mean().tolist())
        same(values(df, "std", s), roll.std().tolist(), 1e-7)
        same(values(df, "sum", s), roll.sum().tolist())
        same(values(df, "med", s), roll.median().tolist())


def test_centered_std_even_and_odd(spark):
    xs = random_series(30, 2, gaps=0)
    df = frame(spark, {"a": xs}).withColumns({"odd": LY.std_centered("x", 7), "even": LY.std_centered("x", 6)})
    for name, n in (("odd", 7), ("even", 6)):
        same(values(df, name), pd.Series(xs).rolling(n, center=True).std().tolist(), 1e-9)


def test_pct_change_pads_like_pandas(spark):
    df = frame(spark, {"a": [1, None, 3, 0, 5]}).withColumn("p", LY.ffill("x")).withColumn("r", LY.pct_change("p"))
    assert values(df, "r") == [None, 0.0, 2.0, -1.0, math.inf]


def test_layer_shares_windows(spark):
    ly = LY.layered()
    out = {"a1": ly.zscore("x", 3), "a2": ly.zscore("x", 3) * 2}
    shared = len(ly.pending.columns)
    df = ly.add(frame(spark, {"a": [1, 2, 4, 8]}), out)
    assert shared == 3 and set(df.columns) == {"s", "t", "x", "a1", "a2"}
    assert [v is None for v in values(df, "a1")] == [True, True, False, False]


@pytest.mark.parametrize("adjust", [True, False])
@pytest.mark.parametrize("xs", [[None, 1, None, 3], [5.0] * 6, random_series(60, 3)], ids=["gaps", "flat", "random"])
def test_ema_against_pandas(spark, adjust, xs):
    df = scan(frame(spark, {"a": xs}), LY, [Ema("x", "e", span=3, adjust=adjust)])
    same(values(df, "e"), pd.Series(xs, dtype=float).ewm(span=3, adjust=adjust).mean().tolist())


@pytest.mark.parametrize("block", [1, 7, 64])
def test_ema_blocks_equal_one_pass(spark, block):
    data = {"a": random_series(100, 4), "b": [None] * 20 + random_series(30, 5), "c": [None] * 3}
    df = frame(spark, data).withColumn("row_index", F.col("t").cast("long"))
    out = ema_in_blocks(df, ["s"], "x", "e", 9, block_rows=block)
    for s, xs in data.items():
        same(values(out, "e", s), pd.Series(xs, dtype=float).ewm(span=9, adjust=False).mean().tolist())


def test_indicator_seeds(spark):
    xs = [float(v) for v in np.cumsum(np.random.default_rng(6).normal(size=60)) + 50]
    rows = [("a", i, v + 1, v - 1, v) for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "s string, t int, h double, l double, c double")
    out = scan(df, LY, [Rsi("c"), Macd("c"), SeededEma("c", "e12", 12), Atr("h", "l", "c", "atr", 24)])
    first = lambda c: next(i for i, v in enumerate(values(out, c)) if v is not None)
    assert (first("RSI"), first("MACD"), first("MACD_signal"), first("e12"), first("atr")) == (14, 33, 33, 11, 24)
    d = np.diff(xs)
    up, down = np.maximum(d, 0)[:14].mean(), np.maximum(-d, 0)[:14].mean()
    assert values(out, "RSI")[14] == pytest.approx(100 * up / (up + down))
    assert values(out, "e12")[11] == pytest.approx(np.mean(xs[:12]))
    k = 2 / 13
    fast = np.mean(xs[14:26])
    slow = np.mean(xs[:26])
    for v in xs[26:34]:
        fast, slow = fast + k * (v - fast), slow + 2 / 27 * (v - slow)
    assert values(out, "MACD")[33] == pytest.approx(fast - slow)
    flat = scan(frame(spark, {"a": [3.0] * 20}), LY, [Rsi("x", "r")])
    assert values(flat, "r")[14:] == [0.0] * 6


def test_running_quantile(spark):
    xs = random_series(80, 7)
    out = scan(frame(spark, {"a": xs}), LY, [RunningQuantile("x", "q", 0.2, 10), RunningQuantile("x", "m", 0.5, 3, 12)])
    same(values(out, "q"), pd.Series(xs, dtype=float).expanding(10).quantile(0.2).tolist())
    same(values(out, "m"), pd.Series(xs, dtype=float).rolling(12, min_periods=3).median().tolist())


def loop_latch(xs, enter, leave):
    on, out = False, []
    for v in xs:
        if v is not None:
            if not on and v >= enter:
                on = True
            elif on and v <= leave:
                on = False
        out.append(int(on))
    return out


@pytest.mark.parametrize("enter,leave", [(1.0, -1.0), (0.0, 0.0), (-1.0, 1.0)])
def test_latch_all_level_orders(spark, enter, leave):
    xs = random_series(120, 8, step=3)
    out = cusum.latch(frame(spark, {"a": xs}), LY, "x", "on", enter, leave)
    assert values(out, "on") == loop_latch(xs, enter, leave)


def loop_cusum(dev, limit):
    pos = neg = 0.0
    up, down = [], []
    for d in dev:
        pos, neg = max(0.0, pos + d), min(0.0, neg + d)
        up.append(int(pos > limit))
        down.append(int(pos <= limit and neg < -limit))
        pos = 0.0 if up[-1] else pos
        neg = 0.0 if down[-1] else neg
    return up, down


@pytest.mark.parametrize("seed,limit,block", [(1, 1.5, 8), (2, 4.0, 16), (3, 0.0, 5), (4, 9.0, 3), (5, 2.0, 1)])
def test_cusum_blocks_equal_loop(spark, seed, limit, block):
    xs = random_series(150, seed, gaps=0, step=2)  # whole numbers: sums are exact
    df = frame(spark, {"a": xs, "b": xs[::-1]}).withColumn("row_index", F.col("t").cast("long"))
    out = cusum.cusum_in_blocks(df, ["s"], "x", limit, "u", "d", block_rows=block).cache()
    for s, data in (("a", xs), ("b", xs[::-1])):
        up, down = loop_cusum(data, limit)
        assert values(out, "u", s) == up and values(out, "d", s) == down
    out.unpersist()


def test_run_sum_flags_need_no_state(spark):
    xs = random_series(260, 9, gaps=0.05)
    up, down = cusum.drift_flags(LY, "x", LY.mean("x", 20, 5), LY.std("x", 20, 5) * 0.5)
    out = frame(spark, {"a": xs}).withColumns({"u": up, "d": down})
    s = pd.Series(xs, dtype=float)
    mu, th = s.rolling(20, min_periods=5).mean(), s.rolling(20, min_periods=5).std() * 0.5
    pos = neg = 0.0
    want = []
    for v, m, t in zip(s, mu, th):
        if np.isnan([v, m, t]).any():
            pos = neg = 0.0
            want.append((0, 0))
            continue
        pos = pos + v - m if v - m > t else 0.0
        neg = neg + m - v if m - v > t else 0.0
        want.append((int(pos > t), int(neg > t)))
    assert list(zip(values(out, "u"), values(out, "d"))) == want


@pytest.mark.parametrize("block", [16, 50])
def test_blocks_equal_whole_series(spark, block):
    data = {"a": random_series(200, 10), "b": random_series(30, 11)}
    df = frame(spark, data).withColumn("row_index", F.col("t").cast("long"))
    build = lambda d, ly: d.withColumns({"m": ly.mean("x", 12, 3), "l": ly.lag("x", 5), "c": ly.corr("x", "t", 10, 4)})
    a = build(df, LY).orderBy("s", "t").drop("row_index").toPandas()
    b = blocks.in_blocks(df, ["s"], "row_index", build, 12, block_rows=block).orderBy("s", "t").drop("row_index").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns.tolist()])
    assert blocks.windows_in_blocks(df.drop("row_index"), ["s"], "t", build, 12, 0, F.floor(F.col("t") / 10), block).count() == 230


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(12)
    close = np.cumsum(rng.normal(size=120)) + 100
    rows = [("a", i, float(c) + 1.0, float(c) - 1.0, float(c), float(v)) for i, (c, v) in enumerate(zip(close, rng.integers(1, 50, 120)))]
    df = spark.createDataFrame(rows, "s string, t int, high double, low double, close double, volume_ETH double")
    full = price_features(df, LY, drop="none").filter("t < 90").orderBy("t").toPandas()
    past = price_features(df.filter("t < 90"), LY, drop="none").orderBy("t").toPandas()
    pd.testing.assert_frame_equal(full, past)


def test_sparse_columns_follow_the_null_share(spark):
    df = spark.createDataFrame([(i, None if i < 5 else 1, None if i < 6 else 1) for i in range(10)], "a int, half int, most int")
    assert clean.drop_sparse_columns(df).columns == ["a", "half"]
    assert clean.drop_null_rows(df.drop("most")).count() == 5


def test_keep_first_and_union_order(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, a int")
    b = spark.createDataFrame([(2, 21), (3, 31)], "k int, b int")
    got = align.union_keep_first([a, b], ["k"]).orderBy("k").collect()
    assert [(r.k, r.a, r.b) for r in got] == [(1, 10, None), (2, 20, None), (3, None, 31)]


@pytest.mark.parametrize("bucketed", [False, True])
def test_asof_keeps_null_of_the_match(spark, bucketed):
    stamp = lambda df: df.withColumn("ts", F.timestamp_seconds(F.col("sec"))).drop("sec")
    left = stamp(spark.createDataFrame([("a", 5), ("a", 10), ("a", 7200), ("b", 3)], "s string, sec int"))
    right = stamp(spark.createDataFrame([("a", 4, 1.0, 0), ("a", 10, 2.0, 0), ("a", 10, None, 1)], "s string, sec int, v double, o int"))
    fn = align.asof_join_in_buckets if bucketed else align.asof_join
    got = fn(left, right, ["s"], "ts", ["v"], tie=["o"]).withColumn("sec", F.unix_seconds("ts")).orderBy("s", "sec").collect()
    assert [(r.s, r.sec, r.v) for r in got] == [("a", 5, 1.0), ("a", 10, None), ("a", 7200, None), ("b", 3, None)]


def test_profile_corner_cases(spark):
    rows = [("a", 0.0, 1.0, 100.0), ("a", 9.0, 10.0, 5.0), ("b", 0.0, 1.0, 4.0), ("b", 9.0, 10.0, 4.0), ("b", 4.5, 5.4, 1.0)]
    df = spark.createDataFrame(rows, "s string, low double, high double, volume_USD double")
    bins = profile.volume_bins(df, ["s"], num_bins=10)
    assert bins.count() == 20
    stats = {r.s: r for r in profile.bin_statistics(bins, ["s"]).collect()}
    assert stats["a"].poc_price == 0.5 and stats["a"].vah_price is None  # the top bin alone passes 70 %
    assert stats["b"].poc_price == 0.5 and stats["b"].vah_price == 9.5  # ties: low bin first, high bin in the area


def test_bars_take_ties_by_trade_id(spark):
    rows = [("a", 2, 5.0, 1.0, 100, True), ("a", 1, 4.0, 2.0, 100, False), ("a", 3, 6.0, 1.0, 99, False)]
    df = spark.createDataFrame(rows, "s string, trade_id long, price double, qty double, sec long, is_buyer_maker boolean")
    r = bars.ticks_to_bars(df.withColumn("timestamp", F.timestamp_seconds("sec")), ["s"]).first()
    assert (r.price_first, r.price_last, r.buy_qty_sum, r.sell_qty_mean, r.qty_count) == (6.0, 5.0, 3.0, 1 / 3, 3)


def test_fits_use_training_rows_only(spark):
    df = frame(spark, {"a": list(range(7)) + [1000, 1000, 1000]}).withColumn("m", fit.train_mask(LY))
    assert values(df, "m") == [True] * 7 + [False] * 3
    z = values(df.withColumn("z", fit.standard_over(LY, "x", F.col("m"))), "z")
    assert sum(z[:7]) == pytest.approx(0) and z[-1] > 100
    flat = frame(spark, {"a": [4.0] * 5}).withColumn("z", fit.scaler_over(LY, "x", F.lit(True)))
    assert values(flat, "z") == [0.0] * 5


def test_concurrency_uniqueness_weights(spark):
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    b = spark.createDataFrame([("a", i, float(i + 1)) for i in range(6)], "s string, h long, close double").withColumn("ts", at("h")).drop("h")
    e = spark.createDataFrame([("a", 0, 0, 2), ("a", 1, 1, 3), ("a", 2, 5, None)], "s string, event_id int, x long, y long").select(
        "s", "event_id", at("x").alias("t_start"), at("y").alias("t_end"))
    c = labels.concurrency(b, e, ["s"]).orderBy("ts").collect()
    assert [r.n_open for r in c] == [1, 2, 2, 1, 0, 1]
    u = {r.event_id: r.avg_uniqueness for r in labels.average_uniqueness(b, e, ["s"]).collect()}
    assert u[0] == pytest.approx((1 + .5 + .5) / 3) and u[1] == pytest.approx((.5 + .5 + 1) / 3) and u[2] == pytest.approx(1)
    w = labels.sample_weights(b, e, ["s"]).agg(F.sum("weight")).first()[0]
    assert w == pytest.approx(3)


def test_bootstrap_is_seeded_and_prefers_unique_events(spark):
    at = lambda c: F.timestamp_seconds(F.col(c) * 3600)
    b = spark.createDataFrame([("a", i) for i in range(40)], "s string, h long").withColumn("ts", at("h")).drop("h")
    spans = [(0, 0, 9), (1, 0, 9), (2, 1, 8), (3, 20, 22), (4, 30, 32)]
    e = spark.createDataFrame([("a", *x) for x in spans], "s string, event_id int, x long, y long").select(
        "s", "event_id", at("x").alias("t_start"), at("y").alias("t_end"))
    draw = lambda seed: labels.sequential_bootstrap(b, e, ["s"], 200, seed=seed).orderBy("replica", "draw").toPandas()
    x, again = draw(1), draw(1)
    pd.testing.assert_frame_equal(x, again)
    assert len(x) == 1000 and not draw(2).equals(x)
    assert (x["event_id"] >= 3).mean() > 0.42  # plain sampling would give 0.4


def test_folds_cover_and_expand(spark):
    df = spark.range(23).select(F.col("id").alias("r"), F.lit(23).alias("n"))
    out = labels.walk_forward_folds(df, "r", "n", 5).toPandas()
    tests = out[out.role == "test"].groupby("fold").r.agg(["min", "max"]).values.tolist()
    assert tests == [[8, 10], [11, 13], [14, 16], [17, 19], [20, 22]]
    assert out[(out.role == "train") & (out.fold == 0)].r.max() == 7


def test_autocorrelation_skips_missing_values(spark):
    xs = random_series(40, 13)
    out = labels.window_statistics(frame(spark, {"a": xs}), LY, ["x"], 10, gaps=True)
    s = pd.Series(xs, dtype=float)
    want = [s[i - 9 : i + 1].dropna().autocorr(1) for i in range(9, 40)]
    same(values(out, "x_autocorr1"), want, 1e-9)


def test_auc_with_ties_and_threshold_choice(spark):
    rng = np.random.default_rng(14)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 1)
    df = spark.createDataFrame([("m", int(a), float(b)) for a, b in zip(y, p)], "k string, y int, p double")
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for a in p[y == 1] for b in p[y == 0]]
    assert metrics.auc(df, ["k"], "y", "p", slices=3).first().auc == pytest.approx(np.mean(pairs))
    sweep = metrics.threshold_sweep(df, ["k"], "y", "p", [0.25, 0.5])
    f1 = {r.threshold: r.f1 for r in sweep.collect()}
    hit = lambda t: 2 * ((p > t) & (y == 1)).sum() / ((p > t).sum() + (y == 1).sum())
    assert f1[0.25] == pytest.approx(hit(0.25)) and f1[0.5] == pytest.approx(hit(0.5))
    assert metrics.best_threshold(sweep, ["k"]).first().threshold == max(f1, key=f1.get)


def test_report_needs_both_kinds_of_folds(spark):
    both = spark.createDataFrame([(1, 0.5, 0.6), (2, 0.7, 0.6), (3, 0.5, None)], "cv_fold int, auc_lgbm double, my_tft_auc double")
    got = {r.win: r.mean_delta for r in report.win_fold_contribution(both).collect()}
    assert got[True] == pytest.approx(0.1) and got[False] == pytest.approx(-0.1)
    assert report.win_fold_contribution(both.filter("cv_fold = 1")).count() == 0
    with pytest.raises(ValueError):
        report.fold_comparison(both.drop("cv_fold"))


def test_missing_driver_columns_are_reported(spark):
    with pytest.raises(ValueError, match="VIX_close"):
        macro.macro_features(frame(spark, {"a": [1.0]}), LY, macro.VIX)


def test_fractional_weights():
    assert [round(w, 3) for w in frac_weights(0.4, 0.01)[:4]] == [1.0, -0.4, -0.12, -0.064]


def test_equal_targets_have_a_divergence(spark):
    df = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 3.0, 2.0)], "g string, y double, p double")
    got = {r.g: r.kl for r in metrics.kl_histograms(df, ["g"], "y", "p", 4).collect()}
    assert got["a"] == 0.0 and got["b"] == float("inf")


def test_auc_with_one_far_score(spark):
    df = spark.range(1000).select(F.lit(0).alias("g"), (F.col("id") % 2).alias("y"),
                                  F.when(F.col("id") == 999, 1e9).otherwise(F.col("id") / 1000.0).alias("s"))
    got = metrics.auc(df, ["g"], "y", "s", slices=16).first()["auc"]
    assert abs(got - (500 * 501 / 2) / (500 * 500)) < 1e-12


@pytest.mark.parametrize("block", [16, 33, 500])
def test_blocks_see_both_sides(spark, block):
    df = spark.range(200).select(F.lit("s").alias("s"), F.col("id").alias("row"), F.col("id").cast("double").alias("x"))

    def build(d, ly):
        return d.withColumns({"ahead": ly.lead("x", 4), "mid": ly.fold("avg", F.avg, -3, 3, F.col("x")), "back": ly.lag("x", 9)})

    want = build(df, Layout.of("s", "row")).orderBy("row").toPandas()
    got = blocks.in_blocks(df, ["s"], "row", build, 9, 4, block).orderBy("row").toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_blocks_refuse_frames_beyond_the_halo(spark):
    df = spark.range(5).select(F.lit("s").alias("s"), F.col("id").alias("row"), F.col("id").cast("double").alias("x"))
    for bad in (lambda ly: ly.lead("x", 2), lambda ly: ly.lag("x", 4), lambda ly: ly.mean("x", 9), lambda ly: ly.ffill("x"),
                lambda ly: ly.fold("avg", F.avg, None, None, F.col("x"))):
        with pytest.raises(ValueError):
            blocks.in_blocks(df, ["s"], "row", lambda d, ly: d.withColumn("y", bad(ly)), 3, 1)


def test_boosting_waits_for_a_lower_error():
    assert training.best_round([5, 4, 4.5, 4.4, 3, 3.1], 3) == (5, False)
    assert training.best_round([5, 4, 4.5, 4.4, 4.2, 3], 3) == (2, True)  # what comes after the wait does not count


def test_slow_rates_are_trained(spark):
    df = spark.createDataFrame([(i, 400, float(i % 20), float((i % 20) ** 2), 1.0) for i in range(400)], "row long, n long, x double, y double, w double")
    slow = [training.Trial(2, rounds, 0.003, 1.0, 1, 1.0, 0.5, 1.0) for rounds in (1, 120)]  # gains under 1 percent a round
    got = {r.rounds: r.mean_msle for r in training.tune_regressor(df, ["x"], "y", "w", "row", "n", slow, folds=1).collect()}
    assert got[120] < 0.9 * got[1]


def test_searches_have_the_default_rounds_and_all_features(spark, monkeypatch):
    from barwright.registry import q_outcomes

    seen = []
    for name in ("tune_classifier", "tune_regressor"):
        monkeypatch.setattr(training, name, lambda df, features, *a, **_: seen.append((df.count(), features, a[-1])))
    monkeypatch.setattr(q_outcomes, "searched", lambda *_: None)
    q_outcomes.t1(spark, "/root/testdata/sf0.001")
    q_outcomes.t2(spark, "/root/testdata/sf0.001")
    for n, features, trials in seen:
        assert n and len(features) > 100 and {t.rounds for t in trials} == {1000}


def test_flags_of_all_activity_columns_are_compared():
    from barwright.registry import all_queries, all_sql
    from barwright.registry.q_bundles import FIT_COLS

    for name in ("b7_fitted_flags_all_columns", "f17_event_state_flags_all_columns"):
        assert name in all_queries() and len(FIT_COLS) == 7
        assert all(f"{c}_{kind}_flag" in all_sql()[name] for c in FIT_COLS for kind in ("spike", "state"))
