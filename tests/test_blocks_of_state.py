"""Change sums, samplers and running quantiles: kernels against loops, block forms against one-pass forms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.over import Layout
from barwright.operators import cusum, jumps
from barwright.operators.expanding import Held, expanding_quantile_in_blocks
from barwright.operators.quantiles import exact_quantiles
from barwright.operators.scan import RunningQuantile, scan

LY = Layout.of("s", "row")


def one_side(steps, limit, total):
    fires = []
    for d, bar in zip(steps, limit):
        total = max(0.0, total + d) if d == d else 0.0
        fires.append(total > bar)
        total = 0.0 if fires[-1] else total
    return fires, total


def two_sides(steps, limit):
    up = down = 0.0
    fires = []
    for d, bar in zip(steps, limit):
        up, down = (max(0.0, up + d), min(0.0, down + d)) if d == d else (0.0, 0.0)
        fires.append(up > bar or down < -bar)
        if fires[-1]:
            up = down = 0.0
    return fires, up, down


@pytest.mark.parametrize("seed", range(4))
def test_kernels(seed):
    rng = np.random.default_rng(seed)
    for k in range(300):
        n = int(rng.integers(0, 300))
        steps = rng.integers(-4, 5, n) * 0.25
        if k % 2:
            steps[rng.random(n) < 0.1] = np.nan
        limit, moving = np.full(n, float(rng.choice([0.0, 0.5, 2.0, 5.0]))), rng.choice([0.25, 0.5, 1.0, 3.0], n)
        got, want = jumps.upward(steps, limit, 0.25), one_side(steps, limit, 0.25)
        assert got[0].tolist() == want[0] and got[1] == want[1]
        got, want = jumps.either(steps, moving, 0.0, 0.0), two_sides(steps, moving)
        assert got[0].tolist() == want[0] and got[1:] == want[1:]
        if not np.isnan(steps).any():
            bar = float(rng.choice([0.0, 0.5, 2.0, 5.0]))
            effect = {p: np.array(v) for p, v in jumps.block_effect(steps, bar).items()}
            for total in np.arange(0, bar + 0.1, 0.25):
                assert jumps.after_block(effect, float(total), bar) == pytest.approx(one_side(steps, np.full(n, bar), total)[1], abs=1e-12)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    parts = [pd.DataFrame({"s": s, "row": np.arange(n), "x": np.round(np.cumsum(rng.normal(size=n)) * 4) / 4}) for s, n in (("a", 400), ("b", 37), ("c", 3))]
    parts.append(pd.DataFrame({"s": "flat", "row": np.arange(50), "x": 2.0}))
    return spark.createDataFrame(pd.concat(parts, ignore_index=True)).persist()


@pytest.mark.parametrize("block", [5, 64, 1000])
def test_event_sampler_in_blocks(rows, block):
    want = {(r.s, r.row) for r in cusum.cusum_events(rows, LY, "x", 0.6).collect()}
    got = {(r.s, r.row) for r in cusum.cusum_events_in_blocks(rows, ["s"], "x", 0.6, "row", block).collect()}
    assert got == want and want


@pytest.mark.parametrize("mode, enter, leave", [("high", 1.0, 3.0), ("low", 2.0, -1.0)])
def test_crossed_latch(rows, mode, enter, leave):
    got = cusum.latch(rows.withColumn("x", F.when(F.col("row") % 6 > 0, F.col("x"))), LY, "x", "on", enter, leave, mode).orderBy("s", "row").toPandas()
    sign = 1 if mode == "high" else -1
    for _, part in got.groupby("s"):
        state = 0
        for x, on in zip(part.x.astype(float), part.on):
            if x == x:
                if not state and sign * x >= sign * enter:
                    state = 1
                elif state and sign * x <= sign * leave:
                    state = 0
            assert on == state


@pytest.mark.parametrize("block, buckets", [(7, 4), (64, 256), (1000, 16)])
@pytest.mark.parametrize("q, need", [(0.5, 1), (0.2, 10), (1.0, 3)])
def test_running_quantile_in_blocks(rows, block, buckets, q, need):
    x = rows.withColumn("x", F.when(F.col("row") % 5 != 2, F.col("x")))
    got = expanding_quantile_in_blocks(x, ["s"], "x", "m", q, need, "row", block, buckets).orderBy("s", "row").toPandas()
    want = scan(x, LY, [RunningQuantile("x", "m", q, need)]).orderBy("s", "row").toPandas()
    np.testing.assert_allclose(got.m.to_numpy(float), want.m.to_numpy(float), rtol=1e-12, equal_nan=True)


def test_rank_among_both_lists():
    rng = np.random.default_rng(1)
    for _ in range(200):
        old, own = np.sort(rng.integers(0, 9, rng.integers(0, 12))).astype(float), np.sort(rng.integers(0, 9, rng.integers(0, 12))).astype(float)
        held = Held(*np.unique(old, return_counts=True))
        held.own = own.tolist()
        assert [held.at(k) for k in range(len(old) + len(own))] == np.sort(np.concatenate([old, own])).tolist()


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(3)
    t = pd.DataFrame({"s": rng.choice(["a", "b", "c"], 3000, p=[0.7, 0.299, 0.001]), "x": np.round(rng.normal(size=3000), 2), "y": rng.choice([0.0, 0.0, 1.0, 5.0], 3000)})
    df = spark.createDataFrame(t).withColumn("x", F.when(F.col("y") < 5, F.col("x"))).withColumn("none", F.lit(None).cast("double"))
    shares = {"lo": 0.005, "mid": 0.5, "hi": 0.995, "top": 1.0, "end": 0.0}
    got = exact_quantiles(df, ["s"], {c: F.col(c) for c in ("x", "y", "none")}, shares, {"n": F.count("_x")}, accuracy).collect()
    plain = df.toPandas()
    assert len(got) == 3 * plain.s.nunique()
    for r in got:
        v = plain.loc[plain.s == r.s, r.column].astype(float).dropna()
        assert r.n == len(v)
        for name, q in shares.items():
            assert (r[name] is None) == (len(v) == 0) and (not len(v) or r[name] == pytest.approx(v.quantile(q), rel=1e-12))
