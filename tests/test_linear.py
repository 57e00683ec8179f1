"""Prefix scans over blocks equal the one-pass forms for every block size, with gaps and short series."""

import numpy as np
import pandas as pd
import pytest

from barwright.functions.over import Layout
from barwright.operators import linear
from barwright.operators.scan import Atr, Ema, Macd, Rsi, SeededEma, scan

LY = Layout.of("s", "row")


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    parts = []
    for name, n, gaps in (("whole", 140, 0.0), ("gaps", 140, 0.3), ("short", 9, 0.0), ("late", 90, 0.0), ("none", 20, 1.0), ("broken", 120, 0.0)):
        x = 50 + np.cumsum(rng.normal(size=n))
        x[rng.random(n) < gaps] = np.nan
        if name == "late":
            x[:17] = np.nan
        if name == "broken":
            x[70] = np.nan
        parts.append(pd.DataFrame({"s": name, "row": np.arange(n), "x": x, "high": x + rng.random(n), "low": x - rng.random(n), "note": [{"k": 1}] * n}))
    all_ = pd.concat(parts, ignore_index=True)
    lines = [(r.s, int(r.row), *[None if np.isnan(v) else float(v) for v in (r.x, r.high, r.low)], r.note) for r in all_.itertuples()]
    return spark.createDataFrame(lines, "s string, row long, x double, high double, low double, note map<string,int>").persist()


def compare(got, want, names):
    a, b = (x.select("s", "row", *names).orderBy("s", "row").toPandas() for x in (got, want))
    for n in ["s", "row"]:
        assert a[n].tolist() == b[n].tolist()
    for n in names:
        np.testing.assert_allclose(a[n].to_numpy(float), b[n].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=n)


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_means(rows, monkeypatch, block):
    monkeypatch.setattr(linear, "FAN", 4)
    args = {"series": ["s"], "row": "row", "block_rows": block}
    plain, narrow = rows, rows.drop("note")
    compare(linear.ema_in_blocks(plain, column="x", out="e", span=9, **args), scan(narrow, LY, [Ema("x", "e", span=9)]), ["e"])
    compare(linear.ema_in_blocks(plain, column="x", out="e", span=9, adjust=True, **args), scan(narrow, LY, [Ema("x", "e", span=9, adjust=True)]), ["e"])
    compare(linear.seeded_ema_in_blocks(plain, column="x", periods={"e": 12, "f": 5}, **args), scan(narrow, LY, [SeededEma("x", "e", 12), SeededEma("x", "f", 5)]), ["e", "f"])


@pytest.mark.parametrize("block", [3, 16, 1000])
def test_indicators(rows, monkeypatch, block):
    monkeypatch.setattr(linear, "FAN", 4)
    args = {"series": ["s"], "row": "row", "block_rows": block}
    narrow = rows.drop("note")
    compare(linear.rsi_in_blocks(rows, column="x", **args), scan(narrow, LY, [Rsi("x")]), ["RSI"])
    compare(linear.macd_in_blocks(rows, column="x", **args), scan(narrow, LY, [Macd("x")]), ["MACD", "MACD_signal", "MACD_hist"])
    compare(linear.atr_in_blocks(rows, high="high", low="low", close="x", out="a", period=14, **args), scan(narrow, LY, [Atr("high", "low", "x", "a", 14)]), ["a"])


def test_a_plan_without_python(rows):
    plan = linear.macd_in_blocks(rows, ["s"], "x", row="row")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan
