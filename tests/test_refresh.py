"""Tables that take in new and rewritten files, and the default drop path of the bundles."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barwright.functions.over import Layout
from barwright.operators.bars import merge_bars, partial_bars, ticks_to_bars
from barwright.plans.price import price_features
from barwright.sources.bar_store import read_store, refresh_bars
from barwright.streaming.ingest import ingest_changed_files, read_current

TICKS = "s string, trade_id long, price double, qty double, is_buyer_maker boolean, timestamp timestamp"


def ticks(spark, day, n, seed, s="a"):
    rng = np.random.default_rng(seed)
    start = pd.Timestamp(f"2024-01-{day:02d}")
    rows = [(s, int(i), float(p), float(q), bool(b), (start + pd.Timedelta(minutes=int(m))).to_pydatetime())
            for i, (p, q, b, m) in enumerate(zip(rng.integers(1, 99, n), rng.integers(1, 9, n), rng.random(n) < 0.5, rng.integers(0, 1440, n)))]
    return spark.createDataFrame(rows, TICKS)


def table(df, order):
    return df.orderBy(*order).toPandas()


def test_partial_bars_merge(spark):
    t = ticks(spark, 1, 300, 1).unionByName(ticks(spark, 2, 200, 2)).withColumn("qty", F.when(F.col("trade_id") % 9 > 0, F.col("qty")))
    merged = merge_bars(partial_bars(t.withColumn("part", F.col("trade_id") % 5), ["part", "s"]), ["s"])
    pd.testing.assert_frame_equal(table(merged, ["s", "date"]), table(ticks_to_bars(t, ["s"]), ["s", "date"])[merged.columns])


def test_bar_store(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    read = lambda paths: spark.read.schema(TICKS).parquet(*paths)
    put = lambda name, df: df.coalesce(1).write.mode("overwrite").parquet(f"{source}/{name}")
    first, second = ticks(spark, 1, 100, 1).unionByName(ticks(spark, 2, 50, 2)), ticks(spark, 3, 80, 3, "b")
    put("x", first)
    put("y", second)
    assert refresh_bars(spark, source, folder, read, ["s"]) == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert refresh_bars(spark, source, folder, read, ["s"]) == []
    stamps = {d: os.stat(f"{folder}/bars/_day={d}").st_mtime_ns for d in ("2024-01-01", "2024-01-03")}
    late = ticks(spark, 2, 60, 4)
    put("z", late)
    assert refresh_bars(spark, source, folder, read, ["s"]) == ["2024-01-02"]
    assert stamps == {d: os.stat(f"{folder}/bars/_day={d}").st_mtime_ns for d in stamps}
    want = ticks_to_bars(first.unionByName(second).unionByName(late), ["s"])
    pd.testing.assert_frame_equal(table(read_store(spark, folder), ["s", "date"])[want.columns], table(want, ["s", "date"]))


def test_a_rewritten_file_may_leave_a_day(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "store")
    os.makedirs(source)
    read = lambda paths: spark.read.schema(TICKS).json(paths)

    def put(name, df):
        with open(f"{source}/{name}.json", "w") as f:
            f.write("\n".join(df.toJSON().collect()))

    put("x", ticks(spark, 1, 40, 1).unionByName(ticks(spark, 2, 40, 2)))
    put("y", ticks(spark, 4, 40, 3))
    refresh_bars(spark, source, folder, read, ["s"])
    put("x", ticks(spark, 1, 41, 5))
    assert refresh_bars(spark, source, folder, read, ["s"]) == ["2024-01-01", "2024-01-02"]
    want = ticks_to_bars(ticks(spark, 1, 41, 5).unionByName(ticks(spark, 4, 40, 3)), ["s"])
    pd.testing.assert_frame_equal(table(read_store(spark, folder), ["s", "date"])[want.columns], table(want, ["s", "date"]))
    assert refresh_bars(spark, source, folder, read, ["s"]) == []


def test_many_source_files_few_folders(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    spark.range(1000).repartition(1000, "id").write.option("maxRecordsPerFile", 1).parquet(source)
    files = sum(n.endswith(".parquet") for n in os.listdir(source))
    assert files == 1000
    assert ingest_changed_files(spark, source, target, spark.range(1).schema) == 1000
    assert ingest_changed_files(spark, source, target, spark.range(1).schema) == 0
    assert sorted(r.id for r in read_current(spark, target).collect()) == list(range(1000))
    assert not [n for n in os.listdir(target) if os.path.isdir(f"{target}/{n}")]
    assert sum(n.endswith(".parquet") for n in os.listdir(target)) < 100


def test_rows_of_a_run_that_died_are_not_read(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    spark.range(10).coalesce(1).write.parquet(source)
    ingest_changed_files(spark, source, target, spark.range(1).schema)
    spark.read.parquet(target).withColumn("_run", F.lit("died")).write.mode("append").parquet(target)
    assert read_current(spark, target).count() == 10


@pytest.mark.parametrize("drop", ["all", "rows"])
def test_default_drop_of_the_price_bundle(spark, drop):
    rng = np.random.default_rng(1)
    n = 800
    close = 100 + np.cumsum(rng.normal(size=n))
    t = pd.DataFrame({"s": 1, "date": pd.date_range("2024-01-01", periods=n, freq="h"), "high": close + 1, "low": close - 1, "close": close,
                      "volume_ETH": rng.random(n) + 1, "volume_USD": rng.random(n) + 1})
    df = spark.createDataFrame(t).withColumn("seldom", F.when(F.hour("date") == 5, F.col("close")))
    ly = Layout.of("s", "date")
    got = table(price_features(df, ly) if drop == "all" else price_features(df, ly, drop="rows"), ["date"])
    whole = table(price_features(df, ly, drop="none"), ["date"])
    if drop == "all":
        whole = whole[[c for c in whole.columns if c in ("s", "date") or whole[c].isna().mean() <= 0.5]]
        assert "seldom" not in got.columns
    want = whole.dropna()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert got["date"].tolist() == want["date"].tolist()
    assert len(got) > 300 if drop == "all" else len(got) < 50
