"""Boosting that continues from stored margins, against one that stores nothing and against a plain fit."""

import pickle

import numpy as np
import pandas as pd
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from barwright.functions.losses import focal_gradient, focal_hessian, focal_loss
from barwright.operators import boost
from barwright.operators.boost import Boosting, Objective, Spec
from barwright.plans import training


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 4))
    x[:, 3] = np.round(x[:, 3])
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 3] + 0.3 * rng.normal(size=900) > 0).astype(float)
    t = pd.DataFrame({"row": np.arange(900), "n": 900, "y": y, "z": 3 + x[:, 0] ** 2 + x[:, 3], "w": 1 + rng.random(900), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "d": x[:, 3]})
    return spark.createDataFrame(t).withColumn("c", F.when(F.col("row") % 7 > 0, F.col("c"))).persist()


SPECS = [Spec(Objective("focal", pos_weight=2.0), 500, 600, 900, depth=4, leaves=9, subsample=0.8, min_rows=5, feature_share=0.75, l1=0.01, l2=0.5, seed=3),
         Spec(Objective("squared"), 400, 600, 900, depth=3, step=0.3, min_rows=10)]
FEATURES = ["a", "b", "c", "d"]


def margins(grown):
    got = grown.scored({0: len(grown.trees[0]), 1: len(grown.trees[1])}, lambda i, m, y, w: np.array([m.sum(), (m * m).sum(), len(m)]))
    return {i: v.tolist() for i, v in got.items()}


def test_continuing_equals_fitting_at_once(rows, monkeypatch):
    monkeypatch.setattr(boost, "BLOCK_ROWS", 200)
    runs = []
    for keep in (1, 3, 100):
        grown = Boosting(rows, FEATURES, "y", "w", "row", SPECS, keep=keep)
        for n in (2, 5, 9):  # in three goes
            grown.fit_to({0: n, 1: n}, 100)
        runs.append((grown, margins(grown)))
    at_once = Boosting(rows, FEATURES, "y", "w", "row", SPECS, keep=100)
    at_once.fit_to({0: 9, 1: 9}, 100)
    for grown, sums in runs:
        assert [len(t) for t in grown.trees] == [9, 9] and [len(x) for x in grown.losses] == [10, 10]
        np.testing.assert_allclose(grown.losses, at_once.losses, rtol=1e-9)
        for i, v in margins(at_once).items():
            np.testing.assert_allclose(sums[i], v, rtol=1e-9)
    assert all(x[-1] < x[0] for x in at_once.losses)


def test_first_split_is_the_best_one(rows):
    """The root of a squared tree, by trying all cuts."""
    spec = Spec(Objective("squared"), 900, 900, 900, depth=1, step=1.0, min_rows=10)
    grown = Boosting(rows, FEATURES, "z", "w", "row", [spec])
    edges = boost.code_edges(rows, FEATURES)
    grown.round([0])
    t = rows.toPandas().fillna({"c": 0.0})
    base = (t.w * t.z).sum() / t.w.sum()
    best = (-1.0,)
    for f, name in enumerate(FEATURES):
        code = np.searchsorted(edges[f], t[name], side="left")
        for cut in range(boost.BINS - 1):
            low = code <= cut
            if min(low.sum(), (~low).sum()) >= 10:
                gain = sum(((t.w * (base - t.z))[s].sum()) ** 2 / t.w[s].sum() for s in (low, ~low))
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, f, cut, [base + ((t.w * (t.z - base))[s].sum()) / t.w[s].sum() - base for s in (low, ~low)])
    tree = grown.trees[0][0]
    assert tree.feature[0] == best[1] and tree.cut[0] == best[2]
    np.testing.assert_allclose(tree.value[1:], best[3], rtol=1e-6)


def test_sums_in_portions_and_blocks(rows, monkeypatch):
    whole = Boosting(rows, FEATURES, "y", "w", "row", SPECS)
    whole.fit_to({0: 3, 1: 3}, 100)
    monkeypatch.setattr(boost, "SUM_BYTES", 1)  # every node a pass of its own
    monkeypatch.setattr(boost, "BLOCK_ROWS", 100)
    parts = Boosting(rows, FEATURES, "y", "w", "row", SPECS)
    parts.fit_to({0: 3, 1: 3}, 100)
    np.testing.assert_allclose(whole.losses, parts.losses, rtol=1e-9)


def test_focal_slopes_equal_the_column_form(spark):
    m, y = np.linspace(-6, 6, 41), np.arange(41) % 2 * 1.0
    t = spark.createDataFrame(pd.DataFrame({"m": m, "y": y})).select(
        focal_gradient("m", "y").alias("g"), focal_hessian("m", "y").alias("h"), focal_loss("m", "y").alias("l")).toPandas()
    g, h = Objective("focal").slopes(m, y, np.ones(41))
    np.testing.assert_allclose(g, t.g, atol=1e-9)
    np.testing.assert_allclose(h, t.h, atol=1e-9)
    np.testing.assert_allclose(Objective("focal").loss(m, y, np.ones(41)), t.l, atol=1e-5)


def test_search_halves_and_stops(rows):
    trials = [training.Trial(3, 40, step, 1.0, 10, 1.0, 0.5, 1.0) for step in (0.001, 0.3, 0.1)]
    found = training.tune_classifier(rows, FEATURES, "y", "row", "n", trials, folds=2, patience=5, budget=20).collect()
    assert sorted(r.trial for r in found) == [0, 1, 2] and found[0].trial != 0
    assert [r.mean_f1 for r in found] == sorted((r.mean_f1 for r in found), reverse=True)
    assert min(r.trained for r in found) <= training.FIRST_ROUNDS and max(r.trained for r in found) <= 20
    assert {r.test_rows for r in found} == {600}
    low = training.tune_regressor(rows, FEATURES, "z", "w", "row", "n", trials, folds=2, patience=5).collect()
    assert low[0].mean_msle < 0.05 and low[0].mean_msle <= low[-1].mean_msle


def test_few_rows(spark, rows):
    one = rows.limit(1).withColumns({"row": F.lit(0).cast("long"), "n": F.lit(1).cast("long")})
    for df in (one, rows.filter("false")):
        assert len(training.tune_classifier(df, FEATURES, "y", "row", "n", training.draw_trials(2, 1, 3), folds=2).collect()) == 2


def sent_in_a_round(monkeypatch, rows, label, spec, block_rows):
    """Bytes that come to the driver while a tree grows."""
    monkeypatch.setattr(boost, "BLOCK_ROWS", block_rows)
    grown, sent, collect = Boosting(rows, FEATURES, label, "w", "row", [spec]), [], RDD.collect

    def heard(self):
        found = collect(self)
        sent.append(len(pickle.dumps(found)))
        return found

    with monkeypatch.context() as m:
        m.setattr(RDD, "collect", heard)
        grown.round([0])
    assert len(grown.trees[0][0].feature) > 5
    return sum(sent), len(grown.trees[0][0].feature)


def test_classifier_sends_only_best_cuts_to_the_driver(rows, monkeypatch):
    one, many = (sent_in_a_round(monkeypatch, rows, "y", SPECS[0], n) for n in (900, 100))
    assert many[0] <= one[0] * 1.05 and many[0] < 1000 * many[1]


def test_regressor_sends_only_best_cuts_to_the_driver(rows, monkeypatch):
    one, many = (sent_in_a_round(monkeypatch, rows, "z", SPECS[1], n) for n in (900, 100))
    assert many[0] <= one[0] * 1.05 and many[0] < 1000 * many[1]
