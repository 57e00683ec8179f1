"""Walk-forward search of boosted trees.

All folds of all trials grow together (``operators.boost``).  Trials are halved: after the first rounds the better half
goes on for twice as many, until one is left, which may use all its rounds; nothing is fitted again on the way.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import astuple, dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..operators.boost import Boosting, Objective, Spec, best_round
from ..operators.fit import class_balance

__all__ = ["PATIENCE", "Trial", "balance_weight", "best_round", "draw_trials", "fold_parts", "fold_profile", "tune_classifier", "tune_regressor"]

#: Share of a fold's training rows, the last ones, that decide when boosting stops.
VALIDATION = 0.2
#: Rounds without a new best validation error that end boosting.
PATIENCE = 100
#: Rounds of all trials before the first halving.
FIRST_ROUNDS = 8


@dataclass(frozen=True)
class Trial:
    depth: int
    rounds: int
    step: float
    subsample: float
    min_rows: int
    feature_share: float
    threshold: float
    pos_weight: float
    leaves: int = 31
    l1: float = 0.0
    l2: float = 0.0


PARAMS = ("depth int, rounds int, step double, subsample double, min_rows int, feature_share double, threshold double, "
          "pos_weight double, leaves int, l1 double, l2 double")


def draw_trials(n: int, seed: int = 0, max_rounds: int = 1000) -> list[Trial]:
    """Seeded random parameters over the surveyed ranges; the learning rate on a log scale.

    ``max_rounds`` is only an upper end: boosting stops when the validation rows gain nothing for ``PATIENCE`` rounds.
    """
    rng = random.Random(seed)
    return [
        Trial(
            depth=rng.randint(3, 12), rounds=max_rounds, step=0.001 * 200 ** rng.random(), subsample=rng.uniform(0.6, 1.0),
            min_rows=rng.randint(1, 50), feature_share=rng.uniform(0.5, 1.0), threshold=rng.uniform(0.1, 0.9),
            pos_weight=rng.uniform(0.5, 20.0), leaves=rng.randint(16, 128), l1=1e-8 * 1e9 ** rng.random(), l2=1e-8 * 1e9 ** rng.random(),
        )
        for _ in range(n)
    ]


def fold_parts(df: DataFrame, row: str, total: str, folds: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """(train, test) of every expanding fold: two range filters on the row index, no copies.

    Training rows carry ``_late``, true on the last part of them.
    """
    size = F.floor(F.col(total) / F.lit(folds + 1))
    for fold in range(folds):
        begin = F.col(total) - F.lit(folds - fold) * size
        train = df.filter(F.col(row) < begin).withColumn("_late", F.col(row) >= F.floor(begin * (1.0 - VALIDATION)))
        yield train, df.filter((F.col(row) >= begin) & (F.col(row) < begin + size))


def fold_profile(df: DataFrame, label: str, row: str, total: str, folds: int = 5) -> DataFrame:
    """Rows and share of positives of both parts of every fold."""
    lines = [
        part.select(F.lit(fold).alias("fold"), F.lit(role).alias("role"), F.col(label).cast("double").alias("_y"))
        for fold, parts in enumerate(fold_parts(df, row, total, folds)) for role, part in zip(("train", "test"), parts)
    ]
    rows = lines[0]
    for x in lines[1:]:
        rows = rows.unionByName(x)
    return rows.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("positive_share"))


def fold_specs(t: Trial, objective: Objective, rows: int, folds: int) -> list[Spec]:
    """One model per fold, over the row ranges of ``fold_parts``."""
    size = rows // (folds + 1)
    begins = [rows - (folds - fold) * size for fold in range(folds)]
    return [Spec(objective, int(begin * (1.0 - VALIDATION)), begin, begin + size, t.depth, t.leaves, t.step, t.subsample, t.min_rows,
                 t.feature_share, t.l1, t.l2, seed=7) for begin in begins]


def _search(
    df: DataFrame, features: Sequence[str], label: str, weight: str | None, row: str, total: str, trials: Sequence[Trial], folds: int,
    patience: int, budget: int | None, objective: Callable[[Trial], Objective], measure: Callable[[Trial], Callable], score: Callable[[np.ndarray], float],
    better: Callable[[float], float],
) -> list[tuple]:
    """(trial, parameters, rounds, scored rows, score) of every trial, scored where it stopped; loops over rounds and trials, never over rows.

    ``budget`` is the number of rounds of the last trial, all its rounds by default.
    """
    rows = int((df.agg(F.max(total)).first()[0]) or 0)
    specs = [s for t in trials for s in fold_specs(t, objective(t), rows, folds)]
    grown = Boosting(df, features, label, weight, row, specs)
    of = {k: range(k * folds, (k + 1) * folds) for k in range(len(trials))}
    sums_of = {i: measure(trials[k]) for k in of for i in of[k]}
    try:
        alive, limit, found = list(of), FIRST_ROUNDS, {}
        while alive:
            last = len(alive) == 1
            for k in alive:
                limit = (budget or trials[k].rounds) if last else limit
            grown.fit_to({i: min(limit, trials[k].rounds) for k in alive for i in of[k]}, patience)
            upto = {i: grown.best(i, patience) for k in alive for i in of[k]}
            sums = {i: np.zeros(4) for i in upto} | grown.scored(upto, lambda i, m, y, w: sums_of[i](m, y))
            for k in alive:
                found[k] = (max(len(grown.trees[i]) for i in of[k]), int(sum(sums[i][-1] for i in of[k])), float(np.mean([score(sums[i]) for i in of[k]])))
            if last:
                break
            alive = sorted(sorted(alive, key=lambda k: (better(found[k][-1]), k))[:-(-len(alive) // 2)])
            limit *= 2
        return [(k, *astuple(trials[k]), *found[k]) for k in of]
    finally:
        grown.close()


def tune_classifier(
    df: DataFrame, features: Sequence[str], label: str, row: str, total: str, trials: Sequence[Trial], folds: int = 5, patience: int = PATIENCE,
    budget: int | None = None,
) -> DataFrame:
    """``(trial, params..., trained, test_rows, mean_f1)`` ordered best first; focal loss, score = mean F1 over the folds' test rows."""
    def counts(t: Trial) -> Callable:
        def run(m: np.ndarray, y: np.ndarray) -> np.ndarray:
            said, true = 1.0 / (1.0 + np.exp(-m)) > t.threshold, y > 0.5
            return np.array([(said & true).sum(), (said & ~true).sum(), (~said & true).sum(), len(y)], float)
        return run

    def f1(sums: np.ndarray) -> float:
        return float(2 * sums[0] / (2 * sums[0] + sums[1] + sums[2])) if sums[0] else 0.0

    lines = _search(df, features, label, None, row, total, trials, folds, patience, budget,
                    lambda t: Objective("focal", pos_weight=t.pos_weight), counts, f1, lambda s: -s)
    return df.sparkSession.createDataFrame(lines, f"trial int, {PARAMS}, trained int, test_rows int, mean_f1 double").orderBy(F.desc("mean_f1"), "trial")


def tune_regressor(
    df: DataFrame, features: Sequence[str], label: str, weight: str, row: str, total: str,
    trials: Sequence[Trial], folds: int = 5, patience: int = PATIENCE, budget: int | None = None,
) -> DataFrame:
    """``(trial, params..., trained, test_rows, mean_msle)`` ordered best first; rows weighted while fitting."""
    def errors(t: Trial) -> Callable:
        def run(m: np.ndarray, y: np.ndarray) -> np.ndarray:
            known = ~np.isnan(y)
            off = np.log1p(np.maximum(m[known], 0.0)) - np.log1p(y[known])
            return np.array([(off ** 2).sum(), known.sum()])
        return run

    lines = _search(df, features, label, weight, row, total, trials, folds, patience, budget,
                    lambda t: Objective("squared"), errors, lambda sums: float(sums[0] / sums[1]) if sums[1] else 0.0, lambda s: s)
    return df.sparkSession.createDataFrame(lines, f"trial int, {PARAMS}, trained int, test_rows int, mean_msle double").orderBy("mean_msle", "trial")


def balance_weight(df: DataFrame, label: str) -> float:
    """Negatives per positive as a class weight."""
    return float(class_balance(df, label).first()["pos_weight"] or 1.0)
