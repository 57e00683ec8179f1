"""Scores of prediction tables, grouped by any key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import dbl

#: Width of a slice of scores: its exponentials stay finite.
SLICE = 64.0


def _tally(y: Column, pred: Column) -> dict[str, Column]:
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("double")
    return {
        "tp": count((pred == 1) & (y == 1)), "fp": count((pred == 1) & (y == 0)),
        "fn": count((pred == 0) & (y == 1)), "tn": count((pred == 0) & (y == 0)),
    }


def _rate(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": _rate(tp + tn, tp + fp + fn + tn),
        "precision": _rate(tp, tp + fp),
        "recall": _rate(tp, tp + fn),
        "f1": _rate(tp * 2.0, tp * 2.0 + fp + fn),
    }


def classification_scores(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Accuracy, precision, recall, F1; undefined ratios are 0."""
    t = df.groupBy(*keys).agg(*[v.alias(n) for n, v in _tally(F.col(y), F.col(pred)).items()])
    return t.select(*keys, *[v.alias(n) for n, v in _scores(*map(F.col, ("tp", "fp", "fn", "tn"))).items()])


def quadratic_kappa(df: DataFrame, keys: Sequence[str], y: str, pred: str) -> DataFrame:
    """Agreement with squared-distance penalties.

    The expected penalty needs only the first two moments of both margins:
    E[(i-j)^2] = E[i^2] - 2 E[i]E[j] + E[j^2], so one aggregate is enough and no table of
    class pairs is built.
    """
    a, b = dbl(y), dbl(pred)
    m = df.groupBy(*keys).agg(
        F.avg((a - b) * (a - b)).alias("_o"), F.avg(a * a).alias("_aa"), F.avg(b * b).alias("_bb"),
        F.avg(a).alias("_a"), F.avg(b).alias("_b"),
    )
    expected = F.col("_aa") - F.lit(2.0) * F.col("_a") * F.col("_b") + F.col("_bb")
    return m.select(*keys, (F.lit(1.0) - F.try_divide(F.col("_o"), expected)).alias("qwk"))


def selective_accuracy(df: DataFrame, keys: Sequence[str], y: str, pred: str, classes: Sequence[int] = (0, 2)) -> DataFrame:
    """Share of hits among predictions of the given classes, 0 when there is none."""
    chosen = F.col(pred).isin(*classes)
    hit = F.when(chosen, (F.col(y) == F.col(pred)).cast("double"))
    return df.groupBy(*keys).agg(F.coalesce(F.avg(hit), F.lit(0.0)).alias("selective_accuracy"))


def mean_loss(df: DataFrame, keys: Sequence[str], loss: Column, out: str, reduction: str = "mean") -> DataFrame:
    agg = {"mean": F.avg, "sum": F.sum}[reduction]
    return df.groupBy(*keys).agg(agg(loss).alias(out))


def listnet_loss(df: DataFrame, keys: Sequence[str], y: str, score: str, out: str = "listnet") -> DataFrame:
    """Cross entropy between the softmax of the targets and of the scores over each group.

    log-softmax is linear in the score, so the loss is log-sum-exp(score) minus the
    target-weighted mean score: sums per group.  To stay finite they are added per slice of scores
    and of targets, ``SLICE`` wide and relative to the slice's edge; the few slices of a group are rescaled to its top one.
    """
    x, t = dbl(score), dbl(y)
    sliced = df.select(*keys, x.alias("_x"), t.alias("_t"), F.floor(x / SLICE).alias("_i"), F.floor(t / SLICE).alias("_j"))
    sliced = sliced.filter(F.col("_x").isNotNull() & F.col("_t").isNotNull())
    ex, ey = F.exp(F.col("_x") - F.col("_i") * SLICE), F.exp(F.col("_t") - F.col("_j") * SLICE)
    parts = sliced.groupBy(*keys, "_i", "_j").agg(F.sum(ex).alias("_ex"), F.sum(ey).alias("_ey"), F.sum(ey * F.col("_x")).alias("_exy"))
    lists = parts.groupBy(*keys).agg(F.collect_list(F.struct("_i", "_j", "_ex", "_ey", "_exy")).alias("_s"), F.max("_i").alias("_top"), F.max("_j").alias("_high"))

    def total(value: str, edge: str, top: str) -> Column:
        return F.aggregate("_s", F.lit(0.0), lambda s, e: s + e[value] * F.exp((e[edge] - F.col(top)) * SLICE))

    loss = F.ln(total("_ex", "_i", "_top")) + F.col("_top") * SLICE - total("_exy", "_j", "_high") / total("_ey", "_j", "_high")
    return lists.select(*keys, loss.alias(out))


def kl_histograms(
    df: DataFrame, keys: Sequence[str], y: str, pred: str, bins: int = 50, out: str = "kl"
) -> DataFrame:
    """KL divergence of the target histogram from the prediction histogram.

    Bins span the targets; predictions outside are dropped; an empty prediction bin under a
    non-empty target bin gives infinity.
    """
    span = df.groupBy(*keys).agg(F.min(dbl(y)).alias("_lo"), F.max(dbl(y)).alias("_hi"))
    rows = df.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), dbl(y).alias("v")), F.struct(F.lit(1).alias("side"), dbl(pred).alias("v"))
    )).alias("_r")).join(span, list(keys))
    v, lo, hi = F.col("_r.v"), F.col("_lo"), F.col("_hi")
    # Equal targets leave a span of zero; everything on it falls into the first bin.
    place = F.least(F.coalesce(F.floor(F.try_divide((v - lo) * F.lit(float(bins)), hi - lo)), F.lit(0)), F.lit(bins - 1))
    counts = rows.filter(v.between(lo, hi)).groupBy(*keys, place.alias("_bin")).agg(
        F.sum(F.when(F.col("_r.side") == 0, 1).otherwise(0)).alias("_t"),
        F.sum(F.when(F.col("_r.side") == 1, 1).otherwise(0)).alias("_p"),
    )
    w = Window.partitionBy(*keys)
    p = F.try_divide(F.col("_t").cast("double"), F.sum("_t").over(w))
    q = F.try_divide(F.col("_p").cast("double"), F.sum("_p").over(w))
    parts = counts.withColumn("_part", F.when(F.col("_t") == 0, 0.0)
                              .when(F.coalesce(q, F.lit(0.0)) == 0.0, F.lit(float("inf"))).otherwise(p * F.ln(p / q)))
    return parts.groupBy(*keys).agg(F.sum("_part").alias(out))


def threshold_sweep(
    df: DataFrame, keys: Sequence[str], y: str, probability: str, thresholds: Sequence[float]
) -> DataFrame:
    """F1 of ``probability > t`` for every threshold.

    Rows are reduced to counts per interval between thresholds, and the counts are summed
    from the top: the input is read once, whatever the number of thresholds.
    """
    cuts = sorted(thresholds)
    passed = sum(((dbl(probability) > F.lit(float(t))).cast("int") for t in cuts[1:]),
                 (dbl(probability) > F.lit(float(cuts[0]))).cast("int"))
    counts = df.groupBy(*keys, passed.alias("_k")).agg(
        F.sum((F.col(y) == 1).cast("int")).alias("_pos"), F.sum((F.col(y) == 0).cast("int")).alias("_neg"))
    # A row in interval k is predicted positive by thresholds 1..k.
    lines = counts.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(len(cuts))))).groupBy(*keys, "_i").agg(
        *[F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("double").alias(n) for n, c, cond in (
            ("tp", "_pos", F.col("_k") >= F.col("_i")), ("fp", "_neg", F.col("_k") >= F.col("_i")),
            ("fn", "_pos", F.col("_k") < F.col("_i")), ("tn", "_neg", F.col("_k") < F.col("_i")))]
    )
    return lines.select(
        *keys, F.element_at(F.array(*[F.lit(float(t)) for t in cuts]), F.col("_i")).alias("threshold"),
        *[v.alias(n) for n, v in _scores(*map(F.col, ("tp", "fp", "fn", "tn"))).items()],
    )


def best_threshold(sweep: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest F1 per group, the lowest threshold among equals."""
    return sweep.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.col("threshold"))).alias("_b")
    ).select(*keys, F.col("_b.threshold").alias("threshold"), F.col("_b.f1").alias("f1"))


def fold_mean(df: DataFrame, keys: Sequence[str], score: str, out: str = "mean_score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(out))


def auc(df: DataFrame, keys: Sequence[str], y: str, score: str, out: str = "auc", slices: int = 256) -> DataFrame:
    """Exact rank-sum AUC.

    Ties are collapsed to counts per distinct score with map-side combine.  The running
    count of negatives is taken in two levels, over slices cut at approximate quantiles of the
    distinct scores and inside a slice, so no task orders all scores of a group, however
    unevenly they lie.
    """
    tallied = df.groupBy(*keys, dbl(score).alias("_s")).agg(
        F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) == 0).cast("long")).alias("_n"))
    shares = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    cuts = tallied.groupBy(*keys).agg(F.percentile_approx("_s", shares, 10 * slices).alias("_cuts"))
    sliced = tallied.join(cuts, list(keys)).withColumn(
        "_k", F.size(F.filter("_cuts", lambda c: c < F.col("_s")))).drop("_cuts")
    totals = sliced.groupBy(*keys, "_k").agg(F.sum("_n").alias("_kn"))
    up = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    below = totals.select(*keys, "_k", (F.sum("_kn").over(up) - F.col("_kn")).alias("_below"))
    inside = Window.partitionBy(*keys, "_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.withColumn("_in", F.sum("_n").over(inside) - F.col("_n")).join(below, [*keys, "_k"])
    wins = F.col("_p") * (F.col("_below") + F.col("_in") + F.col("_n") / F.lit(2.0))
    return ranked.groupBy(*keys).agg(
        F.try_divide(F.sum(wins), F.sum("_p").cast("double") * F.sum("_n").cast("double")).alias(out))
