"""Tables behind the model-comparison report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.reports import pick_column

FOLD = (("fold", "fold_id", "cv_fold"), ("fold",))
TREE_AUC = (("lgbm_auc", "auc_lgbm"), ("lgbm", "auc"))
DEEP_AUC = (("tft_auc", "auc_tft"), ("tft", "auc"))
NAME = (("group", "group_name", "feature", "feature_name"), ())
DELTA = (("delta_auc", "auc_delta", "diff_auc"), ("auc", "delta"))


def _named(df: DataFrame, **wanted) -> DataFrame:
    return df.select(*[F.col(pick_column(df, *spec)).alias(out) for out, spec in wanted.items()])


def fold_comparison(df: DataFrame) -> DataFrame:
    return _named(df, fold=FOLD, lgbm_auc=TREE_AUC, tft_auc=DEEP_AUC).orderBy("fold")


def auc_distribution(df: DataFrame) -> DataFrame:
    """Minimum, quartiles and maximum per model; missing scores ignored."""
    wide = _named(df, lgbm=TREE_AUC, tft=DEEP_AUC)
    long = wide.select(F.explode(F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("auc")) for m in ("lgbm", "tft")]
    )).alias("_r")).select("_r.*").filter(F.col("auc").isNotNull())
    five = F.percentile("auc", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    names = ("min", "q1", "median", "q3", "max")
    return long.groupBy("model").agg(five.alias("_f"), F.count("auc").alias("n")).select(
        "model", "n", *[F.col("_f")[i].alias(n) for i, n in enumerate(names)])


def ablation_ranking(df: DataFrame, top: int | None = None) -> DataFrame:
    """Largest drop first; ties by name."""
    ranked = _named(df, name=NAME, delta_auc=DELTA).na.drop("any").orderBy(F.desc("delta_auc"), "name")
    return ranked if top is None else ranked.limit(top)


def win_fold_contribution(df: DataFrame) -> DataFrame:
    """Mean difference of winning and other folds; empty unless both kinds occur."""
    d = _named(df, a=TREE_AUC, b=DEEP_AUC).na.drop("any").select((F.col("b") - F.col("a")).alias("delta"))
    kinds = {True: F.col("delta") > 0, False: ~(F.col("delta") > 0)}
    one = d.agg(*[F.struct(F.lit(win).alias("win"), F.avg(F.when(kind, F.col("delta"))).alias("mean_delta"),
                           F.count(F.when(kind, F.col("delta"))).alias("n")).alias(f"_{win}") for win, kind in kinds.items()])
    return one.filter((F.col("_True.n") > 0) & (F.col("_False.n") > 0)).select(F.inline(F.array("_True", "_False")))
