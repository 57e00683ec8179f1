"""Readers of run artefacts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from .tables import path_exists

# Accepted artefact names, in order of preference.
ARTEFACTS = {
    "compare_csv": ("tft_vs_lgbm_compare.csv", "compare_tft_lgbm.csv", "auc_compare.csv"),
    "summary_json": ("tft_vs_lgbm_summary.json", "compare_summary.json", "summary.json"),
    "lofo_group_csv": ("lofo_group_agg.csv", "lofo_group.csv", "group_lofo.csv"),
    "lofo_feature_csv": ("lofo_feature_agg.csv", "lofo_feature.csv", "feature_lofo.csv"),
}


def find_artefact(spark: SparkSession, folder: str, names: Sequence[str]) -> str | None:
    return next((f"{folder}/{n}" for n in names if path_exists(spark, f"{folder}/{n}")), None)


def pick_column(df: DataFrame, exact: Sequence[str], tokens: Sequence[str] = ()) -> str:
    """First exact candidate present, else the first column holding every token."""
    for name in exact:
        if name in df.columns:
            return name
    if tokens:
        for name in df.columns:
            if all(t in name.lower() for t in tokens):
                return name
    raise ValueError(f"no column among {list(exact)} or containing {list(tokens)}")


def read_report_csv(spark: SparkSession, path: str, required_any: Sequence[Sequence[str]]) -> DataFrame:
    """Report CSV that must have at least one column of every group."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    missing = [list(g) for g in required_any if not any(c in df.columns for c in g)]
    if missing:
        raise ValueError(f"missing required columns {missing}; available: {df.columns}")
    return df


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Summary JSON and its top-level keys."""
    df = spark.read.json(path, multiLine=True)
    return df, df.columns


def latest_run(spark: SparkSession, folder: str) -> str:
    """The ``run_*`` folder with the greatest name."""
    runs = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run_*")
    found = runs.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(runs)
    names = [s.getPath().getName() for s in found or () if s.isDirectory()]
    if not names:
        raise FileNotFoundError(f"no run_* folder under {folder}")
    return f"{folder}/{max(names)}"
