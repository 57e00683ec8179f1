"""Bars that are kept up to date with a folder of trade files.

Three tables under one folder: ``partials`` (mergeable partial bars per source file, in one folder per day), ``bars`` (the
merged ones, likewise) and ``log`` (per run and source file the days that it had).  A run reads only new and rewritten
trade files.  Days touched by them, now or in the version that the log knows, are merged anew from stored partials; no
other day is read or written.  The log is appended last, so a run that dies is repeated with the same result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.bars import merge_bars, partial_bars
from ..session import cut_lineage
from ..streaming.ingest import FILES_PER_WRITE, KNOWN, SOURCE, changed_files, next_turn
from .tables import path_exists

DAY = "_day"


def refresh_bars(
    spark: SparkSession, source: str, folder: str, read: Callable[[list[str]], DataFrame], series: Sequence[str], out: str = "date",
) -> list[str]:
    """Take in new and rewritten files of ``source``; returns the days whose bars were written anew.

    ``read`` turns a list of paths into trades (``ticks_to_bars`` says which columns).
    """
    root, keys = folder.rstrip("/"), [*series]
    log, partials, bars = f"{root}/log", f"{root}/partials", f"{root}/bars"
    found = changed_files(spark, source, log)
    paths = (r.path for r in found.select("path").toLocalIterator())
    parts = []
    while some := list(islice(paths, FILES_PER_WRITE)):
        trades = read(some).withColumn(SOURCE, F.sha2(F.col("_metadata.file_path"), 256))
        parts.append(cut_lineage(partial_bars(trades, [SOURCE, *keys], out=out).withColumn(DAY, F.date_format(out, "yyyy-MM-dd"))))
    if not parts:
        return []
    fresh = reduce(DataFrame.unionByName, parts)
    held = fresh.select(SOURCE, DAY).distinct()
    touched = held.select(DAY)
    if path_exists(spark, log):
        before = spark.read.parquet(log).join(found.select(SOURCE), SOURCE, "left_semi")
        touched = touched.unionByName(before.filter(F.col(DAY).isNotNull()).select(DAY))
    days = sorted(r[0] for r in touched.distinct().collect())  # days of the calendar
    now = fresh
    if path_exists(spark, partials):
        kept = spark.read.parquet(partials).filter(F.col(DAY).isin(days)).join(found.select(SOURCE), SOURCE, "left_anti")
        now = cut_lineage(fresh.unionByName(kept.withColumn(DAY, F.col(DAY).cast("string")).select(*fresh.columns)))
    _write_days(now, partials, days)
    _write_days(merge_bars(now, [*keys, DAY], out), bars, days)
    entry = found.join(held, SOURCE, "left").withColumn("turn", F.lit(next_turn(spark, log)).cast("long"))
    entry.select(*KNOWN, SOURCE, DAY, "turn").write.mode("append").parquet(log)
    return days


def _write_days(rows: DataFrame, folder: str, days: list[str]) -> None:
    """Replace the folders of the given days; a day without rows loses its folder."""
    spark = rows.sparkSession
    rows.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(folder)
    filled = {r[0] for r in rows.select(DAY).distinct().collect()}
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in set(days) - filled:
        files.delete(path(f"{folder}/{DAY}={day}"), True)


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """The bars of all days."""
    return spark.read.parquet(f"{folder.rstrip('/')}/bars").drop(DAY)
