"""Row and column cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from ..functions.scalar import clip, finite


def time_range(df: DataFrame, ts: str, lo, hi) -> DataFrame:
    """Rows with ``lo <= ts <= hi``."""
    return df.filter(F.col(ts).between(lo, hi))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first by ``order``.

    Spark limits each map task to the first row of every key before the exchange
    (``WindowGroupLimit``), so a key holding a large share of all rows arrives as one row per task.
    """
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_first", first).filter("_first = 1").drop("_first")


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with a value in every column.

    One test per column, not a single test over all of them: the optimizer rewrites a
    condition once per alias of each column it mentions, which explodes on wide tables.
    """
    return df.filter(reduce(and_, [F.col(f"`{c}`").isNotNull() for c in columns or df.columns]))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: number of NULLs per column."""
    columns = list(columns or df.columns)
    return df.agg(*[F.sum(F.col(c).isNull().cast("int")).cast("long").alias(c) for c in columns])


def mostly_filled(df: DataFrame, share: float = 0.5, always: Sequence[str] = ()) -> list[str]:
    """Columns whose NULL share does not exceed ``share``.

    The kept schema depends on the data, so this is one explicit aggregate action that
    brings back a single row.
    """
    names = [c for c in df.columns if c not in always]
    row = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in names],
    ).first()
    limit = share * row["_n"]
    return [c for c in df.columns if c in always or (row[c] or 0) <= limit]


def drop_sparse_columns(df: DataFrame, share: float = 0.5, always: Sequence[str] = ()) -> DataFrame:
    return df.select(*mostly_filled(df, share, always))


def finite_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """+-inf and NaN become NULL in the given columns."""
    return df.withColumns({c: finite(c) for c in columns})


def clip_columns(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Clamp the columns that are present to fixed bounds."""
    present = {c: clip(F.col(c).cast("double"), lo, hi) for c, (lo, hi) in bounds.items() if c in df.columns}
    return df.withColumns(present) if present else df


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns, leaving out booleans and the columns listed as categorical."""
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in exclude
    ]


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; unreadable text becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def exclude_clusters(df: DataFrame, cluster: str, noise: Sequence[int] = (-1, -2)) -> DataFrame:
    return df.filter(~F.col(cluster).isin(*noise))


def confident(df: DataFrame, probability: str, threshold: float) -> DataFrame:
    return df.filter(F.col(probability) >= threshold)


def chronological_split(df: DataFrame, ts: str, split_day: str, overlap: str = "disjoint"):
    """(train, test).  ``overlap='reference'`` keeps the whole split day in both halves."""
    day = F.to_date(F.lit(split_day))
    start = day.cast("timestamp")
    after = F.date_add(day, 1).cast("timestamp")
    if overlap == "reference":
        return df.filter(F.col(ts) < after), df.filter(F.col(ts) >= start)
    if overlap == "disjoint":
        return df.filter(F.col(ts) < start), df.filter(F.col(ts) >= start)
    raise ValueError("overlap must be 'disjoint' or 'reference'")
