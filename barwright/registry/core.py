"""Registration of queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison.  A shift far below the last digit keeps exact halves off
    the rounding edge; adding zero removes negative zero."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`") + F.lit(nudge(digits)), digits) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def nudge(digits: int) -> float:
    return 1.7 * 10.0 ** -(digits + 3)


def finish(ctes: str, source: str, keep: list[str], doubles: list[str], digits: int = 6, where: str = "") -> str:
    """SELECT with the same rounding; ``keep`` and ``doubles`` may hold ``expr AS name``."""
    def shape(item: str) -> str:
        expr, _, name = item.rpartition(" AS ")
        expr = expr or name
        return f"round({expr} + {nudge(digits)!r}::DOUBLE, {digits}) + 0.0 AS {name}"

    columns = ", ".join([*keep, *(shape(d) for d in doubles)])
    return f"WITH RECURSIVE {ctes} SELECT {columns} FROM {source} {where}"
