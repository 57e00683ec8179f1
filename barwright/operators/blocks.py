"""Window layers over a series too long for one task.

The series is cut into blocks of consecutive rows; each block also receives the rows just
before and after it (the halo) so bounded frames see all their rows.  Everything written
against a ``Layout`` runs unchanged with the block number added to the partition keys; a frame
that reaches beyond the halo is refused.  Unbounded frames need a carried value instead: see
``ffill_in_blocks``, ``latch_in_blocks`` and the block scans in ``scan`` and ``cusum``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.over import Layout
from .align import row_index

BLOCK = "_block"


@dataclass(frozen=True)
class BlockLayout(Layout):
    """A layout inside a block: only frames within ``before`` and ``after`` rows are right."""

    before: int = 0
    after: int = 0

    def rows(self, start: int, end: int):
        if start < -self.before or end > self.after:
            raise ValueError(f"rows {start}..{end} reach beyond the halo of {self.before} before and {self.after} after")
        return super().rows(start, end)

    def whole(self):
        raise ValueError("a whole-series frame has no meaning inside a block; fit it apart and join it")

    def row_number(self):
        raise ValueError("rows are numbered over the series (align.row_index), not inside a block")

    def lag(self, c, n: int = 1) -> Column:
        self.rows(-n, 0)
        return super().lag(c, n)

    def lead(self, c, n: int = 1) -> Column:
        self.rows(0, n)
        return super().lead(c, n)


def in_blocks(
    df: DataFrame,
    series: Sequence[str],
    row: str,
    build: Callable[[DataFrame, Layout], DataFrame],
    before: int,
    after: int = 0,
    block_rows: int = 8192,
) -> DataFrame:
    """Run ``build(df, layout)`` block by block; the result does not depend on ``block_rows``.

    ``row`` is the dense row index.  ``before`` and ``after`` are the rows that the deepest chain of
    frames reaches back and ahead: where a window reads the result of another, their reaches add up.
    A single frame beyond them is refused.  A hot series becomes many independent partitions;
    the copied rows are ``(before + after) / block_rows`` of the input.
    """
    if max(before, after) > block_rows:
        raise ValueError("a halo must not exceed block_rows")
    place = F.pmod(F.col(row), F.lit(block_rows))
    home = F.floor(F.col(row) / F.lit(block_rows)).cast("long")
    blocks = F.filter(F.array(
        F.when(place < after, F.col("_home") - 1), F.col("_home"), F.when(place >= block_rows - before, F.col("_home") + 1),
    ), lambda b: b.isNotNull())
    copies = df.withColumn("_home", home).withColumn(BLOCK, F.explode(blocks))
    built = build(copies, BlockLayout((*series, BLOCK), (row,), before=before, after=after))
    return built.filter(F.col("_home") == F.col(BLOCK)).drop("_home", BLOCK)


def windows_in_blocks(
    df: DataFrame,
    series: Sequence[str],
    ts: str,
    build: Callable[[DataFrame, Layout], DataFrame],
    before: int,
    after: int = 0,
    bucket: Column | None = None,
    block_rows: int = 65_536,
) -> DataFrame:
    """``in_blocks`` for rows without an index.  ``bucket`` is the time bucket of
    ``align.row_index`` (the day of ``ts`` by default)."""
    bucket = F.date_trunc("day", F.col(ts)) if bucket is None else bucket
    indexed = row_index(df, series, [ts], bucket, "_row")
    return in_blocks(indexed, series, "_row", build, before, after, block_rows).drop("_row")


def _carry(df: DataFrame, series: Sequence[str], row: str, value: Column, block_rows: int):
    """(keyed rows, last non-missing value of everything before each block)."""
    keyed = df.withColumn(BLOCK, F.floor(F.col(row) / F.lit(block_rows)).cast("long"))
    ends = keyed.groupBy(*series, BLOCK).agg(
        F.max_by(value, F.when(value.isNotNull(), F.col(row))).alias("_end")
    )
    before = Window.partitionBy(*series).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*series, BLOCK, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    return keyed.join(carried, [*series, BLOCK])


def ffill_in_blocks(
    df: DataFrame, series: Sequence[str], row: str, column: str, out: str, block_rows: int = 8192
) -> DataFrame:
    joined = _carry(df, series, row, F.col(column), block_rows)
    inside = Layout.of((*series, BLOCK), row).ffill(column)
    return joined.withColumn(out, F.coalesce(inside, F.col("_carry"))).drop(BLOCK, "_carry")


def latch_in_blocks(
    df: DataFrame, series: Sequence[str], row: str, column: str, out: str, enter: float, leave: float,
    block_rows: int = 8192,
) -> DataFrame:
    """High-mode switch (``enter > leave``) for a series of any length."""
    if enter <= leave:
        raise ValueError("needs enter > leave")
    decisive = F.when(F.col(column) >= enter, 1).when(F.col(column) <= leave, 0)
    marked = df.withColumn("_state", decisive)
    filled = ffill_in_blocks(marked, series, row, "_state", out, block_rows)
    return filled.withColumn(out, F.coalesce(F.col(out), F.lit(0))).drop("_state")
