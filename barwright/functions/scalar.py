"""Scalar column helpers that fix the missing-value rules once.

Missing values are NULL, never NaN.  Division follows the IEEE reading used by the
feature definitions (a zero denominator gives a signed infinity, 0/0 is missing);
``finite`` later turns infinities into NULL, as the split step does.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dbl(c: Column | str) -> Column:
    return col(c).cast("double")


def ratio(num: Column, den: Column) -> Column:
    """``num / den`` with +-inf on a zero denominator and NULL for 0/0."""
    num, den = dbl(num), dbl(den)
    return F.when(
        den == 0.0,
        F.when(num > 0.0, F.lit(INF)).when(num < 0.0, F.lit(-INF)),
    ).otherwise(F.try_divide(num, den))


def safe_div(num: Column, den: Column) -> Column:
    """``num / den`` with NULL on a zero denominator."""
    return F.try_divide(dbl(num), dbl(den))


def flag(cond: Column) -> Column:
    """0/1 flag; an undecidable condition counts as not met."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(x: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Clamp to bounds.  ``greatest``/``least`` skip NULL, so NULL input is kept NULL."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(x.isNotNull(), out)


def clip_to(x: Column, lo: Column, hi: Column) -> Column:
    """Clamp to per-row bounds; a missing bound leaves that side open."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi))


def finite(x: Column | str) -> Column:
    """NULL for +-inf and NaN."""
    x = dbl(x)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def zero_to(x: Column, value: float | None) -> Column:
    """Replace exact zeros (``None`` makes them missing)."""
    return F.when(x == 0.0, F.lit(value).cast("double")).otherwise(x)


def sign(x: Column) -> Column:
    return F.signum(dbl(x))


def sigmoid(x: Column | str) -> Column:
    x = dbl(x)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def softplus(x: Column) -> Column:
    """``ln(1 + e^x)`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    exps = [F.exp(s - top) for s in scores]
    total = sum(exps[1:], exps[0])
    return [e / total for e in exps]


def argmax(scores: list[Column]) -> Column:
    """0-based position of the first largest score."""
    arr = F.array(*scores)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")
