"""Row-level loss values for prediction tables (binary target ``y``, raw score ``x``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import dbl, sigmoid, softplus


def bce_with_logits(x, y, pos_weight: float = 1.0) -> Column:
    x, y = dbl(x), dbl(y)
    return F.lit(float(pos_weight)) * y * softplus(-x) + (F.lit(1.0) - y) * softplus(x)


def focal_loss(x, y, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p = F.least(F.greatest(sigmoid(x), F.lit(1e-6)), F.lit(1 - 1e-6))
    y, one = dbl(y), F.lit(1.0)
    return -F.lit(alpha) * F.pow(one - p, F.lit(gamma)) * y * F.ln(p) - F.lit(1 - alpha) * F.pow(
        p, F.lit(gamma)
    ) * (one - y) * F.ln(one - p)


def focal_gradient(x, y, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p, y, one, tiny = sigmoid(x), dbl(y), F.lit(1.0), F.lit(1e-12)
    a, g = F.lit(alpha), F.lit(gamma)
    up = a * y * F.pow(one - p, g) * (g * p * F.ln(p + tiny) + p - one)
    down = (one - a) * (one - y) * F.pow(p, g) * (p - g * (one - p) * F.ln(one - p + tiny))
    return up + down


def focal_hessian(x, y, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    p, y, one, tiny = sigmoid(x), dbl(y), F.lit(1.0), F.lit(1e-12)
    a, g = F.lit(alpha), F.lit(gamma)
    up = a * y * F.pow(one - p, g) * (g * (one - p - p * F.ln(p + tiny)) + one)
    down = (one - a) * (one - y) * F.pow(p, g) * (g * (p - (one - p) * F.ln(one - p + tiny)) + one)
    return (up + down) * p * (one - p)


def pinball_loss(predictions: dict[float, Column], target: Column) -> Column:
    """Quantile loss of one row, summed over the quantiles."""
    total = F.lit(0.0)
    for q, pred in predictions.items():
        err = dbl(target) - dbl(pred)
        total = total + F.greatest(F.lit(q - 1.0) * err, F.lit(q) * err)
    return total


def squared_log_error(y, p) -> Column:
    return F.pow(F.log1p(dbl(y)) - F.log1p(dbl(p)), F.lit(2.0))
