"""Calendar features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def calendar_columns(ts: Column) -> dict[str, Column]:
    """hour/day/week/month fields and their sine-cosine encodings (Monday = 0)."""
    hour, day = F.hour(ts), F.dayofyear(ts)
    turn = 2 * math.pi
    return {
        "hour": hour,
        "hour_sin": F.sin(F.lit(turn) * hour / F.lit(24.0)),
        "hour_cos": F.cos(F.lit(turn) * hour / F.lit(24.0)),
        "day": day,
        "day_sin": F.sin(F.lit(turn) * day / F.lit(365.25)),
        "day_cos": F.cos(F.lit(turn) * day / F.lit(365.25)),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "hour_of_day": hour,
    }
