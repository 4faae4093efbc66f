"""Rounding and clamping that come out the same on every engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Plain double arithmetic, so that another engine running the same formula gets the same bits."""
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, null for an empty whole."""
    return round_half_up(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), digits)
