"""Guarded ratios and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 where the whole is zero or unknown."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def flag(condition: Column) -> Column:
    """1.0 for true, 0.0 for false or unknown."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def nearest_rank(count: Column, share: float) -> Column:
    """1-based position of a percentile in `count` sorted values; halves round to even."""
    return (F.rint((count - 1) * F.lit(share)) + 1).cast("long")
