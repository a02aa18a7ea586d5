"""Column expressions over numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in ms, both ends of none included but the upper.
LATENCY_BOUNDS = (50, 100, 250, 500, 1000, 2000, 5000, 15000)


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """part / whole, null where whole is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def latency_bucket(value: Column, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> Column:
    """The first bound at or above the value, as text; +Inf beyond."""
    chosen = F.lit("+Inf")
    for b in reversed(bounds):
        chosen = F.when(value <= b, F.lit(str(b))).otherwise(chosen)
    return chosen


def bucket_midpoint(bound: Column, bounds: tuple[int, ...] = LATENCY_BOUNDS) -> Column:
    """Middle of a bucket named by its upper bound; +Inf counts as twice the last bound."""
    lows = (0, *bounds)
    highs = (*bounds, 2 * bounds[-1])
    names = (*map(str, bounds), "+Inf")
    chosen = F.lit(None).cast("double")
    for name, low, high in zip(names, lows, highs, strict=True):
        chosen = F.when(bound == name, F.lit((low + high) / 2)).otherwise(chosen)
    return chosen


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))
