"""Weight of a score by its distance to the alarm, after the Numenta benchmark's sigmoid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the weighting: slope of the sigmoid and smallest ratio of
# distance to window length.
SLOPE = 15.0
SMALLEST_RATIO = 0.01


def distance_weight(hours: Column, window_length: Column) -> Column:
    """``2 / (1 + exp(-15 r)) - 1`` with ``r = hours / window_length``, at least 0.01."""
    ratio = F.greatest(hours / window_length, F.lit(SMALLEST_RATIO))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(-SLOPE) * ratio)) - F.lit(1.0)


def distance_weight_single(hours: Column, window_length: Column) -> Column:
    """The same, but exactly 1 beyond the window."""
    return F.when(hours > window_length, F.lit(1.0)).otherwise(distance_weight(hours, window_length))
