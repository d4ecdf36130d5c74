"""Windows counted back from the next alarm, and grids of window lengths."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.operators.alarms import NO_ALARM, hours_to_alarm

# The default grid of window lengths, in hours.
DEFAULT_GRID = (1, 2, 3, 4, 5, 6, 12, 18, 24, 36, 48)

BY = ("algorithm",)


def window_number(window_length: Column, single_negative: bool = False, time: Column | None = None) -> Column:
    """Number of the window a row lies in; 0 is the one right before the alarm. ``time`` stands in for the row's.

    Many negatives: whole window lengths to the alarm. Single negative: 1 for all
    rows further away than the window length, else 0.
    """
    seconds = F.col("next_alarm") - (F.col("unix") if time is None else time)
    if single_negative:
        return (seconds / F.lit(3600.0) > window_length).cast("bigint")
    return F.floor(seconds / (F.lit(3600.0) * window_length))


def positive_lengths(windows: Sequence[float]) -> list[float]:
    lengths = [float(length) for length in windows]
    if not all(length > 0 for length in lengths):
        raise ValueError(f"window lengths must be above 0, not {lengths}")
    return lengths


def positive_label() -> Column:
    return (F.col("window_no") == 0) & (F.col("next_alarm") != NO_ALARM)


def with_window_number(annotated: DataFrame, window_length: float, single_negative: bool = False) -> DataFrame:
    """Add ``hours_to_alarm``, ``window_no`` and ``label`` for one window length."""
    length = F.lit(*positive_lengths([window_length]))
    return (
        annotated.withColumn("hours_to_alarm", hours_to_alarm())
        .withColumn("window_no", window_number(length, single_negative))
        .withColumn("label", positive_label())
    )


def whole_seconds(grid: Sequence[float]) -> list[int] | None:
    """The grid in seconds, or None if a length is not a whole number of them."""
    seconds = [length * 3600 for length in grid]
    if all(float(s).is_integer() and s > 0 for s in seconds):
        return [int(s) for s in seconds]
    return None


def common_step(seconds: Sequence[int]) -> int:
    """The longest step that every window length is a multiple of."""
    return reduce(math.gcd, seconds)


def common_span(seconds: Sequence[int]) -> int:
    """The shortest span that is a multiple of every window length."""
    return math.lcm(*seconds)


def hours_range(annotated: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Least and greatest hours to the next alarm."""
    return annotated.groupBy(*by).agg(
        F.min(hours_to_alarm()).alias("min_hours"), F.max(hours_to_alarm()).alias("max_hours")
    )


def default_grid(scores: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """The default grid for every algorithm among the scores."""
    lengths = F.array(*[F.lit(float(length)) for length in DEFAULT_GRID])
    return scores.select(*by).distinct().withColumn("window_length", F.explode(lengths))


def even_grid(
    annotated: DataFrame,
    windows: int,
    min_length: float = 1.0,
    max_length: float = 48.0,
    by: Sequence[str] = BY,
) -> DataFrame:
    """``windows`` evenly spaced lengths between the bounds that the data allows."""
    bounds = hours_range(annotated, by).select(
        *by,
        F.greatest("min_hours", F.lit(float(min_length))).alias("_low"),
        F.least("max_hours", F.lit(float(max_length))).alias("_high"),
    )
    if windows == 1:
        return bounds.select(*by, F.col("_low").alias("window_length"))
    step = (F.col("_high") - F.col("_low")) / F.lit(float(windows - 1))
    number = F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("_number")
    length = F.when(F.col("_number") == windows - 1, F.col("_high")).otherwise(F.col("_low") + F.col("_number") * step)
    return bounds.select("*", number).select(*by, length.alias("window_length"))
