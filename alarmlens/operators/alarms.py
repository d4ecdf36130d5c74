"""The next alarm of each score, and the hours until it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import materialise
from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.timeline import Timeline, broadcast_pieces, extent, sweep

# Fixed value: what stands for "no later alarm".
NO_ALARM = -1


@dataclass(frozen=True)
class Alarms:
    """Distinct alarm times, written out once, with their count, range and quantiles."""

    times: DataFrame
    count: int
    first: int | None
    last: int | None
    cuts: tuple[int, ...] = ()


def alarm_times(alarms: DataFrame | Alarms, time: str | None = None) -> Alarms:
    """Prepare an alarm list in any order, with or without repetitions.

    ``time`` defaults to ``unix_start`` where the frame has it (maintenances), else ``unix``.
    """
    if isinstance(alarms, Alarms):
        return alarms
    if time is None:
        time = "unix_start" if "unix_start" in alarms.columns else "unix"
    times = alarms.select(F.col(time).cast("bigint").alias("alarm")).where("alarm is not null").distinct()
    times = materialise(times)
    return Alarms(times, *extent(times, "alarm", "alarm"))


def next_alarm(scores: DataFrame, alarms: DataFrame | Alarms, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Add ``next_alarm``: the first alarm strictly after ``unix``, or -1.

    The scores are not shuffled as long as the alarm list may be broadcast.
    """
    alarms = alarm_times(alarms)
    if alarms.count == 0:
        return scores.withColumn("next_alarm", F.lit(NO_ALARM).cast("bigint"))

    start = alarms.first - 1
    if alarms.count <= limits.broadcast_rows:
        # 100 buckets per alarm: one bucket rarely holds more than one of them.
        few = alarms.count <= limits.candidates
        timeline = Timeline.of(start, alarms.last, min(limits.buckets, 100 * alarms.count) if few else limits.buckets, alarms.cuts)
        # The list is bounded by the check above, so one task can order it.
        previous = F.lag("alarm").over(Window.orderBy("alarm"))
        gaps = alarms.times.select(
            F.coalesce(previous, F.lit(start)).alias("opens"),
            F.col("alarm").alias("closes"),
            previous.isNull().alias("_first"),
        )
        cut = broadcast_pieces(gaps, alarms.count, timeline, limits)
        if cut is not None:
            kept = scores.columns
            in_gap = (
                (timeline.bucket(F.col("unix")) == F.col("_bucket"))
                & (F.col("_first") | (F.col("unix") >= F.col("opens")))
                & (F.col("unix") < F.col("closes"))
            )
            return scores.join(cut, in_gap, "left").select(*kept, _or_none(F.col("closes")))

    timeline = Timeline.of(start, alarms.last, limits.buckets, alarms.cuts)
    marks = alarms.times.select(F.col("alarm").alias("_at"), F.col("alarm").alias("_value"))
    swept = sweep(scores, "unix", marks, timeline, limits, backwards=True, output="_next")
    return swept.select(*scores.columns, _or_none(F.col("_next")))


def _or_none(alarm: Column) -> Column:
    return F.coalesce(alarm, F.lit(NO_ALARM).cast("bigint")).alias("next_alarm")


def hours_to_alarm() -> Column:
    """``(next_alarm - unix)`` in hours; far below zero where there is no later alarm."""
    return (F.col("next_alarm") - F.col("unix")) / F.lit(3600.0)
