"""Leave out scores during maintenances, and maintenances that were planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import materialise
from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.timeline import Timeline, broadcast_pieces, extent, sweep

# Seconds after a maintenance that are left out as well, and the code of planned ones.
COOL_DOWN = 1800
PLANNED = ("M69",)


def before_last_maintenance(scores: DataFrame, maintenances: DataFrame) -> DataFrame:
    """Keep the scores strictly before the start of the last maintenance.

    The bound is a scalar subquery, so it reaches the scan as a pushed filter.
    """
    last = maintenances.agg(F.max("unix_start"))
    return scores.where(F.col("unix") < last.scalar())


def outside_maintenance(
    scores: DataFrame, maintenances: DataFrame, cool_down: int = COOL_DOWN, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Drop the scores with ``unix_start < unix < unix_end + cool_down`` for any maintenance."""
    closed = maintenances.select(
        (F.col("unix_start") + 1).alias("opens"), (F.col("unix_end") + cool_down).alias("closes")
    )
    closed = materialise(closed.where("opens < closes").groupBy("opens").agg(F.max("closes").alias("closes")))
    rows, start, stop, cuts = extent(closed, "opens", "closes")
    if rows == 0:
        return scores
    buckets = min(limits.buckets, 100 * rows) if rows <= limits.candidates else limits.buckets
    timeline = Timeline.of(start, stop, buckets, cuts)
    if rows <= limits.broadcast_rows:
        cut = broadcast_pieces(_merged(closed), rows, timeline, limits)
        if cut is not None:
            inside = (
                (timeline.bucket(F.col("unix")) == F.col("_bucket"))
                & (F.col("unix") >= F.col("opens"))
                & (F.col("unix") < F.col("closes"))
            )
            return scores.join(cut, inside, "left_anti")
    marks = closed.select(F.col("opens").alias("_at"), F.col("closes").alias("_value"))
    swept = sweep(scores, "unix", marks, timeline, limits, backwards=False, output="_busy_until")
    free = F.col("_busy_until").isNull() | F.col("unix").isNull() | (F.col("unix") >= F.col("_busy_until"))
    return swept.where(free).select(*scores.columns)


def _merged(intervals: DataFrame) -> DataFrame:
    """Overlapping intervals joined into disjoint ones. Only for lists of checked size: one task orders them."""
    in_order = Window.orderBy("opens")
    reached = F.max("closes").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    starts = (F.coalesce(F.col("opens") > reached, F.lit(True))).cast("int")
    return (
        intervals.withColumn("_starts", starts)
        .withColumn("_island", F.sum("_starts").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_island")
        .agg(F.min("opens").alias("opens"), F.max("closes").alias("closes"))
        .drop("_island")
    )


def filter_maintenances(
    scores: DataFrame, maintenances: DataFrame, cool_down: int = COOL_DOWN, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """Scores before the last maintenance and outside all of them."""
    # Read twice below; the list may be the result of a long job.
    maintenances = materialise(maintenances.select("unix_start", "unix_end").distinct())
    return outside_maintenance(before_last_maintenance(scores, maintenances), maintenances, cool_down, limits)


def exclude_planned(maintenances: DataFrame, codes: Sequence[str] = PLANNED) -> DataFrame:
    """Leave out maintenances with a planned code; those without any code stay."""
    return maintenances.where(F.col("maint_id").isNull() | ~F.col("maint_id").isin(*codes))
