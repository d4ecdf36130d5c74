"""Joins of points in time with intervals or marks, by time bucket.

A range condition alone gives Spark no key to hash on. Both sides therefore get
the number of a time bucket as equi-key, and the range condition becomes the
residual. The buckets span the intervals only, and follow their density: earlier and later points fall
into the first and last bucket, so the width of the point side does not matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import materialise, spread
from alarmlens.limits import Limits


SEGMENTS = 32  # parts with about equally many marks; the bucket of a time is found by halving among them


@dataclass(frozen=True)
class Timeline:
    """Cuts ``[edges[0], stop]`` into buckets.

    Segments lie between quantiles of the marks, and the buckets of a segment are equally wide. So a single far mark widens the
    buckets of one segment, and no others.
    """

    edges: tuple[int, ...]
    stop: int
    widths: tuple[int, ...]
    firsts: tuple[int, ...]

    @classmethod
    def of(cls, start: int, stop: int, buckets: int, cuts: Sequence[int] = ()) -> Timeline:
        """``cuts``: times that about equally many marks lie between; those outside ``(start, stop]`` count for nothing."""
        edges = sorted({start, *[c for c in cuts if start < c <= stop]})
        spans = [b - a for a, b in zip(edges, [*edges[1:], stop + 1])]
        share = max(1, buckets // len(edges))
        widths = [max(1, -(-span // share)) for span in spans]
        counts = [-(-span // width) for span, width in zip(spans, widths)]
        return cls(tuple(edges), stop, tuple(widths), tuple(accumulate(counts, initial=0))[:-1])

    def bucket(self, time: Column) -> Column:
        start, stop = F.lit(self.edges[0]), F.lit(self.stop)
        inside = F.when(time < start, start).when(time > stop, stop).otherwise(time)

        def segment(low: int, high: int) -> Column:
            if high - low == 1:
                return F.lit(low)
            middle = (low + high) // 2
            return F.when(inside < F.lit(self.edges[middle]), segment(low, middle)).otherwise(segment(middle, high))

        own = segment(0, len(self.edges))
        of_segment = lambda values: F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), own)
        return of_segment(self.firsts) + F.floor((inside - of_segment(self.edges)) / of_segment(self.widths))


def pieces(intervals: DataFrame, timeline: Timeline) -> DataFrame:
    """One row per bucket that an interval ``[opens, closes)`` touches."""
    first, last = timeline.bucket(F.col("opens")), timeline.bucket(F.col("closes") - 1)
    return intervals.withColumn("_bucket", F.explode(F.sequence(first, last)))


def broadcast_pieces(intervals: DataFrame, rows: int, timeline: Timeline, limits: Limits) -> DataFrame | None:
    """The pieces of disjoint intervals if they may be broadcast, else None.

    Disjoint intervals give at most one piece per interval and bucket border.
    Where many of them share a bucket, each point of the bucket would be tried
    against all of them; then None, too.
    """
    if rows > limits.broadcast_rows:
        return None
    cut = pieces(intervals, timeline)
    if rows > limits.candidates:
        fullest = cut.groupBy("_bucket").count().agg(F.max("count")).first()[0]
        if fullest > limits.candidates:
            return None
    return F.broadcast(cut)


def sweep(
    points: DataFrame,
    time: str,
    marks: DataFrame,
    timeline: Timeline,
    limits: Limits,
    *,
    backwards: bool,
    output: str,
) -> DataFrame:
    """Best mark value up to each point, walking along the time axis.

    ``marks`` has ``(_at, _value)``. Forwards, a point gets the greatest value
    of the marks at or before it; backwards, the least value of the marks
    strictly after it. Neither side is broadcast: points and marks are shuffled by bucket and
    sorted by time. A bucket with many points is spread over as many pieces as its
    count asks for, each with a copy of the bucket's own marks; marks of the buckets passed
    before enter as one carried value per bucket.
    """
    best = F.min if backwards else F.max
    points = points.withColumn("_bucket", timeline.bucket(F.col(time)))
    marks = marks.withColumn("_bucket", timeline.bucket(F.col("_at")))

    # One row per bucket: no more than the timeline has buckets (plus one for NULL times),
    # whatever the sizes of the two sides. Hence one task may order them, and they may be broadcast.
    counts = points.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_points"), F.lit(None).cast("bigint").alias("_best"))
    firsts = marks.groupBy("_bucket").agg(F.lit(0).cast("bigint").alias("_points"), best("_value").alias("_best"))
    along = Window.orderBy(F.col("_bucket").desc_nulls_first() if backwards else F.col("_bucket").asc_nulls_first())
    plan = (
        counts.unionByName(firsts)
        .groupBy("_bucket")
        .agg(F.sum("_points").alias("_points"), best("_best").alias("_best"))
        .select(
            F.col("_bucket").alias("_plan_bucket"),
            best("_best").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"),
            F.greatest(F.lit(1), F.ceil(F.col("_points") / F.lit(limits.rows_per_task))).cast("bigint").alias("_pieces"),
        )
    )
    plan = F.broadcast(materialise(plan))
    in_bucket = F.col("_bucket").eqNullSafe(F.col("_plan_bucket"))

    kept = [c for c in points.columns if c != "_bucket"]
    left = points.join(plan, in_bucket, "left").select(
        *kept,
        "_bucket",
        "_carried",
        spread(kept, F.col("_pieces")).alias("_piece"),
        F.col(time).alias("_at"),
        F.lit(None).cast("bigint").alias("_value"),
        F.lit(True).alias("_point"),
    )
    right = marks.join(plan, in_bucket, "left").select(
        "_bucket",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_pieces") - 1)).alias("_piece"),
        "_at",
        "_value",
        F.lit(False).alias("_point"),
    )
    # At the same second a point comes after the marks forwards, before them backwards.
    order = [F.col("_at").desc(), F.col("_point").desc()] if backwards else [F.col("_at").asc(), F.col("_point").asc()]
    walked = Window.partitionBy("_bucket", "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        left.unionByName(right, allowMissingColumns=True)
        .withColumn("_seen", best("_value").over(walked))
        .where("_point")
        .select(*kept, (F.least if backwards else F.greatest)("_seen", "_carried").alias(output))
    )


def extent(df: DataFrame, opens: str, closes: str) -> tuple[int, int | None, int | None, tuple[int, ...]]:
    """Row count, least ``opens``, greatest ``closes`` and quantiles of ``opens``: one row to the driver."""
    shares = F.array(*[F.lit(i / SEGMENTS) for i in range(1, SEGMENTS)])
    cuts = F.percentile_approx(opens, shares, F.lit(10 * SEGMENTS))
    rows, first, last, cuts = df.agg(F.count(F.lit(1)), F.min(opens), F.max(closes), cuts).first()
    return rows, first, last, tuple(cuts or ())
