"""Running totals and neighbours inside ordered groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import join_null_safe, materialise
from alarmlens.limits import Limits


def along(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    limits: Limits,
    *,
    descending: bool = False,
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add columns that look along ``order`` inside each group of ``by``.

    The mappings go from new to existing column: ``running`` sums up to and with the row,
    ``totals`` over the group, ``previous`` and ``following`` take the
    neighbour's value. ``df`` is read more than once, so hand in a materialised frame, with one
    row per ``by`` and ``order``.

    Groups within ``limits.rows_per_task`` use a plain window. If one is larger, the
    rows are range-partitioned by group and order; each range is walked on its own, and
    what precedes or follows it comes from a summary with one row per range and group.
    """
    running, totals, previous, following = (m or {} for m in (running, totals, previous, following))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    longest, rows = sizes.agg(F.max("_rows"), F.sum("_rows")).first()
    sort = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    if rows is None or longest <= limits.rows_per_task:
        return _within(df, by, sort, running, totals, previous, following)

    ranges = -(-rows // limits.rows_per_task)
    # Written out, so that every later use sees the same rows in the same range.
    cut = materialise(
        df.repartitionByRange(ranges, *[F.col(c) for c in by], *sort).withColumn("_range", F.spark_partition_id())
    )
    keys = [*by, "_range"]
    place = F.struct(*[F.col(c) for c in order])
    first, last = (F.max_by, F.min_by) if descending else (F.min_by, F.max_by)
    sums = sorted({*running.values(), *totals.values()})
    summary = cut.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(c).alias(f"_sum_{c}") for c in sums],
        *[last(c, place).alias(f"_last_{new}") for new, c in previous.items()],
        *[first(c, place).alias(f"_first_{new}") for new, c in following.items()],
    )
    # At most ``ranges`` rows per group.
    group = Window.partitionBy(*by)
    across = group.orderBy("_range")
    summary = summary.select(
        *keys,
        *[
            F.sum(f"_sum_{c}").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_base_{new}")
            for new, c in running.items()
        ],
        *[F.sum(f"_sum_{c}").over(group).alias(new) for new, c in totals.items()],
        *[F.lag(f"_last_{new}").over(across).alias(f"_before_{new}") for new in previous],
        *[F.lead(f"_first_{new}").over(across).alias(f"_after_{new}") for new in following],
    )
    joined = join_null_safe(cut, summary, keys, "left")
    walked = _within(joined, keys, sort, running, {}, previous, following)
    return walked.select(
        *df.columns,
        *[(F.col(new) + F.coalesce(F.col(f"_base_{new}"), F.lit(0))).alias(new) for new in running],
        *totals,
        *[F.coalesce(F.col(new), F.col(f"_before_{new}")).alias(new) for new in previous],
        *[F.coalesce(F.col(new), F.col(f"_after_{new}")).alias(new) for new in following],
    )


def _within(df, by, sort, running, totals, previous, following):
    group = Window.partitionBy(*by)
    ordered = group.orderBy(*sort)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        *[F.sum(c).over(so_far).alias(new) for new, c in running.items()],
        *[F.sum(c).over(group).alias(new) for new, c in totals.items()],
        *[F.lag(c).over(ordered).alias(new) for new, c in previous.items()],
        *[F.lead(c).over(ordered).alias(new) for new, c in following.items()],
    )
