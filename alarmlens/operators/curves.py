"""ROC curves, AUC, precision, recall and F1 from scored, labelled windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.cluster import materialise
from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.ordered import along

CURVE = ("algorithm", "window_length")


def threshold_counts(windows: DataFrame, by: Sequence[str] = CURVE) -> DataFrame:
    """Positive and negative windows per distinct score, written out once.

    This is all that any curve needs, and far smaller than the scores. The score
    is part of the key, so a large curve is spread over many tasks.
    """
    positive = F.col("label").cast("bigint")
    counts = windows.groupBy(*by, F.col("score").alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    return materialise(counts)


def confusion_by_threshold(
    windows: DataFrame, by: Sequence[str] = CURVE, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """True and false positives when all windows scoring at least the threshold are called anomalous."""
    return _confusion(threshold_counts(windows, by), by, limits).select(
        *by, "point_no", "threshold", "tp", "fp", "positives", "negatives"
    )


def _confusion(counts, by, limits):
    return along(
        counts.withColumn("_one", F.lit(1).cast("bigint")),
        by,
        ["threshold"],
        limits,
        descending=True,
        running={"tp": "pos", "fp": "neg", "point_no": "_one"},
        totals={"positives": "pos", "negatives": "neg"},
        following={"_next_pos": "pos", "_next_neg": "neg"},
    )


def roc_points(
    windows: DataFrame,
    by: Sequence[str] = CURVE,
    *,
    drop_intermediate: bool = True,
    limits: Limits = DEFAULT_LIMITS,
) -> DataFrame:
    """The curve with all its measures, one aligned row per threshold.

    ``point_no`` numbers the thresholds downwards; 0 is the origin, which has no threshold.
    ``drop_intermediate`` leaves out points on a straight line between their neighbours. Rates
    over an empty class are NULL.
    """
    return points_of(threshold_counts(windows, by), by, drop_intermediate=drop_intermediate, limits=limits)


def points_of(
    counts: DataFrame, by: Sequence[str], *, drop_intermediate: bool, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """``roc_points`` from materialised threshold counts."""
    points = _confusion(counts, by, limits)
    if drop_intermediate:
        ends = (F.col("point_no") == 1) | F.col("_next_pos").isNull()
        bends = (F.col("_next_pos") != F.col("pos")) | (F.col("_next_neg") != F.col("neg"))
        points = points.where(ends | bends)
    columns = [*by, "point_no", "threshold", "tp", "fp", "positives", "negatives"]
    zero = F.lit(0).cast("bigint")
    origin = counts.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    origin = origin.select(
        *by,
        zero.alias("point_no"),
        F.lit(None).cast("double").alias("threshold"),
        zero.alias("tp"),
        zero.alias("fp"),
        "positives",
        "negatives",
    )
    called = F.col("tp") + F.col("fp")
    return (
        points.select(*columns)
        .unionByName(origin)
        .select(
            *by,
            "point_no",
            "threshold",
            "tp",
            "fp",
            _share(F.col("fp"), F.col("negatives")).alias("fpr"),
            _share(F.col("tp"), F.col("positives")).alias("tpr"),
            F.coalesce(_share(F.col("tp"), called), F.lit(0.0)).alias("precision"),
            _share(F.col("tp"), F.col("positives")).alias("recall"),
            F.coalesce(_share(2 * F.col("tp"), called + F.col("positives")), F.lit(0.0)).alias("f1"),
        )
    )


def auc(windows: DataFrame, by: Sequence[str] = CURVE, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Area under the curve; NULL where there are no positives or no negatives."""
    return auc_of(threshold_counts(windows, by), by, limits)


def auc_of(counts: DataFrame, by: Sequence[str], limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """``auc`` from materialised threshold counts: whole trapezoids, one division at the end."""
    walked = along(counts, by, ["threshold"], limits, descending=True, running={"tp": "pos"})
    twice = F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos")))
    return (
        walked.groupBy(*by)
        .agg(twice.alias("_twice"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
        .select(
            *by,
            _share(F.col("_twice"), 2 * F.col("positives") * F.col("negatives")).alias("auc"),
            "positives",
            "negatives",
        )
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)
