"""Summaries over stored curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.cluster import join_null_safe, materialise
from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.curves import CURVE
from alarmlens.operators.ordered import along


def summarise_surface(points: DataFrame, by: Sequence[str] = CURVE, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """AUC per window length from stored ``(fpr, tpr)`` rows, by the trapezoid rule."""
    # A repeated point adds no area, and one row per point makes the order total.
    distinct = materialise(points.select(*by, "fpr", "tpr").distinct())
    walked = along(distinct, by, ["fpr", "tpr"], limits, previous={"_fpr": "fpr", "_tpr": "tpr"})
    slice_area = (F.col("fpr") - F.col("_fpr")) * (F.col("tpr") + F.col("_tpr")) / F.lit(2.0)
    # A class without any window leaves its rate, and so the area, NULL.
    undefined = F.bool_or(F.col("fpr").isNull() | F.col("tpr").isNull())
    return walked.groupBy(*by).agg(F.when(~undefined, F.sum(slice_area)).alias("auc"))


def random_baseline(points: DataFrame, name: str = "random") -> DataFrame:
    """Add the diagonal ``(0,0), (1,1)`` as one more algorithm for every window length."""
    ends = F.explode(F.array(F.lit(0.0), F.lit(1.0))).alias("fpr")
    diagonal = points.select("window_length").distinct().select(F.lit(name).alias("algorithm"), "window_length", ends)
    diagonal = diagonal.withColumn("tpr", F.col("fpr"))
    return points.select("algorithm", "window_length", "fpr", "tpr").unionByName(diagonal)


SUMMARY_KEY = ("algorithm", "window_size")


def auc_summary(auc: DataFrame) -> DataFrame:
    """The rows of the summary table from an AUC frame."""
    return auc.select("algorithm", F.col("window_length").alias("window_size"), "auc")


def upsert_summary(summary: DataFrame, new: DataFrame, key: Sequence[str] = SUMMARY_KEY) -> DataFrame:
    """The summary with the rows of ``new`` inserted, or put in place of those with the same key."""
    columns = [*key, "auc"]
    kept = join_null_safe(summary, new.select(*key), key, "left_anti")
    return kept.select(*columns).unionByName(new.select(*columns))
