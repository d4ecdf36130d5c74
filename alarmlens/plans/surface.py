"""From scores and alarms to curves: for one window length, or a grid of them in one job."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.alarms import Alarms
from alarmlens.operators.curves import auc_of, points_of, threshold_counts
from alarmlens.operators.scoring import CURVE_THRESHOLD, score_windows
from alarmlens.operators.windows import BY, DEFAULT_GRID


class Evaluation(NamedTuple):
    points: DataFrame
    auc: DataFrame


def evaluate(
    scores: DataFrame,
    alarms: DataFrame | Alarms,
    windows: Sequence[float] | DataFrame = DEFAULT_GRID,
    method: str = "mean",
    *,
    drop_intermediate: bool = True,
    by: Sequence[str] = BY,
    limits: Limits = DEFAULT_LIMITS,
    **options,
) -> Evaluation:
    """Curve points and AUC of all window lengths from a single pass over the scores.

    ``options`` are those of ``score_windows``.
    """
    counts, key = _counts(scores, alarms, windows, method, by, limits, options)
    return Evaluation(
        points_of(counts, key, drop_intermediate=drop_intermediate, limits=limits), auc_of(counts, key, limits)
    )


def roc_surface(
    scores: DataFrame,
    alarms: DataFrame | Alarms,
    windows: Sequence[float] | DataFrame = DEFAULT_GRID,
    method: str = "mean",
    *,
    drop_intermediate: bool = True,
    by: Sequence[str] = BY,
    limits: Limits = DEFAULT_LIMITS,
    **options,
) -> DataFrame:
    """The curve points of every window length."""
    counts, key = _counts(scores, alarms, windows, method, by, limits, options)
    return points_of(counts, key, drop_intermediate=drop_intermediate, limits=limits)


def surface_auc(
    scores: DataFrame,
    alarms: DataFrame | Alarms,
    windows: Sequence[float] | DataFrame = DEFAULT_GRID,
    method: str = "mean",
    *,
    by: Sequence[str] = BY,
    limits: Limits = DEFAULT_LIMITS,
    **options,
) -> DataFrame:
    """The AUC of every window length."""
    counts, key = _counts(scores, alarms, windows, method, by, limits, options)
    return auc_of(counts, key, limits)


def roc_curve(
    scores: DataFrame, alarms: DataFrame | Alarms, window_length: float = 6, method: str = "mean", **options
) -> DataFrame:
    """The curve points of one window length; ``ccdf`` counts scores above 0.95 unless told otherwise."""
    options.setdefault("threshold", CURVE_THRESHOLD)
    return roc_surface(scores, alarms, [window_length], method, **options)


def _counts(scores, alarms, windows, method, by, limits, options):
    scored = score_windows(scores, alarms, windows, method, by=by, limits=limits, **options)
    key = [*by, "window_length"]
    return threshold_counts(scored, key), key
