"""Evaluate anomaly scores against a list of alarms, as Spark DataFrames."""

from alarmlens.limits import DEFAULT_LIMITS, Limits
from alarmlens.operators.alarms import alarm_times, hours_to_alarm, next_alarm
from alarmlens.operators.curves import auc, confusion_by_threshold, roc_points
from alarmlens.operators.maintenance import (
    before_last_maintenance,
    exclude_planned,
    filter_maintenances,
    outside_maintenance,
)
from alarmlens.operators.scoring import global_threshold, score_windows
from alarmlens.operators.windows import even_grid, hours_range, with_window_number
from alarmlens.plans.report import random_baseline, summarise_surface, upsert_summary
from alarmlens.plans.surface import roc_curve, roc_surface, surface_auc

__all__ = [
    "DEFAULT_LIMITS",
    "Limits",
    "alarm_times",
    "auc",
    "before_last_maintenance",
    "confusion_by_threshold",
    "even_grid",
    "exclude_planned",
    "filter_maintenances",
    "global_threshold",
    "hours_range",
    "hours_to_alarm",
    "next_alarm",
    "outside_maintenance",
    "random_baseline",
    "roc_curve",
    "roc_points",
    "roc_surface",
    "score_windows",
    "summarise_surface",
    "surface_auc",
    "upsert_summary",
    "with_window_number",
]
