"""One query per operator, each over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.cluster import scratch_path
from alarmlens.operators.windows import default_grid
from alarmlens.plans.report import auc_summary
from alarmlens.sinks import writers
from alarmlens.sources import readers
from catalogue import views

Query = Callable[[SparkSession, str], DataFrame]

DAILY_GRID = (24, 48, 168, 720)
FRACTIONAL_GRID = (0.7, 1.3, 5.9)
IRREGULAR_GRID = (0.142857, 0.77777, 2.5, 7.00001)  # no whole seconds
CCDF_THRESHOLD = 50.0
PLANNED = ("M7",)
CURVE_COLUMNS = (
    "algorithm", "window_length", "point_no", "threshold", "tp", "fp", "fpr", "tpr", "precision", "recall", "f1",
)

# The ways past the limits, taken on small tables.
NO_BROADCAST = replace(al.DEFAULT_LIMITS, broadcast_rows=0, buckets=64, rows_per_task=500, salts=4)
SHORT_TASKS = replace(al.DEFAULT_LIMITS, rows_per_task=200)


def events(spark, folder):
    return views.scores(spark, folder), views.alarms(spark, folder)


def daily(spark, folder):
    return views.daily_scores(spark, folder), views.daily_alarms(spark, folder)


def _next_alarm(source, limits=al.DEFAULT_LIMITS) -> Query:
    def query(spark, folder):
        return al.next_alarm(*source(spark, folder), limits).withColumn("hours_to_alarm", al.hours_to_alarm())

    return query


FAR = 253_402_300_799  # the last second of the year 9999


def _with_far_alarm(spark, folder):
    scores, alarms = events(spark, folder)
    return scores, alarms.unionByName(spark.range(1).select(F.lit(FAR).cast("bigint").alias("unix")))


def _filter_open(spark, folder):
    """One more maintenance, a day after the last one, that never ends."""
    known = views.maintenances(spark, folder)
    opened = known.agg((F.max("unix_start") + 86_400).alias("unix_start")).select(
        F.lit("open").alias("maint_id"), "unix_start", F.lit(FAR).cast("bigint").alias("unix_end")
    )
    return al.outside_maintenance(views.scores(spark, folder), known.unionByName(opened))


def _window_number(source, length, single) -> Query:
    def query(spark, folder):
        return al.with_window_number(al.next_alarm(*source(spark, folder)), length, single)

    return query


def _scored(method, digits=None, source=events, grid=None, **options) -> Query:
    def query(spark, folder):
        chosen = {} if grid is None else {"windows": grid}
        scored = al.score_windows(*source(spark, folder), method=method, **chosen, **options)
        return scored if digits is None else scored.withColumn("score", F.round("score", digits))

    return query


def _ccdf_global(spark, folder):
    scores, alarms = events(spark, folder)
    threshold = al.global_threshold(scores, exact=True)
    return al.score_windows(scores, alarms, method="ccdf", threshold=threshold)


def _surface(method="mean", source=events, grid=None, **options) -> Query:
    def query(spark, folder):
        chosen = {} if grid is None else {"windows": grid}
        return al.surface_auc(*source(spark, folder), method=method, **chosen, **options)

    return query


def _surface_ccdf_global(spark, folder):
    scores, alarms = events(spark, folder)
    return al.surface_auc(scores, alarms, method="ccdf", threshold=al.global_threshold(scores, exact=True))


def _even_grid(spark, folder):
    return al.even_grid(al.next_alarm(*events(spark, folder)), 5)


def _surface_even(spark, folder):
    scores, alarms = events(spark, folder)
    alarms = al.alarm_times(alarms)
    return al.surface_auc(scores, alarms, al.even_grid(al.next_alarm(scores, alarms), 5))


def _surface_filtered(spark, folder):
    """Maintenance rows left out, planned maintenances raise no alarm."""
    maintenances = views.maintenances(spark, folder)
    scores = al.filter_maintenances(views.scores(spark, folder), maintenances)
    return al.surface_auc(scores, al.exclude_planned(maintenances, PLANNED))


def _filter(operator, **options) -> Query:
    def query(spark, folder):
        return operator(views.scores(spark, folder), views.maintenances(spark, folder), **options)

    return query


def _points(columns=CURVE_COLUMNS, grid=None, **options) -> Query:
    def query(spark, folder):
        chosen = {} if grid is None else {"windows": grid}
        return al.roc_surface(*events(spark, folder), **chosen, **options).select(*columns)

    return query


def _curve(spark, folder, digits=None, **options):
    curve = al.roc_curve(*events(spark, folder), **options).select(*CURVE_COLUMNS)
    return curve if digits is None else curve.withColumn("threshold", F.round("threshold", digits))


def _times(factor: float):
    """All scores multiplied; no curve depends on that."""

    def source(spark, folder):
        scores, alarms = events(spark, folder)
        return scores.withColumn("score", F.col("score") * F.lit(factor)), alarms

    return source


def _with_missing_times(spark, folder):
    """All scores, and all of them once more without their time."""
    scores, alarms = events(spark, folder)
    return scores.unionByName(scores.withColumn("unix", F.lit(None).cast("bigint"))), alarms


def _daily_points(spark, folder):
    return al.roc_surface(*daily(spark, folder), DAILY_GRID).select(*CURVE_COLUMNS)


def _confusion(spark, folder, limits=al.DEFAULT_LIMITS):
    return al.confusion_by_threshold(al.score_windows(*events(spark, folder)), limits=limits)


def _auc(spark, folder, limits=al.DEFAULT_LIMITS):
    return al.auc(al.score_windows(*events(spark, folder)), limits=limits)


def _read_format(format, header, names=None) -> Query:
    def query(spark, folder):
        """Write the scores as score files of the format, one folder per algorithm and day, and read them."""
        columns = {
            "us": ["unix", "score"],
            "TLS": ["unix", F.when(F.col("score") > 100, 1.0).otherwise(0.0).alias("label"), "score"],
            "TL": ["unix", "score"],
        }[format]
        path = scratch_path(spark, f"files-{format}")
        files = views.scores(spark, folder).select(
            "algorithm", writers.day_of(F.col("unix")).alias("day"), *columns
        )
        own = names or readers.FORMATS[format][0].replace(",", "").split(" ")[::2]
        files = files.toDF("algorithm", "day", *own).hint("rebalance", "algorithm", "day")
        files.write.partitionBy("algorithm", "day").option("header", header).csv(path)
        return readers.read_scores(spark, path, format, header)

    return query


def _read_days(spark, folder):
    """The files of two algorithms and two days out of all that are written."""
    path = scratch_path(spark, "days")
    writers.write_scores_by_day(views.scores(spark, folder), path, "csv")
    return readers.read_scores(spark, path, algorithms=["click", "view"], days=["2024-01-05", "2024-01-20"])


def _read_maintenances(spark, folder):
    path = scratch_path(spark, "maintenances")
    columns = ["unix_start", "unix_end", "maint_id"]
    views.maintenances(spark, folder).select(*columns).write.option("header", True).csv(path)
    return readers.read_maintenances(spark, path)


def _scores_by_day(spark, folder, format="parquet"):
    path = scratch_path(spark, "scores-by-day")
    kept = al.filter_maintenances(views.scores(spark, folder), views.maintenances(spark, folder))
    writers.write_scores_by_day(kept, path, format)
    return readers.read_score_table(spark, path, format)


def _stored_curves(grid) -> Query:
    def query(spark, folder):
        path = scratch_path(spark, "curves")
        points = al.roc_surface(*events(spark, folder), grid)
        writers.write_curves(points, path)
        return readers.read_curves(spark, path, CURVE_COLUMNS[1:])

    return query


def _surface_rewrite(spark, folder):
    """A surface on the default grid, replaced by one on an even grid."""
    path = scratch_path(spark, "surface")
    scores, alarms = events(spark, folder)
    alarms = al.alarm_times(alarms)
    writers.write_surface(al.roc_surface(scores, alarms), path)
    even = al.even_grid(al.next_alarm(scores, alarms), 5)
    writers.write_surface(al.roc_surface(scores, alarms, even), path)
    return readers.read_curves(spark, path, CURVE_COLUMNS[1:])


def _curve_beside_surface(spark, folder):
    """A surface, read back after a single curve of another method has been stored."""
    surface, curves = scratch_path(spark, "surface"), scratch_path(spark, "curves")
    source = events(spark, folder)
    writers.write_surface(al.roc_surface(*source), surface)
    writers.write_curves(al.roc_curve(*source, method="ccdf", threshold=CCDF_THRESHOLD), curves)
    return readers.read_curves(spark, surface, CURVE_COLUMNS[1:])


def _summarise_surface(spark, folder):
    path, summary_path = scratch_path(spark, "curves"), scratch_path(spark, "curve-summary")
    writers.write_curves(al.roc_surface(*events(spark, folder)), path)
    summary = al.summarise_surface(readers.read_curves(spark, path))
    writers.write_surface_summary(summary, summary_path)
    return readers.read_surface_summary(spark, summary_path).withColumn("auc", F.round("auc", 6))


def _random_baseline(spark, folder):
    return al.random_baseline(al.roc_curve(*events(spark, folder)))


def _summary_upsert(spark, folder):
    """Mean AUCs are stored; those of 6 h and more then give way to the median's."""
    scores, alarms = events(spark, folder)
    alarms = al.alarm_times(alarms)
    old = auc_summary(al.surface_auc(scores, alarms))
    new = auc_summary(al.surface_auc(scores, alarms, [6, 12, 72], "median"))
    return al.upsert_summary(old, new)


def _summary_table(spark, folder):
    """The same through the stored table, of which only the new keys' folders are rewritten."""
    path = scratch_path(spark, "summary")
    scores, alarms = events(spark, folder)
    alarms = al.alarm_times(alarms)
    writers.write_summary(auc_summary(al.surface_auc(scores, alarms)), path)
    writers.write_summary(auc_summary(al.surface_auc(scores, alarms, [6, 12, 72], "median")), path)
    return readers.read_summary(spark, path)


def _summary_csv(spark, folder):
    """The same with the first summary in a CSV file."""
    scores, alarms = events(spark, folder)
    alarms, path = al.alarm_times(alarms), scratch_path(spark, "summary-file")
    writers.write_summary_file(auc_summary(al.surface_auc(scores, alarms)), path)
    new = auc_summary(al.surface_auc(scores, alarms, [6, 12, 72], "median"))
    return al.upsert_summary(readers.read_summary_file(spark, path), new)


QUERIES: dict[str, Query] = {
    # next alarm, window number
    "next_alarm": _next_alarm(events),
    "next_alarm_dense": _next_alarm(daily),
    "next_alarm_far": _next_alarm(_with_far_alarm),
    "next_alarm_sweep": _next_alarm(events, NO_BROADCAST),
    "next_alarm_dense_sweep": _next_alarm(daily, NO_BROADCAST),
    "window_no_multi": _window_number(events, 6, False),
    "window_no_single": _window_number(events, 6, True),
    "window_no_multi_daily": _window_number(daily, 24, False),
    "window_no_single_daily": _window_number(daily, 24, True),
    "window_grid_default": lambda spark, folder: default_grid(views.scores(spark, folder)),
    "hours_range": lambda spark, folder: al.hours_range(al.next_alarm(*events(spark, folder))),
    "window_grid_even": _even_grid,
    # window scores
    "score_mean": _scored("mean"),
    "score_mean_single": _scored("mean", single_negative=True),
    "score_mean_daily": _scored("mean", source=daily, grid=DAILY_GRID),
    "score_mean_direct": _scored("mean", roll_up=False),
    "score_median": _scored("median"),
    "score_median_single": _scored("median", single_negative=True),
    "score_median_ranked": _scored("median", limits=SHORT_TASKS),
    "score_ccdf": _scored("ccdf", threshold=CCDF_THRESHOLD),
    "score_ccdf_global": _ccdf_global,
    "global_threshold": lambda spark, folder: al.global_threshold(views.scores(spark, folder), exact=True).withColumn(
        "threshold", F.round("threshold", 6)
    ),
    "score_nab_alarm": _scored("NAB", 6),
    "score_nab_global": _scored("NAB", 6, nab_total="global"),
    "score_nab_single": _scored("NAB", 6, single_negative=True),
    "score_nab_single_clamped": _scored("NAB", 6, single_negative=True, nab_saturated=False),
    "score_revert": _scored("mean", revert=True),
    # curves
    "confusion_by_threshold": _confusion,
    "confusion_by_threshold_ranges": partial(_confusion, limits=SHORT_TASKS),
    "roc_points": _points(drop_intermediate=False),
    "roc_points_reduced": _points(),
    "roc_points_reduced_daily": _daily_points,
    "auc": _auc,
    "auc_bucketed": partial(_auc, limits=SHORT_TASKS),
    "precision_recall_f1": _points(
        ("algorithm", "window_length", "point_no", "threshold", "precision", "recall", "f1"), drop_intermediate=False
    ),
    # surfaces
    "roc_curve_6h": _curve,
    "roc_curve_median": partial(_curve, method="median"),
    "roc_curve_nab": partial(_curve, method="NAB", digits=6),
    "roc_curve_ccdf": partial(_curve, method="ccdf"),
    "roc_curve_single": partial(_curve, single_negative=True),
    "roc_surface": _points(),
    "surface_auc": _surface(),
    "surface_auc_missing_times": _surface(source=_with_missing_times),
    "surface_auc_single": _surface(single_negative=True),
    "surface_auc_tiny": _surface(source=_times(1e-15)),
    "surface_auc_huge": _surface(source=_times(1e15)),
    "surface_auc_rollup": _surface(roll_up=True, grid=[0.5, 1, 1.5, 6]),
    "surface_auc_median": _surface("median"),
    "surface_auc_ccdf": _surface("ccdf", threshold=CCDF_THRESHOLD),
    "surface_auc_ccdf_global": _surface_ccdf_global,
    "surface_auc_ccdf_default": _surface("ccdf"),
    "surface_auc_nab_alarm": _surface("NAB"),
    "surface_auc_nab_global": _surface("NAB", nab_total="global"),
    "surface_auc_nab_single": _surface("NAB", single_negative=True),
    "surface_auc_revert": _surface(revert=True),
    "surface_auc_even": _surface_even,
    "surface_auc_fractional": _surface(grid=FRACTIONAL_GRID),
    "surface_auc_irregular": _surface(grid=IRREGULAR_GRID),
    "surface_auc_irregular_ccdf": _surface("ccdf", threshold=CCDF_THRESHOLD, grid=IRREGULAR_GRID),
    "score_mean_irregular_single": _scored("mean", grid=IRREGULAR_GRID, single_negative=True),
    "surface_auc_daily": _surface(source=daily, grid=DAILY_GRID),
    "surface_auc_single_daily": _surface(source=daily, grid=DAILY_GRID, single_negative=True),
    "surface_auc_filtered": _surface_filtered,
    # maintenances
    "filter_before_last": _filter(al.before_last_maintenance),
    "filter_cooldown": _filter(al.outside_maintenance),
    "filter_cooldown_open": _filter_open,
    "filter_cooldown_sweep": _filter(al.outside_maintenance, limits=NO_BROADCAST),
    "filter_maintenances": _filter(al.filter_maintenances),
    "exclude_planned": lambda spark, folder: al.exclude_planned(views.maintenances(spark, folder), PLANNED),
    # sources, sinks, reports
    "read_format_us": _read_format("us", False),
    "read_format_tls": _read_format("TLS", True),
    "read_format_tl": _read_format("TL", True),
    "read_format_us_header": _read_format("us", True, ["when", "value"]),
    "read_format_tl_label": _read_format("TL", True, ["Timestamp", "Label"]),
    "read_format_days": _read_days,
    "read_maintenances": _read_maintenances,
    "scores_by_day": _scores_by_day,
    "scores_by_day_csv": partial(_scores_by_day, format="csv"),
    "curve_table": _stored_curves([6]),
    "surface_table": _stored_curves(al.operators.windows.DEFAULT_GRID),
    "surface_rewrite": _surface_rewrite,
    "curve_beside_surface": _curve_beside_surface,
    "summarise_surface": _summarise_surface,
    "random_baseline": _random_baseline,
    "summary_upsert": _summary_upsert,
    "summary_table": _summary_table,
    "summary_csv": _summary_csv,
}
