import random
from dataclasses import replace

import naive
import pytest
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.plans.surface import evaluate

WINDOWS = "algorithm string, window_length double, score double, label boolean"
RANGES = replace(al.DEFAULT_LIMITS, rows_per_task=7)
ROUTES = pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, RANGES], ids=["window", "ranges"])
MEASURES = ("point_no", "threshold", "tp", "fp", "fpr", "tpr", "precision", "recall", "f1")


@pytest.fixture(scope="module")
def groups():
    source = random.Random(11)
    made = {
        ("ties", 1.0): [(float(source.randrange(6)), source.random() < 0.4) for _ in range(80)],
        ("spread", 6.0): [(source.random() + 0.3 * yes, yes) for yes in (source.random() < 0.3 for _ in range(60))],
        ("perfect", 6.0): [(float(i), i >= 15) for i in range(30)],
        ("one", 2.0): [(1.0, True), (1.0, False)],
        ("no positive", 1.0): [(float(i), False) for i in range(5)],
        ("no negative", 1.0): [(float(i), True) for i in range(5)],
        (None, 1.0): [(2.0, True), (1.0, False), (3.0, False)],
    }
    return made


@pytest.fixture(scope="module")
def windows(spark, groups):
    return spark.createDataFrame([(*key, *row) for key, rows in groups.items() for row in rows], WINDOWS).cache()


def per_group(df, *columns):
    found = {}
    for row in df.collect():
        found.setdefault((row.algorithm, row.window_length), []).append(tuple(row[c] for c in columns))
    return {key: sorted(rows, key=lambda r: (r[0] is not None, r[0])) for key, rows in found.items()}


@ROUTES
def test_all_points(windows, groups, limits):
    found = per_group(al.roc_points(windows, drop_intermediate=False, limits=limits), *MEASURES)
    assert found == {key: naive.points(rows) for key, rows in groups.items()}


@ROUTES
def test_points_without_those_on_a_line(windows, groups, limits):
    found = per_group(al.roc_points(windows, limits=limits), *MEASURES)
    for key, rows in groups.items():
        full = naive.points(rows)
        wanted = [
            p for i, p in enumerate(full)
            if i in (0, 1, len(full) - 1)
            or full[i + 1][2] - p[2] != p[2] - full[i - 1][2]
            or full[i + 1][3] - p[3] != p[3] - full[i - 1][3]
        ]
        assert found[key] == wanted


@ROUTES
def test_auc_is_the_share_of_pairs_in_order(windows, groups, limits):
    found = {key: rows[0][0] for key, rows in per_group(al.auc(windows, limits=limits), "auc").items()}
    assert found == {key: pytest.approx(naive.auc(rows)) if naive.auc(rows) is not None else None for key, rows in groups.items()}


@ROUTES
def test_confusion(windows, groups, limits):
    found = per_group(al.confusion_by_threshold(windows, limits=limits), "point_no", "tp", "fp", "positives", "negatives")
    for key, rows in groups.items():
        last = found[key][-1]
        assert last[1:] == (last[3], last[4], last[3], last[4])
        assert [r[:3] for r in found[key]] == [(p[0], p[2], p[3]) for p in naive.points(rows)[1:]]


@ROUTES
def test_summary_of_stored_points(windows, groups, limits):
    for drop in (False, True):
        points = al.roc_points(windows, drop_intermediate=drop)
        found = per_group(al.summarise_surface(points, limits=limits), "auc")
        for key, rows in groups.items():
            wanted = naive.auc(rows)
            assert found[key] == [(None if wanted is None else pytest.approx(wanted),)]


def test_random_baseline(windows):
    groups = windows.select("algorithm", "window_length").distinct().count()
    lines = per_group(al.random_baseline(al.roc_points(windows).fillna(-1.0, ["fpr", "tpr"])), "fpr", "tpr")
    assert all(lines["random", length] == [(0.0, 0.0), (1.0, 1.0)] for length in (1.0, 2.0, 6.0))
    assert len(lines) == groups + 3


# The hourly series of the survey's golden numbers: 300 hours and 15 alarms.
ALARM_HOURS = (9, 47, 70, 87, 88, 117, 172, 192, 193, 195, 211, 242, 251, 277, 292)
START = 1_577_836_800


@pytest.fixture(scope="module")
def hourly(spark):
    source = random.Random(0)
    rows = [("test", START + 3600 * h, float(source.random() < 0.1)) for h in range(300)]
    alarms = [(START + 3600 * h,) for h in reversed(ALARM_HOURS)]
    scores = spark.createDataFrame(rows, "algorithm string, unix bigint, score double")
    return rows, scores, spark.createDataFrame(alarms, "unix bigint")


@pytest.mark.parametrize("length, windows, positives", [(6, 59, 15), (2, 160, 15), (1, 300, 0)])
def test_hourly_series(hourly, length, windows, positives):
    _, scores, alarms = hourly
    row = al.surface_auc(scores, alarms, [length]).first()
    assert (row.positives + row.negatives, row.positives) == (windows, positives)
    assert (row.auc is None) == (positives == 0)


@pytest.mark.parametrize("single", [False, True])
def test_surface_against_definitions(hourly, single):
    rows, scores, alarms = hourly
    lengths = [2, 6, 24, 48]
    points, areas = evaluate(scores, alarms, lengths, single_negative=single, drop_intermediate=False)
    points, areas = per_group(points, *MEASURES), per_group(areas, "auc")
    times = [START + 3600 * h for h in ALARM_HOURS]
    labelled = {}
    for key, members in naive.windows(rows, times, lengths, single).items():
        labelled.setdefault(key[:2], []).append((naive.mean([s for _, s in members]), naive.label(key)))
    for key, pairs in labelled.items():
        assert areas[key][0][0] == pytest.approx(naive.auc(pairs))
        for ours, wanted in zip(points[key], naive.points(pairs), strict=True):
            assert ours[0] == wanted[0] and ours[2:] == wanted[2:]
            assert ours[1] == (None if wanted[1] is None else pytest.approx(wanted[1], abs=1e-11))


def test_one_window_of_the_surface_is_the_curve(hourly):
    _, scores, alarms = hourly
    for method in ("mean", "median", "NAB", "ccdf"):
        curve = per_group(al.roc_curve(scores, alarms, 6, method), *MEASURES)
        surface = per_group(al.roc_surface(scores, alarms, [2, 6], method, threshold=0.95), *MEASURES)
        assert curve["test", 6.0] == surface["test", 6.0]


def test_order_and_repeated_alarms_change_nothing(hourly):
    _, scores, alarms = hourly
    once = al.surface_auc(scores, alarms).orderBy("window_length").collect()
    again = al.surface_auc(scores.orderBy("score"), alarms.union(alarms).orderBy("unix")).orderBy("window_length")
    assert again.collect() == once
