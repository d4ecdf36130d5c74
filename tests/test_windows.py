import naive
import numpy as np
import pytest
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.operators.windows import common_span, common_step, default_grid, whole_seconds

SCHEMA = "algorithm string, unix bigint, score double"


@pytest.fixture(scope="module")
def annotated(spark):
    rows, alarms = naive.series(4)
    frame = spark.createDataFrame([(a,) for a in alarms], "unix bigint")
    return al.next_alarm(spark.createDataFrame(rows, SCHEMA), frame).cache()


@pytest.mark.parametrize("single", [False, True])
@pytest.mark.parametrize("length", [1, 6, 0.5, 1.25, 48])
def test_window_number_and_label(annotated, length, single):
    for row in al.with_window_number(annotated, length, single).collect():
        number = naive.window_no(row.unix, row.next_alarm, length, single)
        assert row.window_no == number
        assert row.label == (number == 0 and row.next_alarm != -1)


def test_edges_of_the_positive_window(spark):
    rows = [("a", 0, 1.0), ("a", 1, 1.0), ("a", 3599, 1.0), ("a", 3600, 1.0)]
    scores = spark.createDataFrame(rows, SCHEMA)
    annotated = al.next_alarm(scores, spark.createDataFrame([(3600,)], "unix bigint"))
    many = {r.unix: (r.window_no, r.label) for r in al.with_window_number(annotated, 1).collect()}
    one = {r.unix: (r.window_no, r.label) for r in al.with_window_number(annotated, 1, True).collect()}
    # A row exactly one length ahead is negative among many windows and positive with a single one.
    assert many == {0: (1, False), 1: (0, True), 3599: (0, True), 3600: (-2, False)}
    assert one == {0: (0, True), 1: (0, True), 3599: (0, True), 3600: (0, False)}


def test_rows_after_the_last_alarm_fall_into_windows_of_the_epoch(spark):
    rows = [("a", u, 1.0) for u in range(10_000, 60_000, 700)]
    annotated = al.next_alarm(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(5,)], "unix bigint"))
    for row in al.with_window_number(annotated, 2).collect():
        assert row.window_no == -1 - row.unix // 7200 and not row.label


def test_every_row_in_one_window_per_length(spark, annotated):
    rows, alarms = naive.series(4)
    frame = spark.createDataFrame([(a,) for a in alarms], "unix bigint")
    scores = spark.createDataFrame([(a, u, 1.0) for a, u, _ in rows], SCHEMA)
    scored = al.score_windows(scores, frame, [1, 6, 48], "ccdf", threshold=0.5)
    assert {r.score for r in scored.collect()} == {1.0}
    for length in (1, 6, 48):
        numbered = al.with_window_number(annotated, length)
        windows = numbered.select("algorithm", "next_alarm", "window_no").distinct().count()
        assert windows == scored.where(F.col("window_length") == length).count()


def test_grids(spark, annotated):
    assert whole_seconds([0.5, 1, 1.25]) == [1800, 3600, 4500] and whole_seconds([0.1234567]) is None
    assert common_step([1800, 3600, 4500]) == 900 and common_span([3600, 7200, 10800]) == 21600
    assert default_grid(annotated).count() == 22
    bounds = {r.algorithm: r for r in al.hours_range(annotated).collect()}
    for n in (1, 2, 5, 13):
        grid = al.even_grid(annotated, n).collect()
        for algorithm, bound in bounds.items():
            low, high = max(bound.min_hours, 1.0), min(bound.max_hours, 48.0)
            ours = sorted(r.window_length for r in grid if r.algorithm == algorithm)
            assert ours == pytest.approx(list(np.linspace(low, high, n)), abs=1e-12)


def test_lengths_have_to_be_positive(spark):
    scores = spark.createDataFrame([("a", 1, 0.5)], "algorithm string, unix long, score double")
    alarms = spark.createDataFrame([(10,)], "unix long")
    for length in (0, -1):
        with pytest.raises(ValueError, match="above 0"):
            al.score_windows(scores, alarms, windows=[length])


def test_rows_without_a_time_are_in_no_window(spark):
    rows = [("a", 1, 0.5), ("a", None, 0.9), ("a", 20_000, 0.1)]
    scores = spark.createDataFrame(rows, "algorithm string, unix long, score double")
    alarms = spark.createDataFrame([(7_000,)], "unix long")
    assert al.score_windows(scores, alarms, windows=[2]).count() == 2
