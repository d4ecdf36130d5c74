from dataclasses import replace

import naive
import pytest
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.operators.timeline import Timeline

SCHEMA = "algorithm string, unix bigint, score double"
SWEEP = replace(al.DEFAULT_LIMITS, broadcast_rows=0, buckets=7, rows_per_task=20)
DENSE = replace(al.DEFAULT_LIMITS, candidates=1)
ROUTES = pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, DENSE, SWEEP], ids=["broadcast", "dense", "sweep"])


def found(df):
    return sorted((r.algorithm, r.unix, r.score, r.next_alarm) for r in df.collect())


def wanted(rows, alarms):
    return sorted((a, u, s, naive.next_alarm(u, alarms)) for a, u, s in rows)


@ROUTES
@pytest.mark.parametrize("seed", range(3))
def test_first_alarm_strictly_later(spark, limits, seed):
    rows, alarms = naive.series(seed)
    scores = spark.createDataFrame(rows, SCHEMA)
    for order in (alarms, sorted(alarms), sorted(alarms, reverse=True)):
        frame = spark.createDataFrame([(a,) for a in order], "unix bigint")
        assert found(al.next_alarm(scores, frame, limits)) == wanted(rows, alarms)


@ROUTES
def test_copies_and_a_hot_second_stay_whole(spark, limits):
    rows = [("a", 1000, 1.0)] * 150 + [("a", 1500, 2.0)] * 30 + [("b", 5000, 1.0)]
    alarms = spark.createDataFrame([(1000,), (1001,), (2000,)], "unix bigint")
    result = al.next_alarm(spark.createDataFrame(rows, SCHEMA), alarms, limits)
    assert found(result) == wanted(rows, [1000, 1001, 2000])


@ROUTES
def test_points_far_from_the_alarms(spark, limits):
    rows = [("a", u, 0.0) for u in (-(10**15), 0, 99, 100, 101, 10**15)]
    alarms = spark.createDataFrame([(100,), (101,)], "unix bigint")
    assert found(al.next_alarm(spark.createDataFrame(rows, SCHEMA), alarms, limits)) == wanted(rows, [100, 101])


@ROUTES
def test_one_alarm_and_rows_without_time(spark, limits):
    rows = [("a", None, 1.0), ("a", 5, 1.0), ("a", 10, 2.0), (None, 3, 1.0)]
    alarms = spark.createDataFrame([(10,), (None,)], "unix bigint")
    result = al.next_alarm(spark.createDataFrame(rows, SCHEMA), alarms, limits).collect()
    assert sorted((str(r.algorithm), str(r.unix), r.next_alarm) for r in result) == [
        ("None", "3", 10), ("a", "10", -1), ("a", "5", 10), ("a", "None", -1),
    ]


def test_no_alarms(spark):
    scores = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    assert al.next_alarm(scores, spark.createDataFrame([], "unix bigint")).first().next_alarm == -1


def test_maintenances_are_alarms_too(spark):
    maintenances = spark.createDataFrame([("M1", 50, 70)], "maint_id string, unix_start bigint, unix_end bigint")
    scores = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    row = al.next_alarm(scores, maintenances).withColumn("hours", al.hours_to_alarm()).first()
    assert (row.next_alarm, row.hours) == (50, 49 / 3600)


def test_scores_are_not_shuffled_under_a_broadcast(spark):
    scores = spark.range(1000).select(
        F.lit("a").alias("algorithm"), (F.col("id") * 60).alias("unix"), F.rand(1).alias("score")
    )
    alarms = spark.range(5).select((F.col("id") * 9000).alias("unix"))
    plan = al.next_alarm(scores, alarms)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan
    assert "hashpartitioning" not in plan


def test_beyond_the_broadcast_nothing_large_is_broadcast(spark):
    rows, alarms = naive.series(1)
    frame = spark.createDataFrame([(a,) for a in alarms], "unix bigint")
    result = al.next_alarm(spark.createDataFrame(rows, SCHEMA), frame, SWEEP)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("far", [253_402_300_799, -(10**12)])
def test_a_far_alarm_leaves_the_scores_where_they_are(spark, far):
    alarms = [3600 * i + i % 7 for i in range(1, 401)] + [far]
    rows = [("a", 500 * i, 1.0) for i in range(-3, 3100)] + [("b", a, 2.0) for a in alarms[::3]] + [("b", far - 1, 0.0), ("b", far, 0.0)]
    result = al.next_alarm(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(a,) for a in alarms], "unix bigint"))
    assert found(result) == wanted(rows, alarms)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_timeline_covers_every_second_once():
    for cuts in ((), (5,), (3, 3, 9, 40), (100, 1000, 10**11)):
        timeline = Timeline.of(2, 10**11, 50, cuts)
        spans = [b - a for a, b in zip(timeline.edges, [*timeline.edges[1:], timeline.stop + 1])]
        assert timeline.edges[0] == 2 and sum(spans) == 10**11 - 1
        last = [first + (span - 1) // width for first, span, width in zip(timeline.firsts, spans, timeline.widths)]
        assert [n + 1 for n in last[:-1]] == list(timeline.firsts[1:]) and last[-1] < 50 + len(spans)
