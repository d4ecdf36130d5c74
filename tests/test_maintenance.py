import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import alarmlens as al

SCHEMA = "algorithm string, unix bigint, score double"
MAINTENANCES = "maint_id string, unix_start bigint, unix_end bigint"
SWEEP = replace(al.DEFAULT_LIMITS, broadcast_rows=0, buckets=9, rows_per_task=25)
DENSE = replace(al.DEFAULT_LIMITS, candidates=1)


@pytest.mark.parametrize("limits", [al.DEFAULT_LIMITS, DENSE, SWEEP], ids=["broadcast", "dense", "sweep"])
@pytest.mark.parametrize("cool_down", [1800, 0])
@pytest.mark.parametrize("seed", range(2))
def test_filter(spark, limits, cool_down, seed):
    source = random.Random(seed)
    intervals = []
    for i in range(14):
        start = source.randrange(200_000)
        intervals.append((f"M{i}", start, start + source.choice([-2000, 0, 600, 5000, 60_000])))
    intervals += intervals[:3]
    times = [source.randrange(-5000, 260_000) for _ in range(300)] + [100] * 40
    for _, start, end in intervals:
        times += [start, start + 1, end + cool_down - 1, end + cool_down]
    rows = [("a", t, float(i)) for i, t in enumerate(times)]
    scores = spark.createDataFrame(rows, SCHEMA)
    maintenances = spark.createDataFrame(intervals, MAINTENANCES)

    def free(t):
        return not any(start < t < end + cool_down for _, start, end in intervals)

    last = max(start for _, start, _ in intervals)
    outside = al.outside_maintenance(scores, maintenances, cool_down, limits)
    assert sorted(map(tuple, outside.collect())) == sorted(r for r in rows if free(r[1]))
    both = al.filter_maintenances(scores, maintenances, cool_down, limits)
    assert sorted(map(tuple, both.collect())) == sorted(r for r in rows if r[1] < last and free(r[1]))


def test_without_maintenances_nothing_is_inside_one(spark):
    scores = spark.createDataFrame([("a", 1, 1.0)], SCHEMA)
    assert al.outside_maintenance(scores, spark.createDataFrame([], MAINTENANCES)).count() == 1


def test_planned(spark):
    rows = [("M69", 1, 2), ("M6", 3, 4), ("P1", 5, 6), (None, 7, 8)]
    maintenances = spark.createDataFrame(rows, MAINTENANCES)
    assert {r.maint_id for r in al.exclude_planned(maintenances).collect()} == {"M6", "P1", None}
    assert {r.maint_id for r in al.exclude_planned(maintenances, ["M6", "P1"]).collect()} == {"M69", None}


def test_last_maintenance_reaches_the_scan(spark, tmp_path):
    spark.range(1000).select(
        F.lit("a").alias("algorithm"), F.col("id").alias("unix"), F.rand(1).alias("score")
    ).write.parquet(f"{tmp_path}/scores")
    maintenances = spark.createDataFrame([("M1", 100, 120), ("M2", 40, 60)], MAINTENANCES)
    kept = al.before_last_maintenance(spark.read.parquet(f"{tmp_path}/scores").select("unix"), maintenances)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(unix), LessThan(unix," in plan
    assert "ReadSchema: struct<unix:bigint>" in plan
    assert kept.count() == 100
