"""What the physical plans must, and must not, contain."""

import pytest
from pyspark.sql import functions as F

import alarmlens as al


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('plans')}/scores"
    spark.range(5000).select(
        F.concat(F.lit("a"), F.col("id") % 3).alias("algorithm"),
        (F.col("id") * 97).alias("unix"),
        F.rand(2).alias("score"),
        F.lit("x").alias("unused"),
    ).write.parquet(path)
    alarms = spark.range(6).select((F.col("id") * 70_000 + 60_000).alias("unix"))
    return spark.read.parquet(path), al.alarm_times(alarms)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("method", ["mean", "median", "ccdf", "NAB"])
@pytest.mark.parametrize("single", [False, True])
def test_no_python_no_nested_loop_and_pruned_scans(stored, method, single):
    plan = plan_of(al.score_windows(*stored, method=method, single_negative=single))
    assert not any(word in plan for word in ("Python", "Pandas", "NestedLoop", "Cartesian"))
    assert "ReadSchema: struct<algorithm:string,unix:bigint,score:double>" in plan


def test_rows_are_summed_before_the_grid_multiplies_them(stored):
    plan = plan_of(al.score_windows(*stored))
    grid = plan.index("explode([1.0")
    assert plan.index("Exchange hashpartitioning(algorithm", grid) > grid
    assert "_step" in plan[grid:] and plan.count("Exchange hashpartitioning") == 2


def test_medians_shuffle_the_rows_once(stored):
    plan = plan_of(al.score_windows(*stored, method="median"))
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.index("explode([1.0") < plan.index("Exchange hashpartitioning")


def test_weighted_means_need_no_second_pass(stored):
    plan = plan_of(al.score_windows(*stored, method="NAB"))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 2


def test_curves_start_from_written_counts(stored):
    windows = al.score_windows(*stored)
    for df in (al.auc(windows), al.roc_points(windows)):
        plan = plan_of(df)
        assert "ExistingRDD" in plan and "FileScan" not in plan
        assert "SinglePartition" not in plan
