import datetime
import math

import pytest
from pyspark.sql import functions as F

import alarmlens as al
from alarmlens.plans.report import auc_summary
from alarmlens.sinks import writers
from alarmlens.sources import readers

SCORES = "algorithm string, unix bigint, score double"


def lines(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.mark.parametrize("header", [False, True])
def test_formats(spark, tmp_path, header):
    texts = {
        "us": ("unix,scores", "1600000000,0.25\n4000000000,NaN\n"),
        "TLS": ("Timestamp,Label,Score", "1600000000,1.0,0.25\n4000000000,0.0,NaN\n"),
        "TL": ("Timestamp,Score", "1600000000,0.25\n4000000000,NaN\n"),
    }
    for format, (names, body) in texts.items():
        for folder in ("net 1+2", "algorithm=forest"):
            lines(tmp_path / format / folder / "day=2020-09-13" / "part.csv", f"{names}\n{body}" if header else body)
        df = readers.read_scores(spark, f"{tmp_path}/{format}", format, header)
        assert [k for _, k in df.dtypes] == ["string", "bigint", "double"] + ["double"] * (format == "TLS")
        rows = {(r.algorithm, r.unix, r.score) for r in df.collect()}
        assert rows == {(a, u, s) for a in ("net 1+2", "forest") for u, s in ((1600000000, 0.25), (4000000000, None))}
        one = readers.read_scores(spark, f"{tmp_path}/{format}/algorithm=forest/*/*.csv", format, header, algorithm="x")
        assert {r.algorithm for r in one.collect()} == {"x"}
    with pytest.raises(ValueError):
        readers.read_scores(spark, str(tmp_path), "LT")


def test_any_header_line(spark, tmp_path):
    lines(tmp_path / "a" / "day1" / "x.csv", "Timestamp,Label\n10,0.5\n")
    lines(tmp_path / "a" / "day1" / "y.csv", "time;in;seconds\n20,0.25\nbroken,1.0\n")
    rows = readers.read_scores(spark, str(tmp_path), "TL", header=True).collect()
    assert {tuple(r) for r in rows} == {("a", 10, 0.5), ("a", 20, 0.25), ("a", None, 1.0)}


def test_named_folders_alone_are_opened(spark, tmp_path):
    for folder in ("forest", "algorithm=forest", "net [1]", "forest2"):
        for day in ("day=2020-09-13", "2020-09-13", "day7"):
            lines(tmp_path / folder / day / "part.csv", "1600000000,0.25\n")
    chosen = readers.read_scores(spark, str(tmp_path), algorithms=["forest"])
    assert len(chosen.inputFiles()) == 6 and {r.algorithm for r in chosen.collect()} == {"forest"}
    chosen = readers.read_scores(spark, str(tmp_path), algorithms=["forest", "net [1]"], days=["2020-09-13"])
    assert len(chosen.inputFiles()) == 6 and {r.algorithm for r in chosen.collect()} == {"forest", "net [1]"}
    assert len(readers.read_scores(spark, str(tmp_path), days=["day7"]).inputFiles()) == 4
    with pytest.raises(ValueError):
        readers.read_scores(spark, f"{tmp_path}/*/*/*.csv", days=["day7"])


def test_maintenances_in_any_column_order(spark, tmp_path):
    lines(tmp_path / "m.csv", "maint_id,unix_start,unix_end\nM69,10,20\n")
    schema = "maint_id STRING, unix_start BIGINT, unix_end BIGINT"
    assert readers.read_maintenances(spark, f"{tmp_path}/m.csv", schema).collect() == [("M69", 10, 20)]


def test_day_is_the_utc_date(spark):
    seconds = [0, 86_399, 86_400, -1, 1_709_251_199]
    rows = spark.createDataFrame([(s,) for s in seconds], "unix bigint").withColumn("day", writers.day_of(F.col("unix")))
    for row in rows.collect():
        assert row.day == datetime.date(1970, 1, 1) + datetime.timedelta(days=math.floor(row.unix / 86_400))


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_scores_by_day(spark, tmp_path, format):
    rows = [("net 1+2", 10, 0.1), ("net 1+2", 90_000, 0.2), ("7", 10, None)]
    path = f"{tmp_path}/scores"
    writers.write_scores_by_day(spark.createDataFrame(rows, SCORES), path, format)
    stored = readers.read_score_table(spark, path, format)
    assert {(r.algorithm, r.unix, r.score) for r in stored.collect()} == set(rows)
    day = stored.where((F.col("day") == datetime.date(1970, 1, 2)) & (F.col("algorithm") == "net 1+2"))
    assert [r.unix for r in day.collect()] == [90_000]
    assert "PartitionFilters: [isnotnull(day" in day._jdf.queryExecution().executedPlan().toString()
    if format == "csv":
        files = readers.read_scores(spark, path, "us")
        assert {(r.algorithm, r.unix, r.score) for r in files.collect()} == set(rows)


def test_summary_upsert_and_table(spark, tmp_path):
    schema = "algorithm string, window_size double, auc double"
    old = spark.createDataFrame([("a", 6.0, 0.5), ("a", 12.0, 0.6), ("b", 6.0, None)], schema)
    new = spark.createDataFrame([("a", 6.0, 0.9), ("c", 6.0, 0.7)], schema)
    wanted = {("a", 6.0, 0.9), ("a", 12.0, 0.6), ("b", 6.0, None), ("c", 6.0, 0.7)}
    assert set(map(tuple, al.upsert_summary(old, new).collect())) == wanted
    path = f"{tmp_path}/summary"
    writers.write_summary(old, path)
    writers.write_summary(new, path)
    assert set(map(tuple, readers.read_summary(spark, path).collect())) == wanted


def test_a_summary_that_was_not_finished_is_not_seen(spark, tmp_path):
    schema, path = "algorithm string, window_size double, auc double", f"{tmp_path}/summary"
    with pytest.raises(FileNotFoundError):
        readers.read_summary(spark, path)
    for auc in (0.1, 0.2, 0.3):
        writers.write_summary(spark.createDataFrame([("a", 6.0, auc), ("b 1+2", 6.0, None)], schema), path)
    assert len(readers.versions(spark, path)) == 2
    # A writer that died between two files: its folder has rows, but no mark of the end.
    broken = tmp_path / "summary" / "version=000000004"
    spark.createDataFrame([("a", 6.0, 9.9)], schema).write.partitionBy("algorithm").parquet(str(broken))
    (broken / "_SUCCESS").unlink()
    assert {tuple(r) for r in readers.read_summary(spark, path).collect()} == {("a", 6.0, 0.3), ("b 1+2", 6.0, None)}
    writers.write_summary(spark.createDataFrame([("a", 12.0, 0.4)], schema), path)
    expected = {("a", 6.0, 0.3), ("a", 12.0, 0.4), ("b 1+2", 6.0, None)}
    assert {tuple(r) for r in readers.read_summary(spark, path).collect()} == expected
    newest = tmp_path / "summary" / "version=000000004"
    assert sorted(len(list(f.glob("*.parquet"))) for f in newest.glob("algorithm=*")) == [1, 1]


def test_summary_file(spark, tmp_path):
    lines(tmp_path / "summary.csv", "Algorithm,WindowSize,AUC\nforest,6.0,0.75\n")
    summary = readers.read_summary_file(spark, f"{tmp_path}/summary.csv")
    auc = spark.createDataFrame([("forest", 6.0, 0.8), ("net", 6.0, 0.1)], "algorithm string, window_length double, auc double")
    assert set(map(tuple, al.upsert_summary(summary, auc_summary(auc)).collect())) == {("forest", 6.0, 0.8), ("net", 6.0, 0.1)}


def test_curves_of_several_methods_in_one_table(spark, tmp_path):
    windows = spark.createDataFrame(
        [("7", 6.0, 1.0, True), ("7", 6.0, 0.5, False), ("7", 12.0, 0.5, True), ("7", 12.0, 0.7, False)],
        "algorithm string, window_length double, score double, label boolean",
    )
    path, points = f"{tmp_path}/curves", al.roc_points(windows)
    writers.write_curves(points, path)
    writers.write_curves(points.where("window_length = 6").withColumn("fpr", F.lit(1.0)), path, "median", filtered=True)
    # Writing a window length again replaces that window length only.
    writers.write_curves(points.where("window_length = 6").limit(1), path)
    kept = readers.read_curves(spark, path, ("window_length",)).groupBy("window_length").count()
    assert {tuple(r) for r in kept.collect()} == {(12.0, 3), (6.0, 1)}
    other = readers.read_curves(spark, path, method="median", filtered=True).collect()
    assert {(r.algorithm, r.window_length, r.fpr) for r in other} == {("7", 6.0, 1.0)}
    plan = readers.read_curves(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<fpr:double,tpr:double>" in plan

    summary, stored = al.summarise_surface(points), f"{tmp_path}/summary"
    writers.write_surface_summary(summary, stored)
    assert {tuple(r) for r in readers.read_surface_summary(spark, stored).collect()} == {("7", 6.0, 1.0), ("7", 12.0, 0.0)}


def test_a_surface_is_replaced_whole(spark, tmp_path):
    rows = [(a, w, s, s > 0.5) for a in ("x", "y") for w in (2.0, 6.0) for s in (0.2, 0.9)]
    points = al.roc_points(spark.createDataFrame(rows, "algorithm string, window_length double, score double, label boolean"))
    path = f"{tmp_path}/surface"
    writers.write_surface(points, path)
    writers.write_surface(points.where("algorithm = 'x' and window_length = 2").withColumn("window_length", F.lit(3.0)), path)
    kept = readers.read_curves(spark, path).select("algorithm", "window_length").distinct().collect()
    assert {tuple(r) for r in kept} == {("x", 3.0), ("y", 2.0), ("y", 6.0)}
