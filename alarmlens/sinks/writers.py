"""Write filtered scores, curves and summaries as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alarmlens.cluster import delete_folder, materialise
from alarmlens.plans.report import SUMMARY_KEY, upsert_summary
from alarmlens.sources.readers import read_summary, versions

SECONDS_PER_DAY = 86_400


def day_of(unix: Column) -> Column:
    """The UTC date of an epoch second, whatever the time zone of the session."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(unix / F.lit(SECONDS_PER_DAY)).cast("int"))


def write_scores_by_day(scores: DataFrame, path: str, format: str = "parquet", header: bool = False) -> None:
    """``(unix, score)`` files in ``algorithm=<name>/day=<date>/``."""
    by_day = scores.select("algorithm", "unix", "score", day_of(F.col("unix")).alias("day"))
    writer = _gathered(by_day, "algorithm", "day").write.mode("overwrite").format(format)
    if format == "csv":
        writer = writer.option("header", header)
    writer.partitionBy("algorithm", "day").save(path)


def write_curves(points: DataFrame, path: str, method: str = "mean", filtered: bool = False) -> None:
    """Curve or surface rows, in folders by method, filtering, algorithm and window length.

    Only the folders that ``points`` has rows for are replaced.
    """
    tagged = points.withColumns({"agg_method": F.lit(method), "filtered": F.lit(filtered)})
    _replace(tagged, path, "agg_method", "filtered", "algorithm", "window_length")


def write_surface(points: DataFrame, path: str, method: str = "mean", filtered: bool = False) -> None:
    """The rows of a surface, in folders by method, filtering and algorithm.

    An algorithm's surface is replaced whole, so no window length of an earlier run stays beside those of ``points``; surfaces of
    algorithms that ``points`` does not have stay. Keep it in another folder than single curves.
    """
    tagged = points.withColumns({"agg_method": F.lit(method), "filtered": F.lit(filtered)})
    _replace(tagged, path, "agg_method", "filtered", "algorithm")


def write_summary(auc: DataFrame, path: str) -> None:
    """Insert or replace the given ``(algorithm, window_size)`` keys of the stored AUC table.

    The table is written whole as a new version, a folder per algorithm. Readers take the newest finished version, so they never see
    half an upsert, and one that dies changes nothing. The version before stays for readers under way; older ones are
    deleted. One writer at a time.
    """
    spark = auc.sparkSession
    new, finished = auc.select(*SUMMARY_KEY, "auc"), versions(spark, path)
    if finished:
        new = upsert_summary(read_summary(spark, path), materialise(new))
    number = int(finished[-1].rpartition("=")[2]) + 1 if finished else 1
    _gathered(new, "algorithm").write.mode("overwrite").partitionBy("algorithm").parquet(f"{path.rstrip('/')}/version={number:09d}")
    for old in finished[:-1]:
        delete_folder(spark, old)


def write_summary_file(auc: DataFrame, path: str) -> None:
    """The whole AUC table as CSV with the header ``Algorithm,WindowSize,AUC``, in place of an earlier one."""
    named = auc.select(F.col("algorithm").alias("Algorithm"), F.col("window_size").alias("WindowSize"), F.col("auc").alias("AUC"))
    named.write.mode("overwrite").option("header", True).csv(path)


def write_surface_summary(summary: DataFrame, path: str, method: str = "mean", filtered: bool = False) -> None:
    """``(window_length, auc)`` rows in folders by method, filtering and algorithm."""
    tagged = summary.select("algorithm", "window_length", "auc")
    tagged = tagged.withColumns({"agg_method": F.lit(method), "filtered": F.lit(filtered)})
    _replace(tagged, path, "agg_method", "filtered", "algorithm")


def _replace(df: DataFrame, path: str, *folders: str) -> None:
    writer = _gathered(df, *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folders).parquet(path)


def _gathered(df: DataFrame, *folders: str) -> DataFrame:
    # Few files per folder; the rebalance splits a folder with many rows over several tasks.
    return df.hint("rebalance", *folders)
