"""Scores, maintenances and alarms as views on the ``events`` and ``orders`` tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TWO_DAYS = 172_800
HALF_YEAR = 180 * 86_400


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch(column: str) -> Column:
    # Plain arithmetic on the stored microseconds, independent of the session's time zone.
    return F.expr(f"cast(cast({column} - TIMESTAMP_NTZ'1970-01-01 00:00:00' as interval second) as bigint)")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """All events but errors; the event type plays the algorithm."""
    events = table(spark, folder, "events").where("event_type <> 'error'")
    return events.select(
        F.col("event_type").alias("algorithm"), epoch("ts").alias("unix"), F.col("value").alias("score")
    )


def maintenances(spark: SparkSession, folder: str) -> DataFrame:
    """The strongest error event of every two days."""
    errors = table(spark, folder, "events").where("event_type = 'error'")
    strongest = errors.select(
        epoch("ts").alias("unix_start"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        F.struct("value", -F.col("event_id")).alias("strength"),
    )
    strongest = strongest.groupBy(F.floor(F.col("unix_start") / TWO_DAYS)).agg(
        F.max_by(F.struct("unix_start", "k"), "strength").alias("peak")
    )
    # One row per two days is left, so the numbering is small whatever the size of the table.
    number = F.row_number().over(Window.orderBy("peak.unix_start"))
    return strongest.select(
        F.concat(F.lit("M"), number).alias("maint_id"),
        F.col("peak.unix_start").alias("unix_start"),
        (F.col("peak.unix_start") + 60 * F.col("peak.k")).alias("unix_end"),
    )


def alarms(spark: SparkSession, folder: str) -> DataFrame:
    return maintenances(spark, folder).select(F.col("unix_start").alias("unix")).distinct()


def daily_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by priority. Dates are whole days, so many rows lie exactly on an alarm or a window's edge."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("algorithm"),
        epoch("o_orderdate").alias("unix"),
        F.col("o_totalprice").alias("score"),
    )


def daily_alarms(spark: SparkSession, folder: str) -> DataFrame:
    """The day of the largest order of every half year."""
    orders = table(spark, folder, "orders").select(
        epoch("o_orderdate").alias("unix"), F.struct("o_totalprice", -F.col("o_orderkey")).alias("size")
    )
    largest = orders.groupBy(F.floor(F.col("unix") / HALF_YEAR)).agg(F.max_by("unix", "size").alias("unix"))
    return largest.select("unix").distinct()
