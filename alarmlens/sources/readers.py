"""Read scores, maintenances, summaries and stored curves, always with an explicit schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.cluster import list_folder

# The three layouts of score files, as DDL, with their time and score columns.
FORMATS = {
    "us": ("unix BIGINT, scores DOUBLE", "unix", "scores"),
    "TLS": ("Timestamp BIGINT, Label DOUBLE, Score DOUBLE", "Timestamp", "Score"),
    "TL": ("Timestamp BIGINT, Score DOUBLE", "Timestamp", "Score"),
}
MAINTENANCES = "unix_start BIGINT, unix_end BIGINT, maint_id STRING"
SUMMARY = "algorithm STRING, window_size DOUBLE, auc DOUBLE"
SUMMARY_FILE = "Algorithm STRING, WindowSize DOUBLE, AUC DOUBLE"
CURVES = (
    "point_no BIGINT, threshold DOUBLE, tp BIGINT, fp BIGINT, fpr DOUBLE, tpr DOUBLE, precision DOUBLE,"
    " recall DOUBLE, f1 DOUBLE, agg_method STRING, filtered BOOLEAN, algorithm STRING, window_length DOUBLE"
)
SURFACE_SUMMARY = "window_length DOUBLE, auc DOUBLE, agg_method STRING, filtered BOOLEAN, algorithm STRING"


def read_scores(
    spark: SparkSession,
    path: str,
    format: str = "us",
    header: bool = False,
    source: str = "csv",
    algorithm: str | None = None,
    algorithms: Sequence[str] | None = None,
    days: Sequence[str] | None = None,
) -> DataFrame:
    """Score files below ``<algorithm>/<day>/`` as ``(algorithm, unix, score)``.

    ``path`` is a folder of algorithms or a glob of files. The algorithm is the folder two levels
    above the file, with or without the ``algorithm=`` of a partitioned table, unless given. ``algorithms`` and ``days`` name the
    folders that are listed and opened; others are not touched. With ``header`` the first line of each file is left out, whatever it
    says: columns are told by their place. TLS files keep their ``label``. NaN scores become NULL, as do broken numbers.
    """
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {format!r}")
    schema, time, score = FORMATS[format]
    reader = spark.read.schema(schema)
    if source == "csv":
        reader = reader.option("header", header).option("enforceSchema", True)
    if "*" in path:
        if algorithms is not None or days is not None:
            raise ValueError("algorithms and days choose folders below a folder, not of a glob")
        paths = [path]
    else:
        first, second = _folders("algorithm", algorithms), _folders("day", days)
        paths = [f"{path.rstrip('/')}/{a}/{d}/*" for a in first for d in second]
    df = reader.format(source).load(paths)
    name = F.lit(algorithm) if algorithm is not None else folder_above("day")
    label = [F.col("Label").alias("label")] if format == "TLS" else []
    return df.select(
        name.alias("algorithm"),
        F.col(time).alias("unix"),
        F.nanvl(F.col(score), F.lit(None)).alias("score"),
        *label,
    )


def _folders(column: str, names: Sequence[str] | None) -> list[str]:
    """Globs of folders by name, plain or as those of a partitioned table."""
    if names is None:
        return ["*"]
    plain = [re.sub(r"([\\*?\[\]{}])", r"\\\1", str(name)) for name in names]
    return [f"{{{column}=,}}{name}" for name in plain]


def folder_above(partition: str) -> Column:
    """The folder above the one that holds the file, freed of its URL encoding."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+/[^/]+$", 1)
    folder = F.regexp_replace(folder, "^algorithm=", "")
    return F.url_decode(F.regexp_replace(folder, r"\+", "%2B"))


def read_score_table(spark: SparkSession, path: str, source: str = "parquet", header: bool = False) -> DataFrame:
    """A table written by ``write_scores_by_day``; filters on ``algorithm`` and ``day`` prune its folders."""
    reader = spark.read.schema("unix BIGINT, score DOUBLE, algorithm STRING, day DATE")
    if source == "csv":
        reader = reader.option("header", header)
    return reader.format(source).load(path)


def read_maintenances(spark: SparkSession, path: str, schema: str = MAINTENANCES, header: bool = True) -> DataFrame:
    """Maintenances from CSV; ``schema`` gives the order of the columns in the file."""
    df = spark.read.schema(schema).option("header", header).csv(path)
    return df.select("maint_id", "unix_start", "unix_end")


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table written by ``write_summary``, the newest last."""
    folders = [f for f in list_folder(spark, path) if f.rpartition("/")[2].startswith("version=")]
    return sorted(f for f in folders if any(name.endswith("/_SUCCESS") for name in list_folder(spark, f)))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished version of the AUC table by ``(algorithm, window_size)``."""
    finished = versions(spark, path)
    if not finished:
        raise FileNotFoundError(f"no finished version of a summary in {path}")
    return spark.read.schema(SUMMARY).parquet(finished[-1]).select("algorithm", "window_size", "auc")


def read_summary_file(spark: SparkSession, path: str) -> DataFrame:
    """An AUC table kept as CSV with the header ``Algorithm,WindowSize,AUC``."""
    df = spark.read.schema(SUMMARY_FILE).option("header", True).csv(path)
    return df.toDF("algorithm", "window_size", "auc")


def read_curves(
    spark: SparkSession,
    path: str,
    columns: tuple[str, ...] = ("fpr", "window_length", "tpr"),
    method: str = "mean",
    filtered: bool = False,
) -> DataFrame:
    """What ``write_curves`` or ``write_surface`` stored for one method; other folders and columns are not read."""
    return _of_method(spark.read.schema(CURVES).parquet(path), method, filtered).select("algorithm", *columns)


def read_surface_summary(spark: SparkSession, path: str, method: str = "mean", filtered: bool = False) -> DataFrame:
    """Stored ``(algorithm, window_length, auc)`` rows of one method."""
    stored = _of_method(spark.read.schema(SURFACE_SUMMARY).parquet(path), method, filtered)
    return stored.select("algorithm", "window_length", "auc")


def _of_method(stored: DataFrame, method: str, filtered: bool) -> DataFrame:
    return stored.where((F.col("agg_method") == method) & (F.col("filtered") == filtered))
