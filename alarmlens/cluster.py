"""What the jobs need from the cluster: a shared folder, size checks, joins on nullable keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alarmlens.limits import Limits


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        folder = tempfile.mkdtemp(prefix="alarmlens-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Paths of what a folder holds, on any file system that Spark reads; none if it is not there."""
    files, where = _file_system(spark, path)
    return [str(entry.getPath()) for entry in files.listStatus(where)] if files.exists(where) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    files, where = _file_system(spark, path)
    files.delete(where, True)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once; later uses read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads no further than needed to tell."""
    return df.limit(rows + 1).count() <= rows


def spread(columns: Sequence[str], pieces: Column | int) -> Column:
    """A number in ``[0, pieces)`` that also separates identical rows of different partitions.

    It depends on the row and its partition only, so a task that runs again
    after a lost executor gives each row the same number.
    """
    pieces = F.lit(pieces) if isinstance(pieces, int) else pieces
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), pieces.cast("bigint"))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which NULL keys meet, as they do in ``groupBy``; keeps the left keys."""
    renamed = {key: f"_right_{key}" for key in keys}
    right = right.withColumnsRenamed(renamed)
    condition = F.lit(True)
    for key, other in renamed.items():
        condition = condition & F.col(key).eqNullSafe(F.col(other))
    joined = left.join(right, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*renamed.values())


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str], limits: Limits) -> DataFrame:
    """Left-join ``lookup``, one materialised row per key, to a large frame.

    A lookup within ``limits.broadcast_rows`` is broadcast. A larger one is
    shuffled; each key is then spread over ``limits.salts`` pieces, because
    one key may hold a large share of ``df``.
    """
    if at_most(lookup, limits.broadcast_rows):
        return join_null_safe(df, F.broadcast(lookup), keys, "left")
    salted = df.withColumn("_salt", spread(df.columns, limits.salts))
    copies = lookup.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(limits.salts - 1).cast("bigint")))
    )
    return join_null_safe(salted.hint("merge"), copies, [*keys, "_salt"], "left").drop("_salt")
