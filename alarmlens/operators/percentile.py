"""Exact percentiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alarmlens.limits import Limits
from alarmlens.operators.selection import select_ranks, sort_key


def _cells(df, by, value):
    cells = df.select(*by, sort_key(F.col(value).cast("double")).alias("_key"), F.lit(1).cast("bigint").alias("_copies"))
    return cells.where("_key is not null")


def exact_percentile(
    df: DataFrame, by: Sequence[str], value: str, share: float, output: str, limits: Limits
) -> DataFrame:
    """Percentile with linear interpolation, one row per group; NULL and NaN are left out."""
    place = F.lit(share) * (F.col("_n") - 1)
    ranks = {"_lower": lambda n: F.floor(F.lit(share) * (n - 1)) + 1, "_upper": lambda n: F.ceil(F.lit(share) * (n - 1)) + 1}
    found = select_ranks(_cells(df, by, value), by, by, ranks, limits)
    part = place - F.floor(place)
    lower, upper = F.col("_lower"), F.col("_upper")
    mixed = F.when(lower == upper, lower).otherwise(lower * (F.lit(1.0) - part) + upper * part)
    return found.select(*by, mixed.alias(output))


def percentile_value(
    df: DataFrame, by: Sequence[str], value: str, share: float, output: str, limits: Limits
) -> DataFrame:
    """The least value that at least ``share`` of the group's values do not exceed; NULL and NaN are left out."""
    ranks = {output: lambda n: F.greatest(F.lit(1), F.ceil(F.lit(share) * n))}
    return select_ranks(_cells(df, by, value), by, by, ranks, limits).select(*by, output)
