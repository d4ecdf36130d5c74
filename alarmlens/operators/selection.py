"""Values at given ranks of groups of any size, by radix selection.

A double becomes a 64-bit number of the same order. Each round counts the rows per group and next digit, and each wanted rank
descends into the digit that holds it; only rows that share the digits found so far take part in the next round. What is shuffled
are counts, so no group is gathered or sorted, and the result does not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alarmlens.cluster import attach, join_null_safe, materialise
from alarmlens.limits import Limits

BITS = (16, 16, 16, 16)  # digits of a key, the first with sign, exponent and four bits of the fraction

# The layout of doubles.
_FRACTION = 52
_BIAS = 1023
_LOWEST = -1022  # exponent of the smallest normal number; smaller ones are whole multiples of 2 ** -1074


def sort_key(value: Column) -> Column:
    """A BIGINT that orders doubles as they are ordered; zeros are equal, NULL and NaN have none."""
    size = F.abs(value)
    usual = F.when((size >= F.lit(2.0**_LOWEST)) & (size < F.lit(float("inf"))), size).otherwise(F.lit(1.0))
    guess = F.floor(F.log2(usual))
    two = lambda power: F.pow(F.lit(2.0), power.cast("double"))
    # The logarithm is rounded, so it may be off by one next to a power of two.
    power = F.when(usual < two(guess), guess - 1).when(usual >= two(guess + 1), guess + 1).otherwise(guess)
    fraction = ((usual / two(power) - 1) * F.lit(2.0**_FRACTION)).cast("bigint")
    normal = F.shiftleft(power + _BIAS, _FRACTION) + fraction
    key = (
        F.when(size == 0, F.lit(0).cast("bigint"))
        .when(size == F.lit(float("inf")), F.lit((2 * _BIAS + 1) << _FRACTION).cast("bigint"))
        .when(size < F.lit(2.0**_LOWEST), (size / F.lit(2.0**-1074)).cast("bigint"))
        .otherwise(normal)
    )
    return F.when(value.isNull() | F.isnan(value), F.lit(None)).otherwise(F.when(value < 0, -key).otherwise(key))


def value_of(key: Column) -> Column:
    """The double that ``sort_key`` made ``key`` from."""
    size = F.abs(key)
    power = F.shiftright(size, _FRACTION)
    rest = size.bitwiseAND(F.lit((1 << _FRACTION) - 1))
    normal = (rest / F.lit(2.0**_FRACTION) + 1) * F.pow(F.lit(2.0), (power - _BIAS).cast("double"))
    value = (
        F.when(power == 0, rest * F.lit(2.0**-1074)).when(power > 2 * _BIAS, F.lit(float("inf"))).otherwise(normal)
    )
    return F.when(key < 0, -value).otherwise(value)


def select_ranks(
    cells: DataFrame,
    scope: Sequence[str],
    key: Sequence[str],
    ranks: Mapping[str, Callable[[Column], Column]],
    limits: Limits,
    *,
    fine: Sequence[str] = (),
    spread: Callable[[DataFrame], DataFrame] = lambda counts: counts,
) -> DataFrame:
    """``*key, _n`` and one value per entry of ``ranks``, a function from the group's count to a rank from 1 on.

    ``cells`` has ``*scope, *fine, _key, _copies``: how often a number occurs. Groups are ``key``, which contains ``scope``. Where a cell belongs
    to several groups, ``spread`` deals counts per ``scope`` and ``fine`` to them; it never sees the cells themselves.
    """
    scope, key, fine = list(scope), list(key), list(fine)
    targets, shift = None, 64
    for round_no, bits in enumerate(BITS):
        shift -= bits
        if targets is not None:
            wanted = targets.select(*scope, "_digit", F.lit(True).alias("_wanted")).distinct()
            within = cells.withColumn("_digit", F.shiftright("_key", shift + bits))
            cells = attach(within, wanted, [*scope, "_digit"], limits).where("_wanted").drop("_digit", "_wanted")
            if round_no == 2:  # few rows are left from here on
                cells = materialise(cells)
        counts = cells.groupBy(*scope, *fine, F.shiftright("_key", shift).alias("_next"))
        counts = spread(counts.agg(F.sum("_copies").alias("_copies")))
        counts = counts.groupBy(*key, "_next").agg(F.sum("_copies").alias("_copies"))
        # At most two to the power of the digit's bits rows per group and digits so far.
        counts = counts.withColumn("_digit", F.shiftright("_next", bits) if targets is not None else F.lit(0).cast("bigint"))
        group = Window.partitionBy(*key, "_digit")
        up_to = F.sum("_copies").over(group.orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        counts = counts.withColumn("_up_to", up_to)
        if targets is None:
            wish = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("rank")) for name, rank in ranks.items()])
            counts = counts.withColumn("_n", F.sum("_copies").over(group)).withColumn("_wish", F.explode(wish))
            counts = counts.select("*", F.col("_wish.name").alias("_name"), F.col("_wish.rank").alias("_rank"))
        else:
            counts = join_null_safe(counts, targets, [*key, "_digit"], "inner")
        found = counts.where("_rank > _up_to - _copies and _rank <= _up_to")
        targets = materialise(
            found.select(
                *key, "_n", "_name", F.col("_next").alias("_digit"), (F.col("_rank") - F.col("_up_to") + F.col("_copies")).alias("_rank")
            )
        )
    value = value_of(F.col("_digit"))
    return targets.groupBy(*key, "_n").agg(*[F.max(F.when(F.col("_name") == name, value)).alias(name) for name in ranks])
