"""Sums of doubles that do not depend on the order of the rows.

A ROC curve groups windows of equal score, so a mean that changes in its last
bit with the order of the partial sums would give other curves from run to
run. Each number is therefore cut into an integer part and two groups of six
decimals, which are summed as BIGINT. The three sums are exact for up to
9e12 rows per group, and ANSI mode reports an overflow of the integer part.

A group of small or very large numbers is first multiplied by a power of ten that
is taken from its largest finite number, so that digits are lost relative to that number only.
Infinite numbers are counted beside the sums.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMALS = 12
_UNITS = 10.0**DECIMALS
_GROUP = 1_000_000
_RANGE = 9.0e18
_LARGEST = 14  # power of ten up to which sums in 1e-12 hold no more than the rounding of doubles


def scale_of(largest: Column) -> Column:
    """The power of ten for numbers up to ``largest``: 1 from 1 to 1e15, else what brings the largest to 1 to 10."""
    power = F.floor(F.log10(largest))
    shift = F.when((power < 0) | (power > _LARGEST), -power).otherwise(F.lit(0))
    return F.coalesce(F.pow(F.lit(10.0), F.least(shift, F.lit(300)).cast("double")), F.lit(1.0))


def fixed_scale(decimals: int) -> Column:
    """The power of ten for sums that keep ``decimals`` places."""
    return F.lit(10.0 ** (decimals - DECIMALS))


def finite(value: Column) -> Column:
    """``value``, or NULL if it is infinite or NaN."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def limbs(value: Column, name: str, scale: Column | None = None) -> dict[str, Column]:
    """The three addends of ``value * scale``, rounded to 12 decimals; those of an infinite value are 0."""
    value = F.coalesce(finite(value), F.lit(0.0))
    if scale is not None:
        value = value * scale
    outside = F.raise_error(F.lit("score beyond the range of exact sums; see decimals"))
    whole = F.when(F.abs(value) < F.lit(_RANGE), F.floor(value)).otherwise(outside)
    units = F.floor((value - whole) * F.lit(_UNITS) + F.lit(0.5))
    micro = F.floor(units / F.lit(float(_GROUP)))
    return {f"{name}_whole": whole, f"{name}_micro": micro, f"{name}_pico": units - micro * F.lit(_GROUP)}


def infinities(value: Column, name: str) -> dict[str, Column]:
    """Two more addends: whether ``value`` is above, or below, all finite numbers; NaN counts as both."""
    up = (value == F.lit(float("inf"))) | F.isnan(value)
    down = (value == F.lit(float("-inf"))) | F.isnan(value)
    return {f"{name}_up": up.cast("bigint"), f"{name}_down": down.cast("bigint")}


def limb_names(name: str) -> list[str]:
    return [f"{name}_whole", f"{name}_micro", f"{name}_pico"]


def mean_of(name: str, rows: str, scale: Column) -> Column:
    """Mean from summed limbs and infinities, a DOUBLE that equal means always share.

    The quotient is cut to whole units of the last decimal by integer
    division, so it is a function of the exact sum alone. With infinite numbers of one sign the
    mean is infinite, with both it is NULL.
    """
    quotient = F.expr(f"({name}_whole - pmod({name}_whole, {rows})) div {rows}")
    units = F.expr(
        f"(cast(pmod({name}_whole, {rows}) as decimal(20, 0)) * {10**DECIMALS}"
        f" + cast({name}_micro as decimal(20, 0)) * {_GROUP}"
        f" + cast({name}_pico as decimal(20, 0))) div {rows}"
    )
    carried = F.floor(units / F.lit(_UNITS))
    rest = units - carried * F.lit(10**DECIMALS)
    mean = ((quotient + carried).cast("double") + rest.cast("double") / F.lit(_UNITS)) / scale
    up, down = F.col(f"{name}_up") > 0, F.col(f"{name}_down") > 0
    return (
        F.when(up & down, F.lit(None))
        .when(up, F.lit(float("inf")))
        .when(down, F.lit(float("-inf")))
        .otherwise(mean)
    )


def total_of(name: str) -> Column:
    """Sum from summed limbs as a DOUBLE."""
    units = F.expr(
        f"cast({name}_whole as decimal(20, 0)) * {10**DECIMALS}"
        f" + cast({name}_micro as decimal(20, 0)) * {_GROUP}"
        f" + cast({name}_pico as decimal(20, 0))"
    )
    return units.cast("double") / F.lit(_UNITS)
