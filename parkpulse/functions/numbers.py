"""Exact rounding. Sums stay BIGINT until one final division, so a result never depends on
the order in which partitions were summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded_units(num: Column, den: Column | int, digits: int = 0) -> Column:
    """num / den in units of 10**-digits, rounded half up, for non-negative integers."""
    den = F.lit(den) if isinstance(den, int) else den
    return F.call_function("div", num * (2 * 10**digits) + den, den * 2)


def rounded_ratio(num: Column, den: Column | int, digits: int = 0) -> Column:
    """num / den as a double with `digits` decimals, rounded half up."""
    return rounded_units(num, den, digits).cast("double") / F.lit(float(10**digits))


def ratio(num: Column, den: Column | int) -> Column:
    den = F.lit(den) if isinstance(den, int) else den
    return num.cast("double") / den.cast("double")
