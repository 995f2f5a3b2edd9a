"""Arithmetic that keeps the null, zero-divisor and rounding rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(value: Column) -> Column:
    """Sum in the column's own type (exact for decimals); 0 for a group without values."""
    return F.coalesce(F.sum(value), F.lit(0)).cast("double")


def mean(value: Column) -> Column:
    """Average as DOUBLE of an exact sum, also for decimal input."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value))


def ratio(part: Column, whole: Column) -> Column:
    """NULL instead of an error when ``whole`` is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100


def growth(now: Column, before: Column) -> Column:
    """Change in percent; 0 when the earlier value is missing or not positive."""
    return F.when(before > 0, (now - before) / before * 100).otherwise(F.lit(0.0))


def half_even(value: Column, digits: int) -> Column:
    return F.bround(value, digits)


def at_least(value: Column, floor: float) -> Column:
    """Lower bound that leaves NULL alone (``greatest`` would replace it)."""
    return F.when(value < floor, F.lit(floor)).otherwise(value)
