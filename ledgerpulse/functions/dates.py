"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = {"monthly": "month", "quarterly": "quarter"}


def month_start(ts: Column) -> Column:
    """First day of the month. Truncating a date keeps the session time zone out of it."""
    return F.trunc(ts.cast("date"), "month")


def quarter_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "quarter")


def period_start(ts: Column, period: str = "monthly") -> Column:
    """``monthly``, or a quarter for every other value."""
    return month_start(ts) if period == "monthly" else quarter_start(ts)


def period_label(start: Column, period: str = "monthly") -> Column:
    """``2024-03`` or ``2024Q1``."""
    if period == "monthly":
        return F.date_format(start, "yyyy-MM")
    return F.concat(F.year(start), F.lit("Q"), F.quarter(start))


def month_number(date: Column) -> Column:
    """Months counted from year 0, so that differences are whole months."""
    return F.year(date) * 12 + F.month(date) - 1


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    return (later - earlier).cast("interval second").cast("decimal(24,6)")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed 24-hour days, rounded down; unlike ``datediff`` it ignores calendar days."""
    return F.floor(elapsed_seconds(later, earlier) / F.lit(86400)).cast("bigint")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 as BIGINT, for ordering inside fixed-width aggregates.

    Long arithmetic only. Times without a zone are read in the session time
    zone, which is why the session uses UTC.
    """
    return F.unix_micros(ts.cast("timestamp"))
