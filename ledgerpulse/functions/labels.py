"""Numbers as display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower bound of month-over-month growth in percent, and its label.
TREND_BANDS = ((5, "strong growth"), (0, "moderate growth"), (-5, "slight decline"))
TREND_FLOOR = "concerning decline"


def thousands(value: Column, digits: int = 0) -> Column:
    return F.format_number(value, digits)


def money(value: Column, digits: int = 0) -> Column:
    return F.concat(F.lit("$"), F.format_number(value, digits))


def plain_money(value: Column) -> Column:
    """Two decimals, no thousands separator."""
    return F.concat(F.lit("$"), _pattern(value, "0.00"))


def percent_text(value: Column) -> Column:
    return F.concat(_pattern(value, "0.0"), F.lit("%"))


def signed_percent(value: Column) -> Column:
    return F.concat(_pattern(value, "+0.0;-0.0"), F.lit("%"))


def whole_number(value: Column) -> Column:
    return _pattern(value, "0")


def trend_label(growth: Column) -> Column:
    label = F.lit(TREND_FLOOR)
    for bound, text in reversed(TREND_BANDS):
        label = F.when(growth > bound, F.lit(text)).otherwise(label)
    return label


def _pattern(value: Column, pattern: str) -> Column:
    return F.call_function("format_number", value, F.lit(pattern))
