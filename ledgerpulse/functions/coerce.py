"""Text to typed values: what cannot be read becomes NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts that a delimited file uses for "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
WHITESPACE = " \t\n\r\x0b\x0c"


def null_tokens(text: Column) -> Column:
    return F.when(text.isin(*NULL_TOKENS), F.lit(None)).otherwise(text)


# The dates that the original's clock can hold.
FIRST_TIME, LAST_TIME = "1677-09-21 00:12:43.145224", "2262-04-11 23:47:16.854775"
# English month names.
MONTHS = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)
#: How numbers such as 3/4/2024 are read. With ``unsure`` only those of which one reading is a date.
MONTH_FIRST, DAY_FIRST, UNSURE = DATE_ORDERS = ("month_first", "day_first", "unsure")

_CLOCK = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?: ?([AaPp][Mm]))?)?$"
_YEAR = r"(\d{4}|\d{2})"
_DAY, _MONTH = r"(1[3-9]|2\d|3[01])", r"(0?[1-9]|1[0-2])"
#: Two numbers and a year; both numbers and the clock are groups 1, 3, 5 and 6.
NUMBERED = rf"^(\d{{1,2}})([/.-])(\d{{1,2}})\2{_YEAR}{_CLOCK}"
# rewritten dates begin with a mark, which tells a year of two digits from other texts
_MONTH_THEN_DAY, _DAY_THEN_MONTH = "@$4-$1-$3 $5$6", "@$4-$3-$1 $5$6"
_REWRITES = {
    MONTH_FIRST: ((NUMBERED, _MONTH_THEN_DAY),),
    DAY_FIRST: ((NUMBERED, _DAY_THEN_MONTH),),
    UNSURE: (
        (rf"^{_DAY}([/.-]){_MONTH}\2{_YEAR}{_CLOCK}", _DAY_THEN_MONTH),
        (rf"^{_MONTH}([/.-]){_DAY}\2{_YEAR}{_CLOCK}", _MONTH_THEN_DAY),
        (rf"^(\d{{1,2}})([/.-])(\1)\2{_YEAR}{_CLOCK}", _MONTH_THEN_DAY),
    ),
}
_YEAR_FIRST = ((rf"^(\d{{4}})[/.](\d{{1,2}})[/.](\d{{1,2}}){_CLOCK}", "$1-$2-$3 $4$5"), (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
# Two-digit years: from this one on they are of the last century.
LAST_CENTURY = "69"
_HALF_DAY = r"^\d{4}-\d{1,2}-\d{1,2} (?:0?[1-9]|1[0-2]):[0-5]\d(?::[0-5]\d)?[AP]M$"
_NAME = "(?i:(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + r"|sept))\.?"
# month, year, day and clock; a text that begins with a digit can only be the first
_NAMED = (
    (rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]+{_NAME}[ ,-]+{_YEAR}{_CLOCK}", "$2|$3|$1|$4$5"),
    (rf"^{_NAME}[ -]+(\d{{1,2}})(?:st|nd|rd|th)?,?[ -]+{_YEAR}{_CLOCK}", "$1|$3|$2|$4$5"),
)
# A number as text files write it; the engine's own cast would also take a type suffix such as 100d.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(?i:inf|infinity)\s*$"


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; kept out of generated code, which the patterns of dates would burst.

    An aggregate over no elements ends with ``use``. An element of a transformed array would do the same, but there Spark
    asks the whole of ``use`` for its type and nulls with every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, use)


def _rewritten(text: Column, patterns) -> Column:
    for pattern, replacement in patterns:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _with_century(iso: Column) -> Column:
    year = F.substring(iso, 2, 2)
    short = F.concat(F.when(year < LAST_CENTURY, "20").otherwise("19"), F.substring(iso, 2, 64))
    return F.when(~iso.startswith("@"), iso).when(F.substring(iso, 4, 1) == "-", short).otherwise(F.substring(iso, 2, 64))


def _read(iso: Column) -> Column:
    """Rewritten text to a time, a 12-hour clock by arithmetic in its usual form, else by the pattern for it."""

    def half_day(whole: Column) -> Column:
        def turned(time: Column) -> Column:
            hour, afternoon = F.hour(time), F.substring(whole, -2, 1) == "P"
            hours = F.when(afternoon & (hour < 12), 12).when(~afternoon & (hour == 12), -12).otherwise(0)
            return time + F.make_dt_interval(F.lit(0), hours)

        by_pattern = F.try_to_timestamp(whole, F.lit("yyyy-M-d h:mm[:ss]a")).cast("timestamp_ntz")
        in_24 = _let(F.left(whole, F.length(whole) - 2).try_cast("timestamp_ntz"), turned)
        return F.when(whole.rlike(_HALF_DAY), in_24).otherwise(by_pattern)

    def time(whole: Column) -> Column:
        return F.when(whole.rlike("[AaPp][Mm]$"), _let(F.upper(whole), half_day)).otherwise(whole.try_cast("timestamp_ntz"))

    return _let(_let(iso, _with_century), time)


def _read_named(text: Column) -> Column:
    numbers = F.create_map(*[F.lit(x) for nr, m in enumerate(MONTHS, 1) for x in (m[:3], str(nr))])

    def parts(marked: Column) -> Column:
        # only a text that fits is changed: no pattern lets a bar through
        return F.when(marked != text, _let(F.split(marked, r"\|"), lambda part: _read(iso(part))))

    def iso(part: Column) -> Column:
        month = F.element_at(numbers, F.lower(F.substring(part[0], 1, 3)))
        return F.concat(F.lit("@"), part[1], F.lit("-"), month, F.lit("-"), part[2], F.lit(" "), part[3])

    day_first, name_first = [F.regexp_replace(text, pattern, order) for pattern, order in _NAMED]
    return _let(F.when(text.rlike(r"^\d"), day_first).otherwise(name_first), parts)


def _in_range(read: Column) -> Column:
    return F.when(read.between(F.lit(FIRST_TIME).cast("timestamp_ntz"), F.lit(LAST_TIME).cast("timestamp_ntz")), read)


def to_timestamp(value: Column, order: str = MONTH_FIRST, is_text: bool = True) -> Column:
    """ISO text; numbers in ``order``, years in front, or month names, each perhaps with a clock. A time beyond the original's
    range is missing, like what cannot be read. A column of times or dates needs no reading: ``is_text=False``."""

    if not is_text:
        return _in_range(value.try_cast("timestamp_ntz"))
    return _let(value.cast("string"), lambda cell: _let(F.coalesce(cell.try_cast("timestamp_ntz"), _let(_trimmed(cell), lambda text: _untidy(text, order))), _in_range))


def _untidy(text: Column, order: str) -> Column:
    """A text that is not ISO to a time. Cheap looks at a cell spare it the patterns."""
    patterns = F.when(text.rlike(r"^\d{4}"), _rewritten(text, _YEAR_FIRST)).otherwise(_rewritten(text, _REWRITES[order]))
    numbered = F.when(text.rlike(r"^\d+[/.-]\d|^\d{8}$"), _read(patterns))
    return F.coalesce(numbered, F.when(text.rlike("[A-Za-z]{3}"), _read_named(text)))


def _trimmed(cell: Column) -> Column:
    return F.btrim(cell, F.lit(WHITESPACE))


def date_kind(value: Column) -> Column:
    """How one cell can be read as a date: ``iso``, ``only_day_first``, ``only_month_first``, ``either``, ``other_formats`` or
    ``unread``; null for a null."""

    def kind(text: Column) -> Column:
        other = F.when(_let(_untidy(text, UNSURE), _in_range).isNotNull(), "other_formats").otherwise("unread")
        return (
            F.when(text.isNull(), None)
            # no text of two numbers and a year is ISO, and only such a text needs the patterns
            .when(text.try_cast("timestamp_ntz").isNotNull(), "iso")
            .when(~text.rlike(r"^\d{1,2}[/.-]"), other)
            .when(text.rlike(_REWRITES[UNSURE][0][0]), "only_day_first")
            .when(text.rlike(_REWRITES[UNSURE][1][0]), "only_month_first")
            .when(text.rlike(rf"^{_MONTH}([/.-]){_MONTH}\2{_YEAR}{_CLOCK}"), "either")
            .otherwise(other)
        )

    return _let(_trimmed(value.cast("string")), kind)


def _number_text(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike(NUMBER), F.btrim(text, F.lit(WHITESPACE)))


def to_double(value: Column) -> Column:
    return F.nanvl(_number_text(value).try_cast("double"), F.lit(None).cast("double"))


def to_money(value: Column) -> Column:
    """An amount with six decimals, so that sums do not depend on the order of the rows."""
    return to_double(value).try_cast("decimal(24,6)")


def to_integer(value: Column) -> Column:
    """Truncates; 0 for missing or unreadable. Text goes through DOUBLE so that ``'2.9'`` is 2."""
    return F.coalesce(_number_text(value).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def to_boolean(value: Column) -> Column:
    """True for missing or unreadable; numbers are true unless zero."""
    return F.coalesce(
        value.try_cast("boolean"),
        value.try_cast("string").try_cast("double") != 0,
        F.lit(True),
    )


def to_text(value: Column) -> Column:
    return F.nullif(F.btrim(value.cast("string"), F.lit(WHITESPACE)), F.lit("nan"))


COERCIONS = {
    "string": to_text,
    "datetime": to_timestamp,
    "float": to_double,
    "money": to_money,
    "int": to_integer,
    "bool": to_boolean,
}
