"""Schema validation, type coercion and removal of exact duplicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerpulse.functions.coerce import COERCIONS, DAY_FIRST, MONTH_FIRST, UNSURE, date_kind, to_timestamp
from ledgerpulse.session import stage

#: Repeated row hashes (8 bytes each) that are broadcast; with more, most rows would travel anyway.
BROADCAST_HASHES = 1_000_000
#: Fewer bits make a smaller shuffle, as zero bytes compress away.
HASH_BITS = 48


@dataclass(frozen=True)
class Validation:
    table: str
    missing_columns: list[str]
    extra_columns: list[str]
    warnings: list[str] = field(default_factory=list)

    @property
    def valid(self) -> bool:
        return not self.missing_columns


def validate_schema(df: DataFrame, schema: dict[str, str], table: str) -> Validation:
    """Compare column names only; runs no job. Extra columns warn and are kept."""
    missing = [c for c in schema if c not in df.columns]
    extra = [c for c in df.columns if c not in schema]
    warnings = [f"extra columns in {table}: {', '.join(extra)}"] if extra else []
    return Validation(table, missing, extra, warnings)


def validation_report(tables: dict[str, DataFrame], schemas: dict[str, dict[str, str]]) -> DataFrame:
    """One row per table: whether it is valid, and its missing and extra columns."""
    found = [validate_schema(df, schemas[name], name) for name, df in tables.items()]
    spark = next(iter(tables.values())).sparkSession
    rows = [(v.table, v.valid, v.missing_columns, v.extra_columns, v.warnings) for v in found]
    schema = "table_name string, valid boolean, missing_columns array<string>, extra_columns array<string>, warnings array<string>"
    return spark.createDataFrame(rows, schema)


def require_schema(df: DataFrame, schema: dict[str, str], table: str) -> DataFrame:
    report = validate_schema(df, schema, table)
    if not report.valid:
        raise ValueError(f"{table} lacks required columns: {', '.join(report.missing_columns)}")
    return df


def date_votes(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """One row per declared date column that holds text: how many of its cells can be read in which way, and the order that follows.

    A number above 12 tells which of two numbers is the day. Cells of both kinds leave the column ``unsure``; without any, the month comes first.
    """
    columns = [c for c, kind in df.dtypes if schema.get(c) == "datetime" and kind == "string"]
    if not columns:
        return df.sparkSession.createDataFrame([], _VOTES)
    # a row for each cell, so that every cell is looked at once, and all but one row a task and kind stay in the task
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), date_kind(F.col(f"`{c}`")).alias("kind")) for c in columns])))
    counted = cells.groupBy("column_name", "kind").agg(F.count("kind").alias("n"))
    of_kind = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in DATE_KINDS]
    # columns of an empty table have a vote too
    none = df.sparkSession.createDataFrame([(c, None, 0) for c in columns], "column_name string, kind string, n bigint")
    votes = counted.unionByName(none).groupBy("column_name").agg(F.sum("n").alias("cells"), *of_kind)
    day, month = F.col("only_day_first") > 0, F.col("only_month_first") > 0
    order = F.when(day & month, UNSURE).when(day, DAY_FIRST).otherwise(MONTH_FIRST)
    return votes.withColumn("date_order", order)


DATE_KINDS = ("iso", "only_day_first", "only_month_first", "either", "other_formats", "unread")
_VOTES = "column_name string, cells bigint, " + ", ".join(f"{k} bigint" for k in DATE_KINDS) + ", date_order string"


def date_orders(df: DataFrame, schema: dict[str, str]) -> dict[str, str]:
    """The order of every declared date column that holds text; one pass over these columns."""
    return {r.column_name: r.date_order for r in date_votes(df, schema).collect()}


def coerce_types(df: DataFrame, schema: dict[str, str], dates: dict[str, str] | None = None) -> DataFrame:
    """One projection over all declared columns; undeclared ones pass through. ``dates`` has the order of date columns that
    do not put the month first."""
    dates, texts = dates or {}, {c for c, kind in df.dtypes if kind == "string"}

    def typed(name: str):
        if schema[name] == "datetime":
            return to_timestamp(F.col(f"`{name}`"), dates.get(name, MONTH_FIRST), name in texts)
        return COERCIONS[schema[name]](F.col(f"`{name}`"))

    return df.select(*[typed(c).alias(c) if c in schema else F.col(f"`{c}`") for c in df.columns])


def clean(df: DataFrame, schema: dict[str, str], dates: dict[str, str] | None = None) -> DataFrame:
    """Typed rows without exact copies, written once to the shared scratch folder."""
    return drop_copies(coerce_types(df, schema, dates))


def drop_copies(df: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """``df`` without exact copies; missing values are equal to each other.

    The rows are stored with a hash each, and only the hashes are counted over all tasks. Rows whose hash is
    alone have no copy and never travel. The others, found by a broadcast of the repeated hashes, are compared whole, so
    that different rows under one hash both stay; their copies are combined before that shuffle. With more repeated hashes
    than may be broadcast, all rows are compared whole.
    """
    columns = [f"`{c}`" for c in df.columns]
    name = _free_name(df, "_hash")
    hashed = stage(df.withColumn(name, row_hash(columns)), "typed")
    repeated = stage(hashed.groupBy(name).agg(F.count("*").alias("_rows")).where("_rows > 1").select(name), "repeated")
    if (n := repeated.count()) == 0:
        return hashed.select(*columns)
    if n > broadcast_hashes:
        return hashed.select(*columns).dropDuplicates()
    few = F.broadcast(repeated)
    alone = hashed.join(few, name, "left_anti").select(*columns)
    return alone.unionByName(hashed.join(few, name, "left_semi").select(*columns).dropDuplicates())


def row_hash(columns: list[str]) -> Column:
    """A hash of a row. A null leaves the hash as it is, so what is missing is told by a text of its own.

    HASH_BITS are enough: of 10^12 rows one in 300 shares its hash with a different row, and takes part in the comparison.
    """
    missing = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return F.xxhash64(missing, *columns).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def _free_name(df: DataFrame, name: str) -> str:
    while name in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def duplicate_counts(df: DataFrame, schema: dict[str, str], dates: dict[str, str] | None = None) -> DataFrame:
    """Rows before and after ``clean`` and the difference, in one pass."""
    copies = coerce_types(df, schema, dates).groupBy(*[f"`{c}`" for c in df.columns]).agg(F.count("*").alias("_copies"))
    before = F.coalesce(F.sum("_copies"), F.lit(0).cast("bigint"))
    return copies.agg(
        before.alias("rows_before"),
        F.count("*").alias("rows_after"),
        (before - F.count("*")).alias("duplicates_removed"),
    )
