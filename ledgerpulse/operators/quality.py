"""Missing values, quality score, dataset summary and the quality gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerpulse.functions.numbers import half_even, percent, total

# The declared data-quality rules.
MAX_MISSING_SHARE = 0.2
CRITICAL_COLUMNS = ("customer_id", "revenue", "period_start")
TABLES = ("customers", "subscriptions", "transactions")


def _is_missing(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """One row per column: rows, missing count and missing percent, from a single aggregate."""
    counts = df.agg(
        F.count("*").alias("total_rows"),
        *[F.count_if(_is_missing(f)).alias(f"m{i}") for i, f in enumerate(df.schema.fields)],
    )
    entries = F.array(
        *[
            F.struct(F.lit(f.name).alias("column_name"), F.col(f"m{i}").alias("missing"))
            for i, f in enumerate(df.schema.fields)
        ]
    )
    return (
        counts.select("total_rows", F.explode(entries).alias("e"))
        .select(F.lit(table).alias("table_name"), "total_rows", "e.column_name", "e.missing")
        .withColumn(
            "missing_pct",
            F.coalesce(half_even(percent(F.col("missing"), F.col("total_rows")), 2), F.lit(0.0)),
        )
    )


def quality_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Columns that have missing values, over all given tables."""
    return _union(column_profile(df, name) for name, df in tables.items()).where("missing > 0")


def quality_scores(tables: dict[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns and 100 minus the mean missing percent of the incomplete columns."""
    incomplete = F.when(F.col("missing") > 0, F.col("missing_pct"))
    return (
        _union(column_profile(df, name) for name, df in tables.items())
        .groupBy("table_name")
        .agg(
            F.max("total_rows").alias("total_rows"),
            F.count("*").alias("total_columns"),
            F.coalesce(half_even(100 - F.avg(incomplete), 1), F.lit(100.0)).alias("quality_score"),
        )
    )


def dataset_summary(
    customers: DataFrame,
    subscriptions: DataFrame,
    transactions: DataFrame | None = None,
    scores: DataFrame | None = None,
) -> DataFrame:
    """One row: table sizes, signup range, active and churned periods, total revenue.

    ``scores`` (see ``quality_scores``) adds the quality score of each table.
    """
    score = {} if scores is None else scores.agg(F.map_from_entries(F.collect_list(F.struct("table_name", "quality_score")))).scalar()
    periods = subscriptions.agg(
        F.struct(
            F.count("*").alias("subscriptions_count"),
            F.count_if("active").alias("active_subscriptions"),
            F.coalesce(F.sum("churn_flag"), F.lit(0)).cast("bigint").alias("churned_subscriptions"),
            total(F.col("revenue")).alias("total_revenue"),
        )
    ).scalar()
    payments = F.lit(0).cast("bigint") if transactions is None else transactions.agg(F.count("*")).scalar()
    return (
        customers.agg(
            F.count("*").alias("customers_count"),
            F.min("signup_date").alias("first_signup"),
            F.max("signup_date").alias("last_signup"),
        )
        .withColumn("periods", periods)
        .select(
            "customers_count",
            "periods.subscriptions_count",
            payments.alias("transactions_count"),
            "first_signup",
            "last_signup",
            "periods.active_subscriptions",
            "periods.churned_subscriptions",
            "periods.total_revenue",
            *[F.try_element_at(score, F.lit(t)).alias(f"{t}_quality") for t in TABLES if scores is not None],
        )
    )


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first; missing values are not counted."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("row_count"))
        .orderBy(F.desc("row_count"), column)
    )


def quality_gate(
    subscriptions: DataFrame,
    key: str = "subscription_id",
    critical: tuple[str, ...] = CRITICAL_COLUMNS,
    max_missing: float = MAX_MISSING_SHARE,
) -> DataFrame:
    """One row per check of the declared rules: measured value and whether it passes.

    Missing shares and the date range come from one aggregate, repeated keys
    from another, so a table that is not stored is computed twice.
    """
    fields = {f.name: f for f in subscriptions.schema.fields}
    shares = [F.coalesce(F.try_divide(F.count_if(_is_missing(fields[c])), F.count("*")), F.lit(0.0)).alias(c) for c in critical]
    backwards = F.count_if(F.col("period_end") < F.col("period_start")).cast("double").alias("_backwards")

    def rule(name: str, value: Column, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("check_name"), value.alias("measured"), passed.alias("passed"))

    rules = [rule(f"missing:{c}", F.round(F.col(c), 6), F.col(c) <= max_missing) for c in critical]
    rules.append(rule("date_range", F.col("_backwards"), F.col("_backwards") == 0))
    measured = subscriptions.agg(*shares, backwards).select(F.inline(F.array(*rules)))
    surplus = F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    duplicates = (
        subscriptions.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("copies"))
        .agg(
            F.lit("duplicates").alias("check_name"),
            surplus.cast("double").alias("measured"),
            (surplus == 0).alias("passed"),
        )
    )
    return measured.unionByName(duplicates)


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
