"""Signup-cohort retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import month_number, month_start
from ledgerpulse.functions.numbers import percent


def cohort_grid(subscriptions: DataFrame, customers: DataFrame | None) -> DataFrame:
    """Per signup month and months since: distinct customers, active periods, cohort size, retention.

    Both sides are reduced to one row per customer and month before the join, so
    no customer brings more rows than it has months. The earliest month of a
    customer is marked, which turns the cohort size into a sum over the grid.
    Periods without a start and customers without a signup date are left out.
    A missing id matches a missing id; spelled as two plain key columns, the
    join leaves the rows partitioned as the window needs them. Without a table
    of customers there are no cohorts.
    """
    if customers is None:
        customers = subscriptions.select("customer_id", F.col("period_start").alias("signup_date")).limit(0)
    key = [F.coalesce("customer_id", F.lit("")).alias("id"), F.col("customer_id").isNull().alias("no_id")]
    activity = (
        subscriptions.where(F.col("period_start").isNotNull())
        .groupBy(*key, month_start(F.col("period_start")).alias("month"))
        .agg(F.count_if("active").alias("active"))
    )
    signups = (
        customers.where(F.col("signup_date").isNotNull())
        .groupBy(*key, month_start(F.col("signup_date")).alias("cohort"))
        .agg(F.count("*").alias("listings"))
    )
    per_customer = Window.partitionBy("id", "no_id", "cohort").orderBy("month")
    known = ~F.col("no_id")
    age = month_number(F.col("month")) - month_number(F.col("cohort"))
    cells = (
        activity.join(signups, ["id", "no_id"])
        .withColumn("is_first", F.row_number().over(per_customer) == 1)
        .groupBy("cohort", age.cast("bigint").alias("months_since_signup"))
        .agg(
            F.count_if(known).alias("customer_id"),
            F.sum(F.col("active") * F.col("listings")).alias("active"),
            F.count_if(known & F.col("is_first")).alias("newcomers"),
        )
    )
    size = F.sum("newcomers").over(Window.partitionBy("cohort"))
    return cells.select(
        "cohort",
        "months_since_signup",
        "customer_id",
        "active",
        size.alias("cohort_size"),
        percent(F.col("active"), size).alias("retention_rate"),
    )


def cohort_sizes(subscriptions: DataFrame, customers: DataFrame) -> DataFrame:
    """Distinct customers per signup month."""
    return cohort_grid(subscriptions, customers).groupBy("cohort").agg(F.max("cohort_size").alias("cohort_size"))
