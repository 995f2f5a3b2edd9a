"""The three input tables derived from an order-management star schema.

Customers come from ``customer``/``nation``/``region``, subscription periods
from ``orders`` (30 days each) and transactions from ``lineitem``. Each builder
joins only what the requested columns need.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import micros

# Account balance below which a customer is on the plan, and its price.
PLANS = ((4500, "basic", 29), (7800, "pro", 99), (None, "enterprise", 499))
PERIOD_DAYS = 30
# More than any BIGINT, so that a date and a key fit into one number without overlap.
KEY_RANGE = Decimal(10) ** 19


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")


def _money(name: str):
    return F.col(name).cast("decimal(18,2)")


def _by_plan(position: int):
    choice = F.lit(PLANS[-1][position])
    for plan in reversed(PLANS[:-1]):
        choice = F.when(F.col("c_acctbal") < plan[0], F.lit(plan[position])).otherwise(choice)
    return choice


def customers(spark: SparkSession, directory: str, signups: bool = True, places: bool = True) -> DataFrame:
    """Customers; without ``signups``/``places`` those columns and their joins are left out."""
    rows = table(spark, directory, "customer")
    columns = [
        F.col("c_custkey").cast("string").alias("customer_id"),
        _by_plan(1).alias("plan"),
        _by_plan(2).cast("decimal(18,2)").alias("monthly_price"),
        F.col("c_mktsegment").alias("segment"),
    ]
    if signups:
        first = (
            table(spark, directory, "orders")
            .groupBy(F.col("o_custkey").alias("c_custkey"))
            .agg(F.min("o_orderdate").alias("signup_date"))
        )
        rows = rows.join(first, "c_custkey", "left")
        columns.append(F.col("signup_date"))
    if places:
        nations = table(spark, directory, "nation").join(
            table(spark, directory, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left"
        )
        rows = rows.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        columns += [F.col("n_name").alias("country"), F.col("r_name").alias("first_source")]
    return rows.select(*columns)


def subscriptions(
    spark: SparkSession, directory: str, usage: bool = True, renewals: bool = True
) -> DataFrame:
    """Subscription periods; without ``usage``/``renewals`` those columns and their joins are left out."""
    orders = table(spark, directory, "orders")
    columns = [
        F.col("o_orderkey").cast("string").alias("subscription_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("o_orderdate").alias("period_start"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(PERIOD_DAYS))).alias("period_end"),
        _money("o_totalprice").alias("revenue"),
    ]
    if renewals:
        # A join with one row per customer instead of a window: a customer with
        # a large share of all orders is then split by the skew join, which needs
        # a shuffle right below both sides; the null-safe condition brings it.
        # Date and key share one DECIMAL, because Spark hashes on fixed-width
        # aggregates and would sort all orders for a struct.
        orders = orders.withColumn("place", micros(F.col("o_orderdate")) * F.lit(KEY_RANGE) + F.col("o_orderkey"))
        first = orders.groupBy(F.col("o_custkey").alias("first_custkey")).agg(F.min("place").alias("first_place"))
        orders = orders.join(first, F.col("o_custkey").eqNullSafe(F.col("first_custkey")), "left")
        columns.append((F.col("place") > F.col("first_place")).alias("is_renewal"))
    churned = F.col("o_orderstatus") == "F"
    columns += [
        F.when(churned, 1).otherwise(0).cast("bigint").alias("churn_flag"),
        (~churned).alias("active"),
    ]
    if usage:
        lines = (
            table(spark, directory, "lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(
                F.count("*").alias("num_logins"),
                (F.sum(F.col("l_discount").cast("decimal(4,2)")).cast("double") / F.count("l_discount") * 100).alias(
                    "feature_x_usage"
                ),
            )
        )
        orders = orders.join(lines, "o_orderkey", "left")
        columns += [F.coalesce("num_logins", F.lit(0).cast("bigint")).alias("num_logins"), F.col("feature_x_usage")]
    return orders.select(*columns)


def transactions(spark: SparkSession, directory: str, owners: bool = True) -> DataFrame:
    """Transactions; without ``owners`` the customer id and the join that finds it are left out."""
    lines = table(spark, directory, "lineitem")
    share_paid = F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)")
    columns = [
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"),
        (_money("l_extendedprice") * share_paid).alias("amount"),
        F.col("l_shipdate").alias("transaction_date"),
        F.col("l_returnflag").alias("payment_method"),
    ]
    if owners:
        orders = table(spark, directory, "orders").select("o_orderkey", "o_custkey")
        lines = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        columns.append(F.col("o_custkey").cast("string").alias("customer_id"))
    return lines.select(*columns)
