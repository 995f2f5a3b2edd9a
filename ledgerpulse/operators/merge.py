"""The merged analytical table: one row per subscription period."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpulse.functions.numbers import mean, total

KEY = "customer_id"


def transaction_summary(transactions: DataFrame) -> DataFrame:
    """Amount sum, count and mean, first and last date per customer."""
    return (
        transactions.where(F.col(KEY).isNotNull())
        .groupBy(KEY)
        .agg(
            total(F.col("amount")).alias("total_transaction_amount"),
            F.count("amount").alias("transaction_count"),
            mean(F.col("amount")).alias("avg_transaction_amount"),
            F.min("transaction_date").alias("first_transaction_date"),
            F.max("transaction_date").alias("last_transaction_date"),
        )
    )


def customer_profile(customers: DataFrame, transactions: DataFrame | None = None) -> DataFrame:
    """Customers with their transaction summary, including customers known from transactions only."""
    if transactions is None:
        return customers
    return customers.join(transaction_summary(transactions), KEY, "full")


def merge_datasets(
    subscriptions: DataFrame, customers: DataFrame, transactions: DataFrame | None = None
) -> DataFrame:
    """Left join of subscriptions with customers and the per-customer transaction summary.

    The per-customer tables are joined first, so the large one is shuffled once,
    by a join that ends its stage: the adaptive skew join can then split the
    partition of a customer (or of the missing customer id) that holds a large
    share of all rows. A missing id matches a missing id. A customer listed
    twice doubles its rows.
    """
    if subscriptions is None or customers is None:
        raise ValueError("merging needs the subscriptions and the customers")
    profile = customer_profile(customers, transactions)
    renamed = profile.select(
        F.col(KEY).alias("_profile_key"),
        *[
            F.col(f"`{c}`").alias(f"{c}_customer" if c in subscriptions.columns else c)
            for c in profile.columns
            if c != KEY
        ],
    )
    return subscriptions.join(renamed, subscriptions[KEY].eqNullSafe(renamed["_profile_key"]), "left").drop(
        "_profile_key"
    )
