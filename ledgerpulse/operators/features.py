"""The customer feature table for churn prediction."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerpulse.functions.dates import micros, whole_days
from ledgerpulse.functions.numbers import at_least, mean, ratio, total

DAYS_PER_MONTH = 30
# More than any BIGINT, so that a time and a flag fit into one number without overlap.
FLAG_RANGE = Decimal(10) ** 19
# Later than any time a timestamp can hold, in microseconds.
NO_END = (1 << 63) - 1
PROFILE = ("signup_date", "plan", "segment", "monthly_price")

# Model inputs, in order, as far as the table has them.
NUMERIC_FEATURES = (
    "days_since_last_activity", "tenure_days", "tenure_months", "subscription_count",
    "total_revenue", "avg_revenue", "revenue_std", "min_revenue", "max_revenue",
    "revenue_per_month", "monthly_price",
)
USAGE_FEATURES = ("total_logins", "avg_logins", "max_logins", "avg_feature_usage", "max_feature_usage")
CATEGORICAL = ("plan", "segment")


def reference_date(subscriptions: DataFrame) -> DataFrame:
    """Latest period end over all rows."""
    return subscriptions.agg(F.max("period_end").alias("reference_date"))


def latest_record(subscriptions: DataFrame) -> DataFrame:
    """Per customer and column, the last non-missing value in order of period end.

    A missing period end counts as last. Equal ends are ordered by subscription
    id and then by the value itself, so the result does not depend on row order.
    The last end of each customer and column comes from hash aggregates of fixed
    width; only periods that have one of these ends take part in the ordering.
    They are found by a join on customer and end, in which a customer with very
    many periods is dealt out by their ends.
    """
    known = subscriptions.where(F.col("customer_id").isNotNull())
    columns = [c for c in subscriptions.columns if c != "customer_id"]
    owner, end = (_unused(subscriptions, name) for name in ("last_customer", "last_end"))
    ended = known.withColumn(end, F.coalesce(micros(F.col("period_end")), F.lit(NO_END)))
    ends = ended.groupBy("customer_id").agg(*[F.max(F.when(F.col(c).isNotNull(), F.col(end))).alias(c) for c in columns])
    # every customer has an end, as one with missing values only would be lost
    last = F.array_distinct(F.array_compact(F.array(*[F.col(c) for c in columns])))
    winners = ends.select(F.col("customer_id").alias(owner), F.explode(F.when(F.size(last) > 0, last).otherwise(F.array(F.lit(NO_END)))).alias("_end"))
    same = (F.col("customer_id") == F.col(owner)) & (F.col(end) == F.col("_end"))
    # a hash table of the winners: they are spread by customer and end, a few longs each
    taking_part = ended.join(winners.hint("shuffle_hash"), same, "left_semi").drop(end)
    return taking_part.groupBy("customer_id").agg(*[_last(c, "subscription_id") for c in columns])


def _unused(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def _last(name: str, *ties: str) -> Column:
    ends = F.col("period_end")
    place = F.struct(ends.isNull(), ends, *[F.col(c) for c in (*ties, name)])
    return F.max_by(name, F.when(F.col(name).isNotNull(), place)).alias(name)


def _latest_flag(name: str) -> Column:
    """Last non-missing flag by period end; at equal ends the larger one.

    Time and value share one DECIMAL, so the aggregate buffer has a fixed width
    and Spark hashes; a struct ordering would make it sort every input row. A
    missing period end comes after every time a timestamp can hold.
    """
    last = F.lit(FLAG_RANGE - 1).cast("decimal(38,0)")
    end = F.coalesce(micros(F.col("period_end")).cast("decimal(38,0)"), last)
    order = (end * F.lit(FLAG_RANGE).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(name).cast("bigint").cast("decimal(20,0)")
    return F.max_by(name, F.when(F.col(name).isNotNull(), order.cast("decimal(38,0)"))).alias(name)


def _listed(name: str, columns: list[str]) -> Column:
    """Of a customer listed more than once, the last non-missing value; one order of whole listings serves every column."""
    listing = F.struct(*[F.col(c) for c in PROFILE if c in columns])
    return F.max_by(name, F.when(F.col(name).isNotNull(), listing)).alias(name)


def _activity(rows: DataFrame) -> list[Column]:
    """Everything a customer's subscription rows contribute, as one list of aggregates."""
    revenue = F.col("revenue")
    aggregates = [
        F.max("period_end").alias("period_end"),
        F.count("*").alias("subscription_count"),
        total(revenue).alias("total_revenue"),
        mean(revenue).alias("avg_revenue"),
        F.var_pop(revenue.cast("double")).alias("_variance"),
        F.count(revenue).alias("_revenues"),
        F.min(revenue).cast("double").alias("min_revenue"),
        F.max(revenue).cast("double").alias("max_revenue"),
    ]
    if "num_logins" in rows.columns:
        logins = F.col("num_logins")
        aggregates += [
            F.coalesce(F.sum(logins), F.lit(0)).alias("total_logins"),
            mean(logins).alias("avg_logins"),
            F.max(logins).alias("max_logins"),
        ]
    if "feature_x_usage" in rows.columns:
        usage = F.col("feature_x_usage").cast("double")
        aggregates += [F.avg(usage).alias("avg_feature_usage"), F.max(usage).alias("max_feature_usage")]
    aggregates += [_latest_flag(c) for c in ("active", "churn_flag") if c in rows.columns]
    return aggregates


def customer_features(
    subscriptions: DataFrame, customers: DataFrame, reference: DataFrame | None = None, latest: tuple[str, ...] = ()
) -> DataFrame:
    """One row per subscribed customer, from the two source tables.

    Subscriptions are aggregated first (partial aggregates before the only
    shuffle of the large table) and joined with the customers afterwards. A
    customer listed n times counts every period n times, as in the merged table,
    and has the profile of the last listing in order of signup date, plan,
    segment and price, missing values filled from the listing before.
    ``reference`` may name a cheaper plan for the one-row reference date.
    ``latest`` names further columns of the latest record to carry along, which
    makes Spark sort the subscriptions instead of hashing them.
    """
    activity = (
        subscriptions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(*_activity(subscriptions), *[_last(c, "subscription_id") for c in latest])
    )
    profile = (
        customers.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(F.count("*").alias("_listings"), *[_listed(c, customers.columns) for c in PROFILE if c in customers.columns])
    )
    listings = F.coalesce("_listings", F.lit(1).cast("bigint"))
    rows = activity.join(profile, "customer_id", "left")
    for column in ("subscription_count", "total_revenue", "total_logins", "_revenues"):
        if column in rows.columns:
            rows = rows.withColumn(column, F.col(column) * listings)
    return _derive(rows, reference or reference_date(subscriptions))


def features_from_merged(merged: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """The same table from a stored merged table, in one aggregation by customer."""
    rows = (
        merged.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(*_activity(merged), *[_listed(c, merged.columns) for c in PROFILE if c in merged.columns])
    )
    return _derive(rows, reference or reference_date(merged))


def _derive(rows: DataFrame, reference: DataFrame) -> DataFrame:
    n, today = F.col("_revenues"), F.col("_today")
    derived = rows.withColumn("_today", reference.scalar()).withColumns(
        {
            # var_pop and the row count give the sample deviation also when rows count n times
            "revenue_std": F.sqrt(F.try_divide(F.col("_variance") * n, n - 1)),
            "days_since_last_activity": whole_days(today, F.col("period_end")),
            "tenure_days": whole_days(today, F.col("signup_date")),
        }
    ).withColumn("tenure_months", F.col("tenure_days") / F.lit(float(DAYS_PER_MONTH)))
    derived = derived.withColumn(
        "revenue_per_month", ratio(F.col("total_revenue"), at_least(F.col("tenure_months"), 1.0))
    )
    if "monthly_price" in derived.columns:
        derived = derived.withColumn("monthly_price", F.col("monthly_price").cast("double"))
    label = F.col("churn_flag") if "churn_flag" in derived.columns else (~F.col("active")).cast("bigint")
    derived = derived.withColumn("churned", label).drop("_variance", "_revenues", "_listings", "_today")
    numeric = [f.name for f in derived.schema.fields if isinstance(f.dataType, T.NumericType)]
    return derived.fillna(0, subset=numeric)


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column ``<column>_<value>`` per category; all 0 for a missing or unknown value."""
    return df.withColumns(
        {f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in categories}
    )


def select_features(df: DataFrame) -> list[str]:
    """Names of the model inputs that the table has: numbers, usage, one-hot columns."""
    present = [c for c in NUMERIC_FEATURES + USAGE_FEATURES if c in df.columns]
    encoded = [c for c in df.columns if c.startswith(tuple(f"{c}_" for c in CATEGORICAL))]
    return present + encoded
