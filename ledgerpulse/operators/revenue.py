"""Recurring revenue, churn, revenue per user, lifetime value and growth.

``by`` adds grouping columns, so that each series also runs per plan, segment
or country when those columns are present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import month_start, period_label, period_start
from ledgerpulse.functions.numbers import growth, half_even, percent, ratio, total

MONTHS_PER_YEAR = 12
# Fixed value: lifetime in months assumed when nobody churns.
DEFAULT_LIFETIME_MONTHS = 36


def _is_active() -> Column:
    return F.coalesce(F.col("active"), F.lit(False))


def customer_periods(
    subscriptions: DataFrame, by: tuple[str, ...] = (), period: str = "monthly", dated: bool = True
) -> DataFrame:
    """One row per customer and period; ``dated`` leaves out periods without a start.

    The shuffle carries partial sums, so a customer with very many rows arrives
    as one row per period and map task; distinct counts become plain counts.
    """
    rows = subscriptions.where(F.col("period_start").isNotNull()) if dated else subscriptions
    return rows.groupBy(*by, period_start(F.col("period_start"), period).alias("date"), "customer_id").agg(
        F.sum(F.when(_is_active(), F.col("revenue"))).alias("revenue"),
        F.count_if(_is_active()).alias("active_rows"),
        F.max(F.coalesce(F.col("churn_flag") == 1, F.lit(False))).alias("has_churned"),
    )


def _by_period(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    known = F.col("customer_id").isNotNull()
    newcomers = [F.count_if("_new").alias("newcomers")] if "_new" in sums.columns else []
    return sums.groupBy(*by, "date").agg(
        total(F.col("revenue")).alias("MRR"),
        F.sum("active_rows").alias("active_rows"),
        F.count_if(known & (F.col("active_rows") > 0)).alias("active_customers"),
        F.count_if(known).alias("customers_start"),
        F.count_if(known & F.col("has_churned")).alias("churned"),
        *newcomers,
    )


def period_activity(subscriptions: DataFrame, by: tuple[str, ...] = (), period: str = "monthly") -> DataFrame:
    """Revenue and customer counts per period: the base of every series. Gaps are not filled."""
    return _by_period(customer_periods(subscriptions, by, period), by)


def mrr_series(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Revenue of active periods by month of their start."""
    return (
        subscriptions.where(F.col("active") & F.col("period_start").isNotNull())
        .groupBy(*by, month_start(F.col("period_start")).alias("date"))
        .agg(total(F.col("revenue")).alias("MRR"))
    )


def mrr_by_attribute(subscriptions: DataFrame, customers: DataFrame, attribute: str) -> DataFrame:
    """Monthly revenue per value of a customer attribute.

    Revenue is summed per customer and month before the join, which so carries
    no raw periods.
    """
    owners = customers.select(F.col("customer_id").alias("_owner"), attribute)
    sums = customer_periods(subscriptions.where("active"))
    return (
        sums.join(owners, F.col("customer_id").eqNullSafe(F.col("_owner")), "left")
        .groupBy(attribute, "date")
        .agg(total(F.col("revenue")).alias("MRR"))
    )


def current_revenue(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Revenue of the last present month and its annual run rate; 0 without data."""
    mrr = F.coalesce(F.max_by("MRR", "date"), F.lit(0.0))
    months = mrr_series(subscriptions, by).groupBy(*by)
    return months.agg(mrr.alias("current_mrr"), (mrr * MONTHS_PER_YEAR).alias("arr"))


def _churn_rate() -> Column:
    return F.coalesce(percent(F.col("churned"), F.col("customers_start")), F.lit(0.0))


def _arpu() -> Column:
    return ratio(F.col("MRR"), F.col("active_customers"))


def churn_series(subscriptions: DataFrame, period: str = "monthly", by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct customers, churned customers and churn percent per month or quarter."""
    return period_activity(subscriptions, by, period).select(
        *by,
        period_label(F.col("date"), period).alias("period"),
        "date",
        "customers_start",
        "churned",
        _churn_rate().alias("churn_rate"),
    )


def retention_series(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    churn = churn_series(subscriptions, by=by)
    return churn.select(*by, "date", (100 - F.col("churn_rate")).alias("retention_rate"), "churn_rate")


def arpu_series(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Active revenue per distinct active customer and month."""
    months = period_activity(subscriptions.where("active"), by)
    return months.select(*by, "date", _arpu().alias("ARPU"))


def current_arpu(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    months = arpu_series(subscriptions, by).groupBy(*by)
    return months.agg(F.coalesce(F.max_by("ARPU", "date"), F.lit(0.0)).alias("arpu"))


def current_churn_rate(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    rate = F.coalesce(F.max_by("churn_rate", "date"), F.lit(0.0))
    months = churn_series(subscriptions, by=by).groupBy(*by)
    return months.agg(rate.alias("churn_rate"), (100 - rate).alias("retention_rate"))


def active_customers(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct customers with any active period, over all time."""
    return subscriptions.where("active").groupBy(*by).agg(F.count_distinct("customer_id").alias("active_customers"))


def _simple_clv(arpu: Column, churn_rate: Column) -> Column:
    return F.when(churn_rate > 0, arpu / (churn_rate / 100)).otherwise(arpu * DEFAULT_LIFETIME_MONTHS)


def lifetime_value(subscriptions: DataFrame, method: str = "simple") -> DataFrame:
    """``simple``: current revenue per user over current churn. Otherwise: mean revenue per customer."""
    if method == "simple":
        return dashboard_kpis(subscriptions).select("clv")
    return (
        subscriptions.where(F.col("customer_id").isNotNull())
        .groupBy("customer_id")
        .agg(total(F.col("revenue")).cast("decimal(38,6)").alias("revenue"))
        .agg(ratio(F.sum("revenue"), F.count("*")).alias("clv"))
    )


def _recent(value: str, first: int, last: int) -> Column:
    """Mean of ``value`` over the ``first``-th to ``last``-th latest live months."""
    return F.avg(F.when(F.col("_live") & F.col("_age").between(first, last), F.col(value)))


def _with_age(months: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Number the months that have active rows from the latest backwards.

    The window may lack a partition key: its input is one row per month (and group).
    """
    live = (F.col("active_rows") > 0) & F.col("date").isNotNull()
    latest_first = Window.partitionBy(*by).orderBy(live.desc(), F.desc("date"))
    return months.withColumn("_live", live).withColumn("_age", F.row_number().over(latest_first))


def _mom() -> Column:
    return F.coalesce(half_even(growth(_recent("MRR", 1, 1), _recent("MRR", 2, 2)), 2), F.lit(0.0))


def _qoq() -> Column:
    change = growth(_recent("MRR", 1, 3), _recent("MRR", 4, 6))
    return F.when(F.count_if("_live") >= 4, half_even(change, 2)).otherwise(F.lit(0.0))


def growth_metrics(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Month-over-month and quarter-over-quarter growth percent over the months present."""
    months = mrr_series(subscriptions, by).withColumn("active_rows", F.lit(1))
    return _with_age(months, by).groupBy(*by).agg(_mom().alias("mrr_growth_mom"), _qoq().alias("mrr_growth_qoq"))


def monthly_table(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``period_activity`` by month with ``newcomers``, the customers first active then: the base of the KPI row and its series.

    The newcomers of all months are the customers that were ever active. Periods
    without a start are kept in a row without a date, for their newcomers.
    """
    return _monthly(customer_periods(subscriptions, by, dated=False), by)


def monthly_table_by_attribute(subscriptions: DataFrame, customers: DataFrame, attribute: str) -> DataFrame:
    """``monthly_table`` per value of a customer attribute; periods are summed per customer and month before the join."""
    owners = customers.select(F.col("customer_id").alias("_owner"), attribute)
    sums = customer_periods(subscriptions, dated=False)
    owned = sums.join(owners, F.col("customer_id").eqNullSafe(F.col("_owner")), "left").drop("_owner")
    return _monthly(owned, (attribute,))


def _monthly(sums: DataFrame, by: tuple[str, ...]) -> DataFrame:
    place = F.when(F.col("active_rows") > 0, F.struct(F.col("date").isNull(), "date"))
    # the window holds the months of one customer (and those without an id), never raw periods
    first = F.min(place).over(Window.partitionBy(*by, "customer_id"))
    marked = sums.withColumn("_new", F.coalesce(F.col("customer_id").isNotNull() & (place == first), F.lit(False)))
    return _by_period(marked, by).withColumns({"ARPU": _arpu(), "churn_rate": _churn_rate()})


def series_of(months: DataFrame, by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Revenue, churn and revenue per user by month, from a (stored) monthly table."""
    dated = months.where(F.col("date").isNotNull())
    live = dated.where(F.col("active_rows") > 0)
    return {
        "mrr_series": live.select(*by, "date", "MRR"),
        "churn_series": dated.select(
            *by, period_label(F.col("date")).alias("period"), "date", "customers_start", "churned", "churn_rate"
        ),
        "arpu_series": live.select(*by, "date", "ARPU"),
    }


def dashboard_kpis(subscriptions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All headline numbers in one row (per group), from one aggregate over customer and month."""
    return kpis_of(monthly_table(subscriptions, by), by)


def kpis_of(months: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The KPI row from a (stored) monthly table."""
    latest = (
        _with_age(months, by)
        .groupBy(*by)
        .agg(
            F.coalesce(_recent("MRR", 1, 1), F.lit(0.0)).alias("current_mrr"),
            _mom().alias("mrr_growth_mom"),
            F.coalesce(F.sum("newcomers"), F.lit(0)).cast("bigint").alias("active_customers"),
            F.coalesce(_recent("ARPU", 1, 1), F.lit(0.0)).alias("arpu"),
            F.coalesce(F.max_by("churn_rate", "date"), F.lit(0.0)).alias("churn_rate"),
        )
    )
    return latest.select(
        *by,
        "current_mrr",
        (F.col("current_mrr") * MONTHS_PER_YEAR).alias("arr"),
        "mrr_growth_mom",
        "active_customers",
        "arpu",
        _simple_clv(F.col("arpu"), F.col("churn_rate")).alias("clv"),
        "churn_rate",
        (100 - F.col("churn_rate")).alias("retention_rate"),
    )
