"""The tables behind a report: KPI cards, ranked lists, digest and chart data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.labels import (
    money,
    percent_text,
    plain_money,
    signed_percent,
    thousands,
    trend_label,
    whole_number,
)
from ledgerpulse.functions.numbers import half_even
from ledgerpulse.operators.scores import rank_by_risk

# Customers in the digest and in the report table, churn percent that
# the dashboard compares with, and the digest when nobody is at risk. The card labels
# and the wording of the digest below are fixed texts as well.
DIGEST_SIZE = 5
TABLE_ROWS = 10
CHURN_TARGET = 5
NO_RISK_TEXT = "No high-risk customers identified"


def kpi_cards(kpis: DataFrame) -> DataFrame:
    """Label and formatted value of the six headline numbers."""
    cards = {
        "Current MRR": money(F.col("current_mrr")),
        "ARR": money(F.col("arr")),
        "Active Customers": thousands(F.col("active_customers")),
        "Churn Rate": percent_text(F.col("churn_rate")),
        "ARPU": money(F.col("arpu"), 2),
        "CLV": money(F.col("clv"), 2),
    }
    entries = [F.struct(F.lit(label).alias("label"), value.alias("value")) for label, value in cards.items()]
    return kpis.select(F.inline(F.array(*entries)))


def kpi_deltas(kpis: DataFrame) -> DataFrame:
    """Change texts shown beside the cards, and the trend in words."""
    return kpis.select(
        F.concat(signed_percent(F.col("mrr_growth_mom")), F.lit(" MoM")).alias("mrr_delta"),
        percent_text(F.col("churn_rate") - CHURN_TARGET).alias("churn_delta"),
        trend_label(F.col("mrr_growth_mom")).alias("mrr_trend"),
    )


def risk_table(scored: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """Ranked customers with formatted numbers."""
    return rank_by_risk(scored).limit(rows).select(
        "customer_id",
        F.concat(half_even(F.col("churn_probability") * 100, 1).cast("string"), F.lit("%")).alias("churn_probability"),
        plain_money(F.col("current_revenue")).alias("current_revenue"),
        half_even(F.col("risk_score"), 2).alias("risk_score"),
        half_even(F.col("tenure_months"), 1).alias("tenure_months"),
    )


def risk_display(scored: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """Ranked customers with numbers rounded but not formatted, for a sortable table."""
    return rank_by_risk(scored).limit(rows).select(
        "customer_id",
        half_even(F.col("churn_probability") * 100, 1).alias("churn_probability"),
        half_even(F.col("current_revenue"), 2).alias("current_revenue"),
        half_even(F.col("risk_score"), 2).alias("risk_score"),
        "tenure_months",
    )


def risk_digest(scored: DataFrame, size: int = DIGEST_SIZE) -> DataFrame:
    """The riskiest customers as one line of text."""
    top = rank_by_risk(scored).limit(size)
    text = F.concat(
        F.lit("Customer "),
        "customer_id",
        F.lit(" ($"),
        whole_number(F.col("current_revenue")),
        F.lit("/mo, "),
        whole_number(F.col("churn_probability") * 100),
        F.lit("% risk)"),
    )
    place = F.row_number().over(Window.orderBy(F.desc("risk_score"), "customer_id"))
    lines = F.array_sort(F.collect_list(F.struct("place", "line")))
    return (
        top.select(place.alias("place"), text.alias("line"))
        .agg(F.concat_ws(", ", F.transform(lines, lambda entry: entry["line"])).alias("joined"))
        .select(F.when(F.col("joined") == "", F.lit(NO_RISK_TEXT)).otherwise(F.col("joined")).alias("at_risk_summary"))
    )


def chart_data(summary: DataFrame) -> DataFrame:
    """The forecast chart in long form: one row per date and line that has a value."""
    lines = {"Actual MRR": "actual", "Predicted MRR": "predicted", "Upper Bound": "upper_bound", "Lower Bound": "lower_bound"}
    entries = [F.struct(F.lit(name).alias("line"), F.col(column).alias("value")) for name, column in lines.items()]
    return summary.select("date", F.inline(F.array(*entries))).where(F.col("value").isNotNull())


def preview(df: DataFrame, order: list[str], rows: int = 100) -> DataFrame:
    """The first rows in a stated order."""
    return df.orderBy(*order).limit(rows)


def narrative_inputs(kpis: DataFrame, forecast_mrr: DataFrame, at_risk_customers: DataFrame) -> DataFrame:
    """The numbers an executive summary is written from, as one row."""
    return kpis.select(
        "current_mrr",
        "mrr_growth_mom",
        forecast_mrr.select("forecast_mrr").scalar().alias("forecast_mrr"),
        "churn_rate",
        "active_customers",
        at_risk_customers.agg(F.count("*")).scalar().alias("at_risk_count"),
        trend_label(F.col("mrr_growth_mom")).alias("mrr_trend"),
    )
