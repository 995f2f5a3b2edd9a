"""Whole runs: load and merge, and the analysis behind a dashboard."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpulse.functions.coerce import UNSURE
from ledgerpulse.operators import churn, forecast, reporting, revenue
from ledgerpulse.operators.cleaning import clean, date_votes, require_schema, validate_schema
from ledgerpulse.operators.features import customer_features
from ledgerpulse.operators.merge import merge_datasets
from ledgerpulse.operators.quality import dataset_summary, quality_report, quality_scores
from ledgerpulse.session import stage
from ledgerpulse.sources.files import BAD_ROW, is_bad_row, load_file, split_bad_rows
from ledgerpulse.sources.schemas import SCHEMAS

logger = logging.getLogger(__name__)


@dataclass
class Dataset:
    """The cleaned tables and what is derived from them, all lazy."""

    customers: DataFrame
    subscriptions: DataFrame
    transactions: DataFrame | None = None

    @property
    def tables(self) -> dict[str, DataFrame]:
        named = {
            "customers": self.customers,
            "subscriptions": self.subscriptions,
            "transactions": self.transactions,
        }
        return {name: df for name, df in named.items() if df is not None}

    def merged(self) -> DataFrame:
        return merge_datasets(self.subscriptions, self.customers, self.transactions)

    def quality_report(self) -> DataFrame:
        return quality_report(self.tables)

    def quality_scores(self) -> DataFrame:
        return quality_scores(self.tables)

    def summary(self) -> DataFrame:
        return dataset_summary(self.customers, self.subscriptions, self.transactions, self.quality_scores())

    def staged(self) -> Dataset:
        """The same tables stored in the shared scratch folder, so that cleaning runs once."""
        return Dataset(**{name: stage(df, name) for name, df in self.tables.items()})


def load_table(
    spark: SparkSession, path: str, name: str, file_type: str = "auto", dates: str | dict[str, str] = "vote", **options
) -> DataFrame:
    """Read, check the required columns and clean one of the three tables; ``options`` as for ``load_file``.

    Columns that the declaration lacks are kept and warned of. Whether 3/4/2024 is in March or April is told by the other
    cells of the column, in a pass of its own; an order of ``coerce.DATE_ORDERS``, for all columns or by column, spares it.
    In a column with cells of both orders such a cell is missing, and a warning tells how many there are.
    """
    schema = SCHEMAS[name]
    raw = load_file(spark, path, file_type, **options)
    if BAD_ROW in raw.columns:
        raw, _ = split_bad_rows(raw)
    for warning in validate_schema(raw, schema, name).warnings:
        logger.warning(warning)
    raw = require_schema(raw, schema, name)
    if dates == "vote":
        dates = _voted(raw, schema, name)
    elif isinstance(dates, str):
        dates = dict.fromkeys(schema, dates)
    return clean(raw, schema, dates)


def _voted(raw: DataFrame, schema: dict[str, str], name: str) -> dict[str, str]:
    votes = date_votes(raw, schema).collect()
    for v in votes:
        if v.date_order == UNSURE and v.either:
            logger.warning(
                f"{name}.{v.column_name} has {v.only_day_first} dates with the day first and {v.only_month_first} with the "
                f"month first; {v.either} that can be either are left missing"
            )
    return {v.column_name: v.date_order for v in votes}


def load_all_data(
    spark: SparkSession,
    customers: str,
    subscriptions: str,
    transactions: str | None = None,
    file_type: str = "auto",
    staged: bool = False,
    **options,
) -> Dataset:
    """The tables behind the paths; ``staged`` cleans them once, into the shared scratch folder."""
    data = Dataset(
        load_table(spark, customers, "customers", file_type, **options),
        load_table(spark, subscriptions, "subscriptions", file_type, **options),
        load_table(spark, transactions, "transactions", file_type, **options) if transactions else None,
    )
    return data.staged() if staged else data


def load_directory(spark: SparkSession, directory: str, file_type: str = "csv", **options) -> Dataset:
    """The three tables of a directory, named ``<table>.<file_type>``."""
    paths = {name: f"{directory.rstrip('/')}/{name}.{file_type}" for name in SCHEMAS}
    return load_all_data(spark, **paths, file_type=file_type, **options)


def bad_row_counts(spark: SparkSession, paths: dict[str, str], multiline: bool = False) -> DataFrame:
    """Per table (name to path of a CSV file): rows, and rows that do not fit the header."""
    counts = []
    for name, path in paths.items():
        raw = load_file(spark, path, "csv", multiline, bad_rows="keep")
        counts.append(raw.agg(F.lit(name).alias("table_name"), F.count("*").alias("total_rows"), F.count_if(is_bad_row(raw)).alias("bad_rows")))
    return reduce(DataFrame.unionByName, counts)


def dashboard(subscriptions: DataFrame) -> dict[str, DataFrame]:
    """The KPI row and the three series, from one stored monthly aggregate."""
    months = stage(revenue.monthly_table(subscriptions), "months")
    return {"kpis": revenue.kpis_of(months), **revenue.series_of(months)}


def run_analysis(data: Dataset, model_type: str = "logistic", months: int = forecast.HORIZON_MONTHS) -> dict:
    """Metrics, forecast, churn model and report tables."""
    results = dashboard(data.subscriptions)
    # The series is small and read by the fit, the report and the export.
    series = stage(results["mrr_series"], "mrr_series")
    model, future, accuracy = forecast.train_and_forecast(series, months)
    predicted = forecast.predict(model, months)
    classifier, risky = churn.train_and_rank(customer_features(data.subscriptions, data.customers), model_type)
    kpis = stage(results["kpis"], "kpis")
    return {
        **results,
        "kpis": kpis,
        "mrr_series": series,
        "forecast_summary": forecast.forecast_summary(predicted),
        "future_forecast": future,
        "forecast_accuracy": accuracy,
        "churn_model": classifier,
        "at_risk": risky,
        "kpi_cards": reporting.kpi_cards(kpis),
        "kpi_deltas": reporting.kpi_deltas(kpis),
        "risk_table": reporting.risk_table(risky),
        "risk_digest": reporting.risk_digest(risky),
        "narrative_inputs": reporting.narrative_inputs(kpis, forecast.expected_mrr(predicted), risky),
    }
