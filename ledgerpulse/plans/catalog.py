"""Named queries over the star-schema tables: each takes (spark, directory) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import month_number
from ledgerpulse.operators import churn, cleaning, cohorts, features, forecast, quality, reporting, revenue, scores, splits
from ledgerpulse.operators.cleaning import clean, duplicate_counts, validation_report
from ledgerpulse.operators.merge import merge_datasets, transaction_summary
from ledgerpulse.plans.analysis import Dataset, bad_row_counts, dashboard, load_all_data, load_directory
from ledgerpulse.session import scratch_dir, stage
from ledgerpulse.sources import schemas, star
from ledgerpulse.sources.files import FORMATS, export_csv, export_dated_csv, load_file

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Days of inactivity at which the recency score reaches one half.
RECENCY_HALF = 30
# Places at which a trend may bend.
BENDS = 12


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _periods(spark, directory, usage=False, renewals=False):
    return star.subscriptions(spark, directory, usage=usage, renewals=renewals)


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Money as DOUBLE, for comparison."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


# --- untidy text versions of the tables, as a delimited file would hold them -------------


def raw_customers(spark: SparkSession, directory: str) -> DataFrame:
    """Every customer twice, as text, with unreadable and missing cells, dates of two formats and line breaks in a cell."""
    text = star.customers(spark, directory).select(
        F.concat(F.lit("  "), "customer_id", F.lit(" ")).alias("customer_id"),
        F.when(F.col("plan") == "enterprise", "2020-13-45")
        .when(F.col("plan") == "pro", F.date_format("signup_date", "M/d/yyyy H:mm:ss"))
        .otherwise(F.col("signup_date").cast("string"))
        .alias("signup_date"),
        F.when(F.col("first_source") == "EUROPE", F.concat("country", F.lit("\nEurope")))
        .when(F.col("first_source") != "ASIA", F.col("country"))
        .alias("country"),
        F.concat("plan", F.lit("\t")).alias("plan"),
        F.when(F.col("plan") == "basic", "100d").otherwise(F.col("monthly_price").cast("string")).alias("monthly_price"),
        F.when(F.col("segment") == "BUILDING", " nan ").otherwise(F.col("segment")).alias("segment"),
        "first_source",
        F.lit("import").alias("batch"),
    )
    return text.unionAll(text)


def raw_subscriptions(spark: SparkSession, directory: str) -> DataFrame:
    return star.subscriptions(spark, directory).select(
        "subscription_id",
        "customer_id",
        *[F.col(c).cast("string").alias(c) for c in ("period_start", "period_end", "revenue")],
        F.when(F.col("is_renewal"), "yes").otherwise("no").alias("is_renewal"),
        F.when(F.col("active"), F.lit(None).cast("string")).otherwise("1").alias("churn_flag"),
        F.when(F.col("active"), F.lit(None).cast("string")).otherwise("False").alias("active"),
        F.when(F.col("num_logins") > 0, F.concat("num_logins", F.lit(".9"))).otherwise("12d").alias("num_logins"),
        F.col("feature_x_usage").cast("string").alias("feature_x_usage"),
    )


def raw_transactions(spark: SparkSession, directory: str) -> DataFrame:
    return star.transactions(spark, directory).select(
        "transaction_id",
        "customer_id",
        F.when(F.col("payment_method") == "R", "refunded").otherwise(F.col("amount").cast("string")).alias("amount"),
        F.col("transaction_date").cast("string").alias("transaction_date"),
        F.concat(F.lit(" "), "payment_method").alias("payment_method"),
    )


def _cleaned(spark, directory) -> dict[str, DataFrame]:
    raw = {
        "customers": raw_customers(spark, directory),
        "subscriptions": raw_subscriptions(spark, directory),
        "transactions": raw_transactions(spark, directory),
    }
    return {name: clean(df, schemas.SCHEMAS[name]) for name, df in raw.items()}


# --- loading, cleaning, quality ----------------------------------------------------------


@query
def customers_view(spark, directory):
    return star.customers(spark, directory).withColumn("monthly_price", F.col("monthly_price").cast("double"))


@query
def subscriptions_view(spark, directory):
    return _rounded(
        star.subscriptions(spark, directory).withColumn("revenue", F.col("revenue").cast("double")), "feature_x_usage"
    )


@query
def transactions_view(spark, directory):
    return star.transactions(spark, directory).withColumn("amount", F.col("amount").cast("double"))


@query
def clean_customers(spark, directory):
    return _plain(clean(raw_customers(spark, directory), schemas.CUSTOMERS), "monthly_price")


@query
def clean_subscriptions(spark, directory):
    return _plain(_rounded(clean(raw_subscriptions(spark, directory), schemas.SUBSCRIPTIONS), "feature_x_usage"), "revenue")


@query
def clean_transactions(spark, directory):
    return _plain(clean(raw_transactions(spark, directory), schemas.TRANSACTIONS), "amount")


def raw_date_texts(spark: SparkSession, directory: str) -> DataFrame:
    """The transactions' dates as text: the day first, the month first and last, and of both kinds in one column."""
    date = F.col("transaction_date")
    both = F.when(F.col("payment_method") == "A", F.date_format(date, "M-d-yyyy")).otherwise(F.date_format(date, "d-M-yyyy"))
    return star.transactions(spark, directory, owners=False).select(
        "transaction_id",
        F.date_format(date, "dd/MM/yyyy").alias("day_first"),
        F.when(F.col("payment_method") != "N", F.date_format(date, "M/d/yyyy h:mm a")).alias("month_first"),
        both.alias("both"),
        F.concat(F.lit(" "), F.date_format(date, "MMMM d, yyyy")).alias("named"),
    )


DATE_TEXTS = {"transaction_id": "string", **dict.fromkeys(("day_first", "month_first", "both", "named"), "datetime")}


@query
def date_votes(spark, directory):
    return cleaning.date_votes(raw_date_texts(spark, directory), DATE_TEXTS)


@query
def voted_dates(spark, directory):
    """The date texts read in the order that the cells of each column tell."""
    raw = raw_date_texts(spark, directory)
    return clean(raw, DATE_TEXTS, cleaning.date_orders(raw, DATE_TEXTS))


@query
def removed_duplicates(spark, directory):
    return duplicate_counts(raw_customers(spark, directory), schemas.CUSTOMERS)


@query
def csv_load_and_merge(spark, directory):
    """Write the untidy tables as CSV, load them back, clean and merge; revenue per plan."""
    folder = scratch_dir(spark)
    paths = {
        "customers": export_csv(raw_customers(spark, directory).drop("batch"), f"{folder}/customers.csv"),
        "subscriptions": export_csv(raw_subscriptions(spark, directory), f"{folder}/subscriptions.csv"),
        "transactions": export_csv(raw_transactions(spark, directory), f"{folder}/transactions.csv"),
    }
    merged = load_all_data(spark, **paths, multiline=True).merged()
    return merged.groupBy("plan").agg(
        F.count("*").alias("periods"),
        F.sum("revenue").cast("double").alias("revenue"),
        F.count_if(F.col("segment").isNull()).alias("without_segment"),
        F.sum("transaction_count").alias("transaction_count"),
        F.min("period_start").alias("first_period"),
    )


@query
def quality_report(spark, directory):
    return quality.quality_report(_cleaned(spark, directory))


@query
def quality_scores(spark, directory):
    return quality.quality_scores(_cleaned(spark, directory))


@query
def dataset_summary(spark, directory):
    return quality.dataset_summary(
        star.customers(spark, directory, places=False),
        _periods(spark, directory),
        star.transactions(spark, directory, owners=False),
    )


@query
def stored_dataset_summary(spark, directory):
    """Clean the untidy tables, store them as parquet and summarise the stored copies, with their quality scores."""
    return Dataset(**_cleaned(spark, directory)).staged().summary()


@query
def directory_summary(spark, directory):
    """Write the untidy tables as parquet into one directory, load the directory and summarise it."""
    folder = scratch_dir(spark)
    raw_customers(spark, directory).drop("batch").write.parquet(f"{folder}/customers.parquet")
    raw_subscriptions(spark, directory).write.parquet(f"{folder}/subscriptions.parquet")
    raw_transactions(spark, directory).write.parquet(f"{folder}/transactions.parquet")
    data = load_directory(spark, folder, "parquet", staged=True)
    return data.summary().select("customers_count", "subscriptions_count", "transactions_count", "first_signup", "total_revenue")


@query
def file_formats(spark, directory):
    """The customers written and read back in every format: rows, distinct ids and the sum of prices."""
    folder, found = scratch_dir(spark), []
    table = star.customers(spark, directory, signups=False).withColumn("monthly_price", F.col("monthly_price").cast("string"))
    for kind in FORMATS:
        path = f"{folder}/customers.{kind}"
        writer = table.write.format(kind)
        (writer.option("header", True) if kind == "csv" else writer).save(path)
        back = load_file(spark, path, schema=table.schema if kind == "json" else None)
        price = F.sum(F.col("monthly_price").cast("decimal(18,2)")).cast("double").alias("prices")
        found.append(back.agg(F.lit(kind).alias("format"), F.count("*").alias("row_count"), F.count_distinct("customer_id").alias("ids"), price))
    return reduce(DataFrame.unionByName, found)


@query
def bad_csv_rows(spark, directory):
    """A file in which the rows of one plan have a cell too many: rows, and rows that do not fit."""
    path = f"{scratch_dir(spark)}/customers.csv"
    rows = star.customers(spark, directory, signups=False, places=False)
    line = F.concat_ws(",", "customer_id", "plan", "segment", F.when(F.col("plan") == "pro", F.lit("more")))
    # one column whose name and values hold the commas
    rows.select(line.alias("customer_id,plan,segment")).write.csv(path, header=True, sep="\t")
    return bad_row_counts(spark, {"customers": path})


@query
def schema_validation(spark, directory):
    """What the untidy tables lack and have beside the declared columns, and their rows."""
    tables = {
        "customers": raw_customers(spark, directory),
        "subscriptions": raw_subscriptions(spark, directory).drop("active"),
        "transactions": raw_transactions(spark, directory),
    }
    report = validation_report(tables, schemas.SCHEMAS).drop("warnings")
    counts = [df.agg(F.lit(name).alias("table_name"), F.count("*").alias("total_rows")) for name, df in tables.items()]
    texts = {c: F.array_join(c, ", ") for c in ("missing_columns", "extra_columns")}
    return report.withColumns(texts).join(reduce(DataFrame.unionByName, counts), "table_name")


@query
def plan_counts(spark, directory):
    return quality.category_counts(star.customers(spark, directory, signups=False, places=False), "plan")


@query
def quality_gate(spark, directory):
    return quality.quality_gate(stage(clean(raw_subscriptions(spark, directory), schemas.SUBSCRIPTIONS), "subscriptions"))


@query
def transactions_per_customer(spark, directory):
    return transaction_summary(star.transactions(spark, directory))


@query
def merged_table(spark, directory):
    merged = merge_datasets(
        star.subscriptions(spark, directory), star.customers(spark, directory), star.transactions(spark, directory)
    )
    merged = merged.withColumns({c: F.col(c).cast("double") for c in ("revenue", "monthly_price")})
    return _rounded(merged, "feature_x_usage")


@query
def preview_rows(spark, directory):
    rows = reporting.preview(_periods(spark, directory), ["period_start", "subscription_id"])
    return rows.withColumn("revenue", F.col("revenue").cast("double"))


# --- revenue, churn, cohorts ---------------------------------------------------------------


@query
def mrr_by_month(spark, directory):
    return revenue.mrr_series(_periods(spark, directory)).orderBy("date")


@query
def mrr_by_month_and_segment(spark, directory):
    customers = star.customers(spark, directory, signups=False, places=False)
    return revenue.mrr_by_attribute(_periods(spark, directory), customers, "segment")


@query
def current_mrr_and_arr(spark, directory):
    return revenue.current_revenue(_periods(spark, directory))


@query
def churn_by_month(spark, directory):
    return _rounded(revenue.churn_series(_periods(spark, directory)), "churn_rate")


@query
def churn_by_quarter(spark, directory):
    return _rounded(revenue.churn_series(_periods(spark, directory), "quarterly"), "churn_rate")


@query
def current_churn(spark, directory):
    return _rounded(revenue.current_churn_rate(_periods(spark, directory)), "churn_rate", "retention_rate")


@query
def retention_by_month(spark, directory):
    return _rounded(revenue.retention_series(_periods(spark, directory)), "churn_rate", "retention_rate")


@query
def arpu_by_month(spark, directory):
    return _rounded(revenue.arpu_series(_periods(spark, directory)), "ARPU")


@query
def current_arpu(spark, directory):
    return _rounded(revenue.current_arpu(_periods(spark, directory)), "arpu")


@query
def clv_simple(spark, directory):
    return _rounded(revenue.lifetime_value(_periods(spark, directory)), "clv")


@query
def clv_cohort(spark, directory):
    return _rounded(revenue.lifetime_value(_periods(spark, directory), "cohort"), "clv")


@query
def active_customers(spark, directory):
    return revenue.active_customers(_periods(spark, directory))


@query
def growth_mom_qoq(spark, directory):
    return revenue.growth_metrics(_periods(spark, directory))


@query
def dashboard_kpis(spark, directory):
    return _rounded(
        revenue.dashboard_kpis(_periods(spark, directory)), "arpu", "clv", "churn_rate", "retention_rate"
    )


@query
def dashboard_kpis_by_segment(spark, directory):
    owners = star.customers(spark, directory, signups=False, places=False).select("customer_id", "segment")
    by = ("segment",)
    kpis = revenue.kpis_of(revenue.monthly_table_by_attribute(_periods(spark, directory), owners, "segment"), by)
    return _rounded(kpis, "arpu", "clv", "churn_rate", "retention_rate")


@query
def dashboard_series(spark, directory):
    """The three series behind the dashboard, in long form."""
    results = dashboard(_periods(spark, directory))
    values = {"mrr_series": "MRR", "churn_series": "churn_rate", "arpu_series": "ARPU"}
    long = [results[n].select(F.lit(n).alias("series"), "date", F.round(c, 6).alias("value")) for n, c in values.items()]
    return reduce(DataFrame.unionByName, long)


@query
def cohort_grid(spark, directory):
    return _rounded(
        cohorts.cohort_grid(_periods(spark, directory), star.customers(spark, directory, places=False)), "retention_rate"
    )


@query
def cohort_sizes(spark, directory):
    return cohorts.cohort_sizes(_periods(spark, directory), star.customers(spark, directory, places=False))


# --- customer features, split, scores ------------------------------------------------------


def _features(spark, directory) -> DataFrame:
    return features.customer_features(
        _periods(spark, directory, usage=True),
        star.customers(spark, directory, places=False),
        reference=features.reference_date(_periods(spark, directory)),
    )


def _recency_scored(spark, directory) -> DataFrame:
    """A score that needs no model: the longer inactive, the nearer to 1."""
    idle = F.col("days_since_last_activity")
    rows = features.customer_features(_periods(spark, directory), star.customers(spark, directory, places=False))
    return rows.withColumn("churn_probability", idle / (idle + F.lit(float(RECENCY_HALF))))


@query
def reference_date(spark, directory):
    return features.reference_date(_periods(spark, directory))


@query
def latest_record(spark, directory):
    latest = features.latest_record(_periods(spark, directory, usage=True, renewals=True))
    return _rounded(latest.withColumn("revenue", F.col("revenue").cast("double")), "feature_x_usage")


@query
def customer_features(spark, directory):
    rows = stage(_features(spark, directory), "features")
    for column, values in churn.learned_categories(rows).items():
        rows = features.one_hot(rows, column, values)
    return _rounded(
        _rounded(rows, "avg_logins", "tenure_months", "revenue_per_month", "avg_feature_usage", "max_feature_usage"),
        "revenue_std",
        digits=4,
    )


@query
def features_of_repeated_listings(spark, directory):
    """Every customer listed a second time on another plan and later: the later listing is the profile, periods count twice."""
    customers = star.customers(spark, directory, places=False)
    second = customers.withColumns(
        {
            "plan": F.when(F.col("plan") == "pro", None).otherwise("moved"),
            "monthly_price": F.lit(1).cast("decimal(18,2)"),
            "signup_date": F.col("signup_date") + F.expr("interval 5 days"),
        }
    )
    rows = features.customer_features(
        _periods(spark, directory, usage=True), customers.unionByName(second), reference=features.reference_date(_periods(spark, directory))
    )
    return rows.select("customer_id", "plan", "segment", "monthly_price", "signup_date", "subscription_count", "total_revenue", "tenure_days")


@query
def standardised_features(spark, directory):
    """Three model inputs with mean 0 and deviation 1."""
    names = ["tenure_days", "subscription_count", "avg_logins"]
    rows = stage(_features(spark, directory).select("customer_id", *names), "inputs")
    steps = [VectorAssembler(inputCols=names, outputCol="raw_features"), churn.scaler()]
    scaled = Pipeline(stages=steps).fit(rows).transform(rows).withColumn("v", vector_to_array("features"))
    return scaled.select("customer_id", *[F.round(F.col("v")[i], 6).alias(c) for i, c in enumerate(names)])


@query
def label_base_rate(spark, directory):
    return _rounded(splits.label_base_rate(_features(spark, directory)), "base_rate")


@query
def class_weights(spark, directory):
    return _rounded(splits.class_weights(_features(spark, directory)), "class_weight")


@query
def train_test_split(spark, directory):
    split = splits.stratified_split(stage(_features(spark, directory), "features"))
    return split.select("customer_id", "churned", "is_test")


@query
def recency_roc_auc(spark, directory):
    return _rounded(scores.roc_auc(_recency_scored(spark, directory)), "auc")


@query
def recency_roc_auc_by_segment(spark, directory):
    return _rounded(scores.roc_auc(_recency_scored(spark, directory), by=("segment",)), "auc")


@query
def recency_threshold_metrics(spark, directory):
    return _rounded(scores.threshold_metrics(_recency_scored(spark, directory)), "precision", "recall", "f1")


def _recency_risk(spark, directory) -> DataFrame:
    return scores.with_risk(_recency_scored(spark, directory))


@query
def risk_ranking(spark, directory):
    ranked = scores.rank_by_risk(_recency_risk(spark, directory))
    return _rounded(ranked, "churn_probability", "tenure_months", "risk_score")


@query
def high_risk_customers(spark, directory):
    rows = _recency_risk(spark, directory).where(F.col("churn_probability") >= scores.HIGH_RISK)
    return _rounded(rows, "churn_probability", "tenure_months", "risk_score")


@query
def top_at_risk(spark, directory):
    return _rounded(scores.at_risk(_recency_risk(spark, directory)), "churn_probability", "tenure_months", "risk_score")


@query
def at_risk_csv_export(spark, directory):
    """Export the ranked list as CSV and read the file back."""
    path = export_dated_csv(top_at_risk(spark, directory), scratch_dir(spark), "at_risk_customers")
    text = load_file(spark, path)
    numbers = {c: F.col(c).cast("double") for c in ("churn_probability", "current_revenue", "tenure_months", "risk_score")}
    return text.withColumns({**numbers, "active": F.col("active").cast("boolean")})


# --- forecast --------------------------------------------------------------------------------


def _mrr(spark, directory) -> DataFrame:
    return revenue.mrr_series(_periods(spark, directory))


@query
def forecast_input(spark, directory):
    return forecast.prepare_series(_mrr(spark, directory))


@query
def forecast_model(spark, directory):
    model = forecast.coefficients(forecast.fit(_mrr(spark, directory)))
    return _rounded(_rounded(model, "slope", "effect"), "intercept", "spread", digits=3)


@query
def forecast_future_frame(spark, directory):
    return forecast.future_frame(forecast.fit(_mrr(spark, directory)))


@query
def forecast_summary(spark, directory):
    return forecast.forecast_summary(forecast.predict(forecast.fit(_mrr(spark, directory))))


@query
def forecast_summary_additive(spark, directory):
    return forecast.forecast_summary(forecast.predict(forecast.fit(_mrr(spark, directory), mode="additive")))


@query
def forecast_future(spark, directory):
    return forecast.future_forecast(forecast.predict(forecast.fit(_mrr(spark, directory))))


@query
def forecast_by_segment(spark, directory):
    by = ("segment",)
    model = forecast.fit(mrr_by_month_and_segment(spark, directory), by=by)
    return forecast.future_forecast(forecast.predict(model, by=by), by=by)


@query
def forecast_bending_by_segment(spark, directory):
    """The future months of a trend that may bend, per segment."""
    by = ("segment",)
    model = forecast.fit(stage(mrr_by_month_and_segment(spark, directory), "series"), by=by, bends=BENDS)
    return forecast.future_forecast(forecast.predict(model, by=by), by=by)


@query
def forecast_bends_of_lines(spark, directory):
    """Straight series of every segment's months, fitted with bends: they keep the line of least squares."""
    by = ("segment",)
    months = month_number(F.col("date"))
    lines = mrr_by_month_and_segment(spark, directory).withColumn("MRR", months * F.length("segment") * 10.0 + 5000.0)
    model = forecast.fit(stage(lines, "series"), by=by, bends=BENDS)
    return model.select("segment", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"), F.coalesce(F.size("bends"), F.lit(0)).alias("n_bends"))


@query
def forecast_accuracy(spark, directory):
    return forecast.accuracy(forecast.predict(forecast.fit(_mrr(spark, directory))))


@query
def forecast_csv_export(spark, directory):
    """Export the forecast as CSV and read the file back."""
    path = export_dated_csv(forecast_summary(spark, directory).orderBy("date"), scratch_dir(spark), "forecast")
    text = load_file(spark, path)
    return text.select(F.col("date").cast("date").alias("date"), *[F.col(c).cast("double").alias(c) for c in text.columns[1:]])


@query
def forecast_mrr(spark, directory):
    return forecast.expected_mrr(forecast.predict(forecast.fit(_mrr(spark, directory))))


@query
def forecast_chart(spark, directory):
    return reporting.chart_data(forecast_summary(spark, directory))


@query
def stored_forecast(spark, directory):
    """Fit, store model, forecast and accuracy, and read all of it back: history, future and measures."""
    path = f"{scratch_dir(spark)}/forecast_model"
    forecast.save_model(forecast.fit(_mrr(spark, directory)), path)
    measures = forecast.load_accuracy(spark, path)
    rows = forecast.forecast_summary(forecast.load_forecast(spark, path))
    again = forecast.predict(forecast.load_model(spark, path)).select("date", F.col("predicted").alias("again"))
    return rows.join(again, "date").select(
        "date", "predicted", "lower_bound", "upper_bound", "actual",
        (F.col("predicted") == F.bround("again", 2)).alias("same_from_model"),
        *[measures.select(m).scalar().alias(m) for m in ("MAE", "RMSE", "MAPE")],
    )


@query
def forecast_in_one_call(spark, directory):
    """Fit, predict and measure per segment in one call; the future rows beside the measures of their series."""
    by = ("segment",)
    series = stage(mrr_by_month_and_segment(spark, directory), "series")
    _, future, measures = forecast.train_and_forecast(series, by=by)
    return future.join(measures, "segment")


# --- report tables ---------------------------------------------------------------------------


@query
def kpi_cards(spark, directory):
    return reporting.kpi_cards(revenue.dashboard_kpis(_periods(spark, directory)))


@query
def kpi_deltas(spark, directory):
    return reporting.kpi_deltas(revenue.dashboard_kpis(_periods(spark, directory)))


@query
def risk_table(spark, directory):
    return reporting.risk_table(scores.at_risk(_recency_risk(spark, directory)))


@query
def risk_display(spark, directory):
    display = reporting.risk_display(scores.at_risk(_recency_risk(spark, directory)), scores.TOP_N)
    return _rounded(display, "tenure_months")


@query
def risk_digest(spark, directory):
    return reporting.risk_digest(scores.at_risk(_recency_risk(spark, directory)))


@query
def narrative_inputs(spark, directory):
    results = dashboard(_periods(spark, directory))
    inputs = reporting.narrative_inputs(
        results["kpis"],
        forecast.expected_mrr(forecast.predict(forecast.fit(results["mrr_series"]))),
        scores.at_risk(_recency_risk(spark, directory)),
    )
    return _rounded(inputs, "churn_rate")


# --- churn models ------------------------------------------------------------------------------


def _trained(spark, directory, model_type):
    rows = stage(_features(spark, directory), "features")
    return churn.train(rows, model_type), rows


@query
def churn_logistic_scores(spark, directory):
    model, rows = _trained(spark, directory, "logistic")
    return model.score(rows)


@query
def churn_logistic_metrics(spark, directory):
    model, _ = _trained(spark, directory, "logistic")
    return spark.createDataFrame([tuple(model.metrics.values())], ", ".join(f"{m} double" for m in model.metrics))


@query
def churn_forest_importance(spark, directory):
    model, _ = _trained(spark, directory, "random_forest")
    return model.feature_importance(spark)


@query
def churn_model_at_risk(spark, directory):
    _, risky = churn.train_and_rank(_features(spark, directory))
    return risky


@query
def stored_churn_model(spark, directory):
    """Train, store and load again: of every customer the difference between the scores of the two models."""
    model, rows = _trained(spark, directory, "logistic")
    path = model.save(spark, f"{scratch_dir(spark)}/churn_model")
    loaded = churn.ChurnModel.load(spark, path)
    fresh = model.probabilities(rows).select("customer_id", "churn_probability")
    stored = loaded.probabilities(rows).select("customer_id", F.col("churn_probability").alias("stored"))
    return fresh.join(stored, "customer_id").select("customer_id", F.abs(F.col("churn_probability") - F.col("stored")).alias("difference"))


@query
def churn_forest_features(spark, directory):
    """The inputs of the forest: whether each importance is a share, and the sum of all."""
    model, _ = _trained(spark, directory, "random_forest")
    rows = model.feature_importance(spark)
    whole = rows.agg(F.round(F.sum("importance"), 6)).scalar()
    return rows.select("feature", F.col("importance").between(0, 1).alias("is_share"), whole.alias("total"))


def _one_input(spark, directory) -> tuple[DataFrame, DataFrame]:
    """All customers with the scores of the logistic model on the tenure alone, and the customers at risk by it."""
    rows = stage(_features(spark, directory), "features")
    model = churn.train(rows.select("customer_id", "churned", "tenure_days"), tolerance=1e-12)
    scored = model.score(rows)
    return scored, scores.at_risk(scored, min_probability=scores.CUTOFF)


def _to_solvers_digits(scored: DataFrame) -> DataFrame:
    """Two solvers of one model agree to about eight digits of a probability."""
    scored = _rounded(scored, "churn_probability", digits=4)
    return _rounded(_rounded(scored, "risk_score", digits=1), "tenure_months")


@query
def churn_one_input_scores(spark, directory):
    scored, _ = _one_input(spark, directory)
    return _to_solvers_digits(scored)


@query
def churn_one_input_at_risk(spark, directory):
    """The ranked list with the place of each customer."""
    _, risky = _one_input(spark, directory)
    place = F.row_number().over(Window.orderBy(F.desc("risk_score"), "customer_id"))
    return _to_solvers_digits(risky.withColumn("place", place))


@query
def churn_logistic_one_input(spark, directory):
    """The logistic model on the tenure alone: its line and the confusion counts of the held-out customers."""
    rows = stage(_features(spark, directory).select("customer_id", "churned", "tenure_days"), "features")
    model = churn.train(rows)
    held_out = model.probabilities(splits.stratified_split(rows).where("is_test"))
    line = model.pipeline.stages[-1]
    counts = scores.threshold_metrics(held_out).select("true_positives", "false_positives", "false_negatives", "true_negatives")
    return counts.select(
        F.round(F.lit(float(line.intercept)), 3).alias("intercept"), F.round(F.lit(float(line.coefficients[0])), 3).alias("slope"), "*"
    )
