"""Physical plans: what is pushed down, what is shuffled, and what a hot key does."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerpulse.operators import features, revenue
from ledgerpulse.operators.merge import merge_datasets
from ledgerpulse.operators.splits import stratified_split
from ledgerpulse.plans import analysis
from ledgerpulse.plans.catalog import QUERIES, raw_customers, raw_subscriptions
from ledgerpulse.session import scratch_dir, stage
from ledgerpulse.sources import star
from ledgerpulse.sources.files import export_csv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Change session settings for one test."""
    before = {}

    def change(**conf):
        for key, value in conf.items():
            name = key.replace("__", ".")
            before[name] = spark.conf.get(name)
            spark.conf.set(name, value)

    yield change
    for name, value in before.items():
        spark.conf.set(name, value)


def test_mrr_scans_three_columns_and_shuffles_once(spark, data):
    text = plan(revenue.mrr_series(star.subscriptions(spark, data, usage=False, renewals=False)))
    assert text.count("Exchange") == 1
    assert "PushedFilters: [IsNotNull(o_orderstatus), Not(EqualTo(o_orderstatus,F))" in text
    assert "ReadSchema: struct<o_orderstatus:string,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_features_hash_and_combine_before_the_shuffle(spark, data):
    subs = star.subscriptions(spark, data, usage=False, renewals=False)
    rows = subs.where("customer_id is not null").groupBy("customer_id").agg(*features._activity(subs))
    text = plan(rows)
    assert "SortAggregate" not in text and "partial_sum" in text and text.count("Exchange") == 1


def test_no_query_uses_a_cross_join_or_python_rows(spark, data, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    eager = re.compile("churn_|stored_|.*csv|.*roc|file_formats|directory_")
    for name, query in QUERIES.items():
        if not eager.match(name):
            text = plan(query(spark, data))
            assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|Python", text), name


def test_dashboard_scans_the_orders_once(spark, data, settings):
    settings(spark__sql__autoBroadcastJoinThreshold="-1")
    assert plan(QUERIES["dashboard_kpis"](spark, data)).count("FileScan") == 1
    # by segment: the periods are summed per customer and month, then meet the customers
    text = plan(QUERIES["dashboard_kpis_by_segment"](spark, data))
    assert text.count("FileScan") == 2 and text.count("SortMergeJoin") == 1
    join = text.index("SortMergeJoin")
    assert "partial_sum" in text[join:] and text[join:].count("HashAggregate") == 2


def test_split_moves_no_whole_class_to_one_task(spark):
    df = stage(spark.range(1000).selectExpr("cast(id as string) as customer_id", "cast(id % 3 = 0 as int) as churned"), "split_input")
    text = plan(stratified_split(df))
    marking = text.split("BroadcastExchange")[0]
    assert "Exchange" not in marking and "Window" not in marking


def hot_subscriptions(spark, rows=60000):
    """A third of all rows belongs to one customer and a third to none."""
    return spark.range(0, rows, 1, 8).selectExpr(
        "concat('S', id) as subscription_id",
        "case when id % 3 = 0 then 'HOT' when id % 3 = 1 then null else concat('C', id) end as customer_id",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 90 as int)) as period_start",
        "timestamp_ntz'2024-01-31 00:00:00' + make_dt_interval(cast(id % 90 as int)) as period_end",
        "cast(id % 7 as double) as revenue",
        "cast(id % 2 as bigint) as churn_flag",
        "id % 2 = 0 as active",
        "repeat(uuid(), 4) as padding",
    )


def hot_customers(spark):
    return spark.range(0, 2000).selectExpr(
        "case when id = 0 then 'HOT' else concat('C', id * 3 + 2) end as customer_id",
        "timestamp_ntz'2023-12-05 00:00:00' as signup_date", "'pro' as plan", "'SMB' as segment", "9.0D as monthly_price",
    )


def test_merge_splits_hot_and_missing_ids(spark, settings):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    merged = merge_datasets(hot_subscriptions(spark), hot_customers(spark))
    rows = merged.collect()
    assert "SortMergeJoin(skew=true)" in plan(merged)
    assert len(rows) == 60000
    assert sum(r.customer_id == "HOT" and r.plan == "pro" for r in rows) == 20000
    assert all(r.plan is None for r in rows if r.customer_id is None)


def test_renewals_split_a_hot_customer(spark, settings, tmp_path):
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="100k",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
    )
    spark.range(0, 60000, 1, 8).selectExpr(
        "id as o_orderkey", "case when id % 3 = 0 then 7 else id end as o_custkey", "'O' as o_orderstatus",
        "cast(hash(id) as double) as o_totalprice",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(90 - id % 90 as int)) as o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    subs = star.subscriptions(spark, str(tmp_path), usage=False)
    rows = subs.collect()
    assert "SortMergeJoin(skew=true)" in plan(subs)
    assert len(rows) == 60000
    # the first order of customer 7 is the earliest by date, then by key
    assert sum(not r.is_renewal for r in rows if r.customer_id == "7") == 1
    assert sum(r.is_renewal for r in rows) == 20000


def test_hot_customer_is_combined_before_the_shuffle(spark):
    rows = features.customer_features(hot_subscriptions(spark), hot_customers(spark))
    hot = rows.where("customer_id = 'HOT'").first()
    assert hot.subscription_count == 20000
    activity = revenue.period_activity(hot_subscriptions(spark))
    assert activity.agg(F.sum("active_rows")).first()[0] == 30000


def test_stage_uses_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_dir(spark).startswith(shared)
    df = stage(spark.range(3).selectExpr("id", "id = 1 as flag"), "numbers")
    assert "FileScan" in plan(df) and shared in df.inputFiles()[0] and df.count() == 3


def test_load_and_analyse_from_csv(spark, data, tmp_path):
    export_csv(raw_customers(spark, data).drop("batch"), f"{tmp_path}/customers.csv")
    export_csv(raw_subscriptions(spark, data), f"{tmp_path}/subscriptions.csv")
    dataset = analysis.load_all_data(spark, f"{tmp_path}/customers.csv", f"{tmp_path}/subscriptions.csv", staged=True, multiline=True)
    assert dataset.summary().first().transactions_count == 0
    assert dataset.quality_scores().count() == 2 and dataset.quality_report().count() > 0
    assert dataset.merged().count() == dataset.subscriptions.count()
    results = analysis.run_analysis(dataset)
    kpis = results["kpis"].first()
    assert kpis.arr == kpis.current_mrr * 12
    assert kpis.current_mrr == results["mrr_series"].orderBy(F.desc("date")).first().MRR
    assert results["future_forecast"].count() == 3 and results["kpi_cards"].count() == 6
    assert set(results["churn_model"].metrics) == {"auc", "precision", "recall", "f1"}
    assert results["at_risk"].count() <= 20 and results["risk_digest"].count() == 1
    assert results["narrative_inputs"].first().at_risk_count == results["at_risk"].count()


def test_load_requires_the_declared_columns(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id\nC1\n")
    with pytest.raises(ValueError, match="signup_date"):
        analysis.load_table(spark, f"{tmp_path}/customers.csv", "customers")
