import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import whole_days
from ledgerpulse.functions.numbers import at_least, half_even
from ledgerpulse.operators import cohorts, revenue


def by_date(df, column):
    return {str(r["date"]): r[column] for r in df.collect()}


def test_months_without_values_sum_to_zero(periods):
    assert by_date(revenue.mrr_series(periods([("C1", "2024-01-05", None, 0)])), "MRR") == {"2024-01-01": 0.0}


def test_only_active_periods_with_a_start_count(periods):
    df = periods([("C1", "2024-01-05", 5.0, 0), ("C2", "2024-01-09", 7.0, 1), ("C3", None, 9.0, 0)])
    assert by_date(revenue.mrr_series(df), "MRR") == {"2024-01-01": 5.0}


def test_missing_customer_is_not_counted(periods):
    df = periods([(None, "2024-01-01", 4.0, 1), ("C1", "2024-01-02", 6.0, 0), (None, "2024-01-03", 2.0, 0)])
    row = revenue.churn_series(df).first()
    assert (row.customers_start, row.churned, row.churn_rate) == (1, 0, 0.0)
    assert by_date(revenue.arpu_series(df), "ARPU") == {"2024-01-01": 8.0}
    assert revenue.active_customers(df).first()[0] == 1
    assert revenue.lifetime_value(df, "cohort").first().clv == 6.0


def test_churn_counts_customers_not_rows(periods):
    df = periods([("C1", "2024-01-01", 1.0, 1), ("C1", "2024-01-20", 1.0, 1), ("C2", "2024-02-01", 1.0, 0)])
    assert by_date(revenue.churn_series(df), "churn_rate") == {"2024-01-01": 100.0, "2024-02-01": 0.0}
    quarter = revenue.churn_series(df, "quarterly").first()
    assert (quarter.period, quarter.customers_start, quarter.churned) == ("2024Q1", 2, 1)


def test_growth_compares_months_present(periods):
    df = periods([("C1", "2024-01-01", 10.0, 0), ("C1", "2024-03-01", 15.0, 0)])
    assert tuple(revenue.growth_metrics(df).first()) == (50.0, 0.0)


def test_quarter_growth_with_short_earlier_quarter(periods):
    df = periods([("C1", f"2024-0{m}-01", float(m), 0) for m in (1, 2, 3, 4)])
    assert revenue.growth_metrics(df).first().mrr_growth_qoq == 200.0


def test_growth_is_zero_after_a_zero_month(periods):
    df = periods([("C1", "2024-01-01", 0.0, 0), ("C1", "2024-02-01", 5.0, 0)])
    assert revenue.growth_metrics(df).first().mrr_growth_mom == 0.0


def test_kpis(periods):
    df = periods(
        [("C1", "2024-01-01", 10.0, 0), ("C2", "2024-01-02", 30.0, 0), ("C1", "2024-02-01", 20.0, 0),
         ("C2", "2024-02-03", 30.0, 1)]
    )
    kpis = revenue.dashboard_kpis(df).first().asDict()
    assert kpis == {
        "current_mrr": 20.0, "arr": 240.0, "mrr_growth_mom": -50.0, "active_customers": 2, "arpu": 20.0,
        "clv": 40.0, "churn_rate": 50.0, "retention_rate": 50.0,
    }


def test_latest_churn_month_may_have_no_active_rows(periods):
    df = periods([("C1", "2024-01-01", 10.0, 0), ("C1", "2024-02-01", 10.0, 1)])
    kpis = revenue.dashboard_kpis(df).first()
    assert (kpis.current_mrr, kpis.arpu, kpis.churn_rate) == (10.0, 10.0, 100.0)
    assert kpis.current_mrr == revenue.current_revenue(df).first().current_mrr
    assert kpis.arpu == revenue.current_arpu(df).first().arpu
    assert kpis.mrr_growth_mom == revenue.growth_metrics(df).first().mrr_growth_mom == 0.0


def test_lifetime_without_churn(periods):
    assert revenue.lifetime_value(periods([("C1", "2024-01-01", 10.0, 0)])).first().clv == 360.0


def test_no_rows(periods):
    empty = periods([])
    kpis = revenue.dashboard_kpis(empty).first()
    assert (kpis.current_mrr, kpis.arr, kpis.mrr_growth_mom, kpis.active_customers) == (0.0, 0.0, 0.0, 0)
    assert tuple(revenue.current_revenue(empty).first()) == (0.0, 0.0)
    assert tuple(revenue.growth_metrics(empty).first()) == (0.0, 0.0)
    assert revenue.current_churn_rate(empty).first().churn_rate == 0.0


def test_series_per_group(periods):
    df = periods([("C1", "2024-01-01", 1.0, 0), ("C2", "2024-01-01", 2.0, 0)]).withColumn("plan", F.col("customer_id"))
    rows = {r.plan: r.MRR for r in revenue.mrr_series(df, by=("plan",)).collect()}
    assert rows == {"C1": 1.0, "C2": 2.0}
    assert revenue.churn_series(df, by=("plan",)).count() == 2


def test_numbers_per_group_equal_those_of_the_group_alone(periods):
    rows = [(f"C{i % 5}", f"2024-0{1 + i % 4}-05", float(i), int(i % 7 == 0)) for i in range(40)]
    rows += [("C9", "2024-02-01", 3.0, 1)]
    df = periods(rows).withColumn("plan", F.when(F.col("customer_id") < "C2", "pro").when(F.col("customer_id") < "C5", "basic"))
    by = ("plan",)
    for function in (revenue.dashboard_kpis, revenue.growth_metrics, revenue.current_revenue, revenue.current_arpu,
                     revenue.current_churn_rate, revenue.active_customers):
        grouped = {r["plan"]: tuple(r)[1:] for r in function(df, by=by).collect()}
        for plan, values in grouped.items():
            alone = function(df.where(F.col("plan").eqNullSafe(plan))).first()
            assert values == pytest.approx(tuple(alone)), (function.__name__, plan)
    assert {r["plan"] for r in revenue.dashboard_kpis(df, by=by).collect()} == {"pro", "basic", None}


def test_attribute_series_counts_double_listings_twice(periods, people):
    df = periods([("C1", "2024-01-01", 1.0, 0), ("C2", "2024-01-01", 2.0, 0)])
    customers = people([("C1", None, "pro", "SMB", 1.0), ("C1", None, "pro", "SMB", 2.0)])
    rows = {r.plan: r.MRR for r in revenue.mrr_by_attribute(df, customers, "plan").collect()}
    assert rows == {"pro": 2.0, None: 2.0}


@pytest.mark.parametrize("query", ["mrr", "retention"])
def test_identities(spark, data, query):
    from ledgerpulse.sources import star

    df = star.subscriptions(spark, data, usage=False, renewals=False)
    if query == "mrr":
        active = df.where("active").agg(F.sum("revenue").cast("double")).first()[0]
        assert revenue.mrr_series(df).agg(F.sum("MRR")).first()[0] == pytest.approx(active)
    else:
        rows = revenue.retention_series(df).collect()
        assert all(r.churn_rate + r.retention_rate == pytest.approx(100) for r in rows)


def test_cohort_retention_can_exceed_100(periods, people):
    df = periods([("C1", "2024-01-01", 1.0, 0), ("C1", "2024-01-31", 1.0, 0)])
    grid = cohorts.cohort_grid(df, people([("C1", "2024-01-01", "pro", "SMB", 1.0)])).collect()
    assert [(r.months_since_signup, r.customer_id, r.active, r.cohort_size, r.retention_rate) for r in grid] == [
        (0, 1, 2, 1, 200.0)
    ]


def test_cohort_size_counts_every_customer_once(periods, people):
    df = periods(
        [("C1", "2024-02-01", 1.0, 0), ("C1", "2024-03-05", 1.0, 1), ("C2", "2024-03-01", 1.0, 0), ("C9", "2024-03-01", 1.0, 0)]
    )
    customers = people(
        [("C1", "2024-01-05", "pro", "SMB", 1.0), ("C2", "2024-01-20", "pro", "SMB", 1.0), ("C3", "2024-01-20", "pro", "SMB", 1.0),
         ("C4", None, "pro", "SMB", 1.0)]
    )
    grid = {r.months_since_signup: r for r in cohorts.cohort_grid(df, customers).collect()}
    assert {m: (r.customer_id, r.active, r.cohort_size) for m, r in grid.items()} == {1: (1, 1, 2), 2: (2, 1, 2)}
    assert grid[1].cohort == dt.date(2024, 1, 1)
    assert cohorts.cohort_sizes(df, customers).first().cohort_size == 2


def test_cohorts_match_missing_ids_and_double_listings(periods, people):
    df = periods([(None, "2024-02-01", 1.0, 0), ("C1", "2024-02-01", 1.0, 0)])
    customers = people(
        [(None, "2024-01-01", "pro", "SMB", 1.0), ("C1", "2024-01-01", "pro", "SMB", 1.0), ("C1", "2024-01-15", "pro", "SMB", 1.0)]
    )
    row = cohorts.cohort_grid(df, customers).first()
    # the missing id adds an active row, the double listing a second one; neither adds a customer
    assert (row.customer_id, row.active, row.cohort_size) == (1, 3, 1)


def test_whole_days_rounds_down(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 23:00:00' AS a, timestamp_ntz'2024-01-03 01:00:00' AS b"
    )
    assert tuple(df.select(whole_days(F.col("b"), F.col("a")), whole_days(F.col("a"), F.col("b"))).first()) == (1, -2)


def test_half_even_and_lower_bound(spark):
    df = spark.sql("SELECT 0.125D AS x, CAST(NULL AS DOUBLE) AS missing, 0.5D AS small, 3.0D AS large")
    row = df.select(
        half_even(F.col("x"), 2), at_least(F.col("missing"), 1.0), at_least(F.col("small"), 1.0), at_least(F.col("large"), 1.0)
    ).first()
    assert tuple(row) == (0.12, None, 1.0, 3.0)
