import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from ledgerpulse.operators import churn, features, scores, splits
from ledgerpulse.operators.merge import merge_datasets, transaction_summary


@pytest.fixture
def payments(spark):
    def build(rows):
        return spark.createDataFrame(rows, "customer_id string, amount double, day string").selectExpr(
            "customer_id", "amount", "cast(day as timestamp_ntz) as transaction_date"
        )

    return build


def test_merge_matches_missing_ids(periods, people, payments):
    subs = periods([(None, "2024-01-01", 1.0, 0), ("C1", "2024-01-01", 2.0, 0), ("C2", "2024-01-01", 3.0, 0)])
    customers = people([(None, "2023-01-01", "pro", "SMB", 9.0), ("C1", "2023-02-01", "basic", "Mid", 5.0)])
    txns = payments([("C1", 4.0, "2024-01-02"), ("C1", None, "2024-01-05"), ("C2", 6.0, "2024-01-03"), (None, 1.0, "2024-01-01")])
    rows = {r.customer_id: r for r in merge_datasets(subs, customers, txns).collect()}
    assert rows[None].plan == "pro" and rows[None].transaction_count is None
    assert (rows["C1"].total_transaction_amount, rows["C1"].transaction_count, rows["C1"].avg_transaction_amount) == (4.0, 1, 4.0)
    assert str(rows["C1"].last_transaction_date) == "2024-01-05 00:00:00"
    # a customer known from transactions only still gets its summary
    assert rows["C2"].plan is None and rows["C2"].total_transaction_amount == 6.0


def test_merge_keeps_overlapping_columns_and_double_listings(periods, people):
    subs = periods([("C1", "2024-01-01", 1.0, 0)]).withColumn("plan", F.lit("old"))
    customers = people([("C1", None, "pro", "SMB", 1.0), ("C1", None, "basic", "SMB", 1.0)])
    rows = merge_datasets(subs, customers).collect()
    assert sorted((r.plan, r.plan_customer) for r in rows) == [("old", "basic"), ("old", "pro")]


def test_transaction_summary_without_amounts(payments):
    row = transaction_summary(payments([("C1", None, "2024-01-01")])).first()
    assert (row.total_transaction_amount, row.transaction_count, row.avg_transaction_amount) == (0.0, 0, None)


def test_latest_non_missing_per_column(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        ('C1', 'S1', timestamp_ntz'2024-01-01 00:00:00', 1, 'x'),
        ('C1', 'S2', timestamp_ntz'2024-02-01 00:00:00', CAST(NULL AS INT), CAST(NULL AS STRING)),
        ('C1', 'S3', CAST(NULL AS TIMESTAMP_NTZ), CAST(NULL AS INT), 'z')
        AS t(customer_id, subscription_id, period_end, v, p)"""
    )
    row = features.latest_record(df).first()
    assert (row.v, row.p, row.subscription_id) == (1, "z", "S3")
    assert str(row.period_end) == "2024-02-01 00:00:00"


def test_latest_flag_ignores_missing_and_prefers_missing_dates(spark):
    df = spark.sql(
        """SELECT * FROM VALUES
        ('C1', 'S1', timestamp_ntz'2024-01-01 00:00:00', 1.0D, 1L),
        ('C1', 'S2', timestamp_ntz'2024-02-01 00:00:00', 1.0D, CAST(NULL AS BIGINT)),
        ('C2', 'S3', timestamp_ntz'2024-03-01 00:00:00', 1.0D, 0L),
        ('C2', 'S4', CAST(NULL AS TIMESTAMP_NTZ), 1.0D, 1L),
        ('C3', 'S5', timestamp_ntz'2024-03-01 00:00:00', 1.0D, 0L),
        ('C3', 'S6', timestamp_ntz'2024-03-01 00:00:00', 1.0D, 1L),
        ('C4', 'S7', timestamp_ntz'2024-03-01 00:00:00', 1.0D, 37L)
        AS t(customer_id, subscription_id, period_end, revenue, churn_flag)"""
    )
    people = spark.createDataFrame([], "customer_id string, signup_date timestamp_ntz")
    rows = {r.customer_id: r.churn_flag for r in features.customer_features(df, people).collect()}
    assert rows == {"C1": 1, "C2": 1, "C3": 1, "C4": 37}


def test_feature_values(periods, people):
    subs = periods([("C1", "2024-01-01", 10.0, 0), ("C1", "2024-01-31", 20.0, 0), ("C2", "2024-02-10", 7.0, 1), (None, "2024-05-01", 1.0, 0)])
    customers = people([("C1", "2024-05-16", "pro", "SMB", 99.0)])
    rows = {r.customer_id: r for r in features.customer_features(subs, customers).collect()}
    assert set(rows) == {"C1", "C2"}
    one, two = rows["C1"], rows["C2"]
    # the reference date is the latest end over all rows, also those without a customer: 2024-05-31
    assert one.days_since_last_activity == 91 and one.tenure_days == 15 and one.tenure_months == 0.5
    assert one.revenue_per_month == 30.0
    assert one.revenue_std == pytest.approx(statistics.stdev([10, 20]))
    assert (one.subscription_count, one.avg_revenue, one.min_revenue, one.max_revenue) == (2, 15.0, 10.0, 20.0)
    assert (one.churned, two.churned) == (0, 1)
    # a single row has no deviation, an unknown customer no tenure: both become 0
    assert (two.revenue_std, two.tenure_days, two.revenue_per_month, two.monthly_price) == (0.0, 0, 0.0, 0.0)


def test_features_carry_latest_columns(periods, people):
    subs = periods([("C1", "2024-01-01", 10.0, 0), ("C1", "2024-03-01", None, 0)])
    row = features.customer_features(subs, people([]), latest=("subscription_id", "period_start", "revenue")).first()
    assert (row.subscription_id, str(row.period_start), row.revenue) == ("S001", "2024-03-01 00:00:00", 10.0)


def test_label_from_active_when_there_is_no_flag(periods, people):
    subs = periods([("C1", "2024-01-01", 1.0, 1)]).drop("churn_flag")
    assert features.customer_features(subs, people([])).first().churned == 1


def test_both_feature_paths_agree(spark, periods, people):
    chance = random.Random(7)
    rows = [
        (f"C{chance.randrange(12)}", f"2024-{chance.randrange(1, 13):02d}-{chance.randrange(1, 28):02d}",
         chance.choice([None, float(chance.randrange(100))]), chance.randrange(2))
        for _ in range(120)
    ]
    subs = periods(rows).withColumns({"num_logins": F.length("subscription_id"), "feature_x_usage": F.col("revenue") / 3})
    # C1 is listed twice and C2 not at all
    customers = people([("C1", "2023-05-01", "pro", "SMB", 9.0)] * 2 + [(f"C{i}", "2023-01-01", "basic", "Mid", 5.0) for i in range(3, 12)])
    a = features.customer_features(subs, customers)
    b = features.features_from_merged(merge_datasets(subs, customers))
    assert sorted(a.columns) == sorted(b.columns)
    left, right = ({r.customer_id: r.asDict() for r in df.collect()} for df in (a, b))
    assert left.keys() == right.keys()
    for customer, values in left.items():
        for column, value in values.items():
            other = right[customer][column]
            assert value == pytest.approx(other) if isinstance(value, float) else value == other, (customer, column)


def test_one_hot_is_all_zero_for_missing_and_unknown(spark):
    df = spark.createDataFrame([("a",), ("c",), (None,)], "plan string")
    assert churn.learned_categories(df) == {"plan": ["a", "c"]}
    rows = features.one_hot(df, "plan", ["a", "b"]).collect()
    assert [(r.plan_a, r.plan_b) for r in rows] == [(1, 0), (0, 0), (0, 0)]
    assert features.select_features(features.one_hot(df, "plan", ["a"])) == ["plan_a"]


def test_many_categories(spark):
    rows = spark.range(2000).selectExpr("cast(id as string) as plan")
    assert len(churn.learned_categories(rows)["plan"]) == 2000


def test_two_different_listings_have_one_profile(spark, periods, people):
    subs = periods([("C1", "2024-01-01", 5.0, 0), ("C1", "2024-02-01", 7.0, 0), ("C2", "2024-01-01", 1.0, 1)])
    customers = people([
        ("C1", "2023-01-01", "pro", "SMB", 99.0), ("C1", "2023-06-01", "enterprise", "Mid", 499.0),
        ("C2", "2023-06-01", None, "Mid", 499.0), ("C2", "2023-01-01", "pro", "SMB", 99.0),
    ])
    for rows in (features.customer_features(subs, customers), features.features_from_merged(merge_datasets(subs, customers))):
        found = {r.customer_id: (r.plan, r.segment, r.monthly_price, r.signup_date.month, r.subscription_count) for r in rows.collect()}
        assert found == {"C1": ("enterprise", "Mid", 499.0, 6, 4), "C2": ("pro", "Mid", 499.0, 6, 2)}


def test_flags_and_far_dates_keep_their_order(spark):
    rows = [("C1", "2024-01-01", 33), ("C1", "2024-01-01", 40), ("C2", "+29999-01-01", 1), ("C2", "2024-01-01", 0), ("C3", "2024-01-01", -5), ("C3", None, -7)]
    subs = spark.createDataFrame(rows, "customer_id string, e string, churn_flag bigint").selectExpr(
        "*", "cast(e as timestamp_ntz) as period_end", "cast(e as timestamp_ntz) as period_start", "1.0D as revenue"
    )
    latest = subs.groupBy("customer_id").agg(features._latest_flag("churn_flag"))
    assert {r.customer_id: r.churn_flag for r in latest.collect()} == {"C1": 40, "C2": 1, "C3": -7}


def test_labels_must_be_0_or_1(spark):
    rows = spark.createDataFrame([(f"C{i}", i % 3, float(i)) for i in range(30)], "customer_id string, churned bigint, tenure_days double")
    with pytest.raises(ValueError, match="other than 0 and 1"):
        churn.train(rows)


@pytest.mark.parametrize("rows,share", [(1000, 0.2), (37, 0.5), (3, 0.2), (20000, 0.01)])
def test_split_takes_the_exact_share_of_each_class(spark, rows, share):
    df = spark.range(rows).selectExpr("cast(id as string) as customer_id", "cast(id < 0.3 * %d as int) as churned" % rows)
    split = splits.stratified_split(df, test_size=share)
    counts = split.groupBy("churned").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert sum(r.n for r in counts) == rows
    assert all(r.t == round(share * r.n) for r in counts)
    # the test part holds the smallest hashes of the class
    extremes = split.withColumn("h", F.md5(F.concat("customer_id", F.lit("42")))).groupBy("churned").agg(
        F.max(F.when(F.col("is_test"), F.col("h"))).alias("last"), F.min(F.when(~F.col("is_test"), F.col("h"))).alias("first")
    )
    assert all(r.last is None or r.last < r["first"] for r in extremes.collect())


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "churned int")
    assert {r.churned: r.class_weight for r in splits.class_weights(df).collect()} == {0: pytest.approx(4 / 6), 1: 2.0}
    assert splits.label_base_rate(df).first().base_rate == 0.25


def test_auc_counts_ties_half(spark):
    chance = random.Random(3)
    rows = [(chance.randrange(2), chance.randrange(8) / 8) for _ in range(200)]
    positives, negatives = ([s for y, s in rows if y == k] for k in (1, 0))
    expected = sum((p > n) + (p == n) / 2 for p in positives for n in negatives) / (len(positives) * len(negatives))
    df = spark.createDataFrame(rows, "churned int, churn_probability double")
    assert scores.roc_auc(df).first().auc == pytest.approx(expected)


def test_threshold_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.8), (0, 0.1)], "churned int, churn_probability double")
    row = scores.threshold_metrics(df).first()
    assert (row.precision, row.recall, row.f1, row.true_negatives) == (0.5, 0.5, 0.5, 1)
    assert tuple(scores.threshold_metrics(df.where("churned = 0 and churn_probability < 0.5")).first())[4:] == (0.0, 0.0, 0.0)


def test_revenue_column_of_the_risk_score(spark):
    df = spark.createDataFrame([("C1", 0.5, 10.0, 4.0, 3.0)], "customer_id string, churn_probability double, monthly_price double, avg_revenue double, tenure_months double")
    assert scores.with_risk(df).first().risk_score == 5.0
    assert scores.with_risk(df.drop("monthly_price")).first().risk_score == 2.0
    bare = scores.with_risk(df.drop("monthly_price", "avg_revenue")).first()
    assert (bare.current_revenue, bare.risk_score, bare.active) == (0.0, 0.0, True)


def test_at_risk_is_ordered_and_above_the_threshold(spark):
    rows = [(f"C{i:02d}", i / 40, 100.0 - i, 1.0, True, (i / 40) * (100.0 - i)) for i in range(40)]
    df = spark.createDataFrame(rows, "customer_id string, churn_probability double, current_revenue double, tenure_months double, active boolean, risk_score double")
    top = scores.at_risk(df, top_n=5).collect()
    assert len(top) == 5 and all(r.churn_probability >= 0.7 for r in top)
    assert [r.risk_score for r in top] == sorted((r.risk_score for r in top), reverse=True)


@pytest.fixture(scope="module")
def separable(spark):
    """Customers whose label follows their logins."""
    chance = random.Random(11)
    rows = []
    for i in range(240):
        churned = int(i % 3 == 0)
        rows.append((f"C{i:03d}", churned, 2.0 + chance.random() if churned else 8.0 + chance.random(), 10.0 * chance.random(),
                     chance.choice(["pro", "basic", None]), "SMB"))
    return spark.createDataFrame(rows, "customer_id string, churned int, avg_logins double, monthly_price double, plan string, segment string").withColumn("tenure_months", F.lit(3.0))


def test_logistic_model(spark, separable, tmp_path):
    model, risky = churn.train_and_rank(separable, path=str(tmp_path / "model"))
    assert model.metrics["auc"] == pytest.approx(1.0)
    assert model.metrics["f1"] == pytest.approx(1.0)
    assert model.feature_names == ["tenure_months", "monthly_price", "avg_logins", "plan_basic", "plan_pro", "segment_SMB"]
    assert len(model.feature_names) == model.pipeline.stages[-1].numFeatures
    assert risky.count() == 20
    loaded = churn.ChurnModel.load(spark, str(tmp_path / "model"))
    assert loaded.metrics == model.metrics and loaded.feature_names == model.feature_names
    # categories are frozen: an unknown plan scores like a missing one
    one = separable.limit(1).drop("plan")
    probability = [
        loaded.score(one.withColumn("plan", F.lit(p).cast("string"))).first().churn_probability for p in ("unheard of", None)
    ]
    assert probability[0] == probability[1]
    assert loaded.feature_importance(spark).count() == 0


def test_logistic_penalty_is_one_unit_of_weight(separable):
    """The gradient of (weighted log loss + half the squared coefficients) vanishes at the fitted model."""
    split = splits.stratified_split(separable).where("not is_test")
    n, p = split.agg(F.count("*"), F.sum("churned")).first()
    weighted = churn.with_class_weight(split, p, n)
    from pyspark.ml import Pipeline

    fitted = Pipeline(stages=[*churn.feature_stages(separable), churn.classifier("logistic", n)]).fit(weighted)
    beta = fitted.stages[-1].coefficients.toArray()
    gradient = beta.copy()
    for row in fitted.transform(weighted).collect():
        gradient += row.class_weight * (row.probability[1] - row.churned) * row.features.toArray()
    assert max(abs(gradient)) < 1e-3 * max(1.0, max(abs(beta)))


def test_forest_model(spark, separable):
    model = churn.train(separable, "random_forest")
    assert model.metrics["auc"] == pytest.approx(1.0)
    importance = model.feature_importance(spark).collect()
    assert importance[0].feature == "avg_logins"
    assert math.isclose(sum(r.importance for r in importance), 1.0)


def test_training_needs_both_classes(separable):
    with pytest.raises(ValueError, match="both classes"):
        churn.train(separable.where("churned = 0"))
