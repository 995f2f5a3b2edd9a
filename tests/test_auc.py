"""ROC-AUC as a table: brute force over pairs, ties, groups, ranges."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerpulse.operators import scores


def brute(rows):
    positives, negatives = [s for s, y in rows if y == 1], [s for s, y in rows if y == 0]
    if not positives or not negatives:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in positives for n in negatives) / (len(positives) * len(negatives))


def test_groups_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice([rng.random(), 0.5, 0.25, -1.0, 1e9]), rng.randrange(2)) for _ in range(900)]
    rows += [("one class", 0.1, 1), ("one class", 0.2, 1)]
    df = spark.createDataFrame(rows + [("a", None, 1), ("b", 0.3, None), ("c", float("nan"), 0)], "g string, churn_probability double, churned int")
    found = {r.g: r.auc for r in scores.roc_auc(df, by=("g",)).collect()}
    want = {g: brute([(s, y) for k, s, y in rows if k == g]) for g in {r[0] for r in rows}}
    assert found.keys() == want.keys()
    for g, auc in want.items():
        assert found[g] == (auc if auc is None else pytest.approx(auc, abs=1e-12))
    assert scores.roc_auc(df).first().auc == pytest.approx(brute([(s, y) for _, s, y in rows]), abs=1e-12)


def test_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [((i * 7919) % 4001 / 4001, int((i * 31) % 7 < 3)) for i in range(4001)]
        df = spark.createDataFrame(rows, "churn_probability double, churned int").repartition(5)
        assert scores.roc_auc(df).first().auc == pytest.approx(brute(rows), abs=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ten_million_ties(spark):
    df = spark.range(10_000_000).select((F.col("id") % 3 == 0).cast("int").alias("churned"), F.lit(0.25).alias("churn_probability"))
    assert scores.roc_auc(df).first().auc == 0.5
    ranked = df.withColumn("churn_probability", F.col("churned") / 2)
    assert scores.roc_auc(ranked).first().auc == 1.0


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, churn_probability double, churned int")
    assert scores.roc_auc(df, by=("g",)).collect() == [] and scores.roc_auc(df).first().auc is None


def test_it_is_lazy_and_ties_are_combined_first(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0)], "churn_probability double, churned int")
    plan = scores.roc_auc(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("rangepartitioning") < plan.index("partial_count")
