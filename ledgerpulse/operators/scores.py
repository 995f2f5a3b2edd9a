"""Quality of a score column and ranking of customers by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.numbers import ratio

# Score from which a customer is high risk, length of the ranked
# list, and score above which a customer is predicted to churn.
HIGH_RISK = 0.7
TOP_N = 20
CUTOFF = 0.5


def roc_auc(
    scored: DataFrame, label: str = "churned", score: str = "churn_probability", by: tuple[str, ...] = ()
) -> DataFrame:
    """Exact area under the ROC curve, of each group of ``by``; missing where a class is.

    It is the share of pairs of a positive and a negative row in which the positive has the higher score, ties counting
    half. Rows of one score are combined first, so ties never travel row by row. The scores are dealt out by ranges; a range
    adds the pairs inside it and its totals, and the negatives below a range are a sum over the few totals before it.
    """
    positive = F.col(label) == 1
    known = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    counts = known.groupBy(*by, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(positive).cast("decimal(19,0)").alias("_pos"), F.count_if(~positive).cast("decimal(19,0)").alias("_neg")
    )
    # the number of a range is taken once and travels with its rows
    ranges = counts.repartitionByRange(*by, "_score").withColumn("_range", F.spark_partition_id())
    inside = Window.partitionBy(*by, "_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # each pair counts two, so that half a pair is a whole number
    below = (F.sum("_neg").over(inside) * 2 - F.col("_neg")).cast("decimal(20,0)")
    pairs = (F.col("_pos") * below).cast("decimal(38,0)")
    totals = (
        ranges.withColumn("_pairs", pairs)
        .groupBy(*by, "_range")
        .agg(F.sum("_pairs").alias("_pairs"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    )
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_neg").over(before), F.lit(0)).cast("decimal(19,0)")
    whole = totals.withColumn("_pairs", F.col("_pairs") + (F.col("_pos") * earlier * 2).cast("decimal(38,0)")).groupBy(*by)
    won, positives, negatives = (F.sum(c).cast("double") for c in ("_pairs", "_pos", "_neg"))
    return whole.agg(F.try_divide(won, positives * negatives * 2).alias("auc"))


def threshold_metrics(
    scored: DataFrame, label: str = "churned", score: str = "churn_probability", cutoff: float = CUTOFF
) -> DataFrame:
    """Confusion counts, precision, recall and F1 of the positive class above ``cutoff``; 0 where undefined."""
    positive, predicted = F.col(label) == 1, F.col(score) > cutoff
    hits, false_alarms, misses = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")

    def or_zero(value):
        return F.coalesce(value, F.lit(0.0))

    return scored.agg(
        F.count_if(positive & predicted).alias("true_positives"),
        F.count_if(~positive & predicted).alias("false_positives"),
        F.count_if(positive & ~predicted).alias("false_negatives"),
        F.count_if(~positive & ~predicted).alias("true_negatives"),
    ).withColumns(
        {
            "precision": or_zero(ratio(hits, hits + false_alarms)),
            "recall": or_zero(ratio(hits, hits + misses)),
            "f1": or_zero(ratio(hits * 2, hits * 2 + false_alarms + misses)),
        }
    )


def with_risk(features: DataFrame, score: str = "churn_probability") -> DataFrame:
    """Customer, probability, current revenue, tenure, activity and risk score.

    Which column is the current revenue is decided by the columns present, not row by row.
    """
    revenue = next((F.col(c) for c in ("monthly_price", "avg_revenue") if c in features.columns), F.lit(0.0))
    active = F.col("active") if "active" in features.columns else F.lit(True)
    return features.select(
        "customer_id",
        F.col(score).alias("churn_probability"),
        revenue.alias("current_revenue"),
        "tenure_months",
        active.alias("active"),
        (F.col(score) * revenue).alias("risk_score"),
    )


def rank_by_risk(scored: DataFrame) -> DataFrame:
    return scored.orderBy(F.desc("risk_score"), "customer_id")


def at_risk(scored: DataFrame, top_n: int = TOP_N, min_probability: float = HIGH_RISK) -> DataFrame:
    """The ``top_n`` riskiest of the customers at or above the threshold."""
    return rank_by_risk(scored.where(F.col("churn_probability") >= min_probability)).limit(top_n)
