"""Stratified train/test split and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEST_SIZE = 0.2
SEED = 42


def stratified_split(
    df: DataFrame, label: str = "churned", key: str = "customer_id", test_size: float = TEST_SIZE, seed: int = SEED
) -> DataFrame:
    """Add ``is_test``: per class, exactly the rounded share of rows with the smallest key hashes.

    Ranking all rows of a class would sort them in one task. Instead rows are
    counted per leading 16 bits of the hash, which finds the bucket where the
    share ends; only that bucket is ranked, to find the last hash inside. Marking
    the rows is then a comparison with one threshold per class. There are two
    classes, so the broadcast tables have at most two rows.
    """
    hashed = df.withColumns(
        {
            "_class": F.coalesce(F.col(label) == 1, F.lit(False)),
            "_hash": F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))),
        }
    )
    bucket = F.substring("_hash", 1, 4)
    so_far = Window.partitionBy("_class").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        hashed.groupBy("_class", bucket.alias("_bucket"))
        .agg(F.count("*").alias("_rows"))
        .withColumns(
            {
                "_before": F.coalesce(F.sum("_rows").over(so_far), F.lit(0)),
                "_quota": F.bround(F.sum("_rows").over(Window.partitionBy("_class")) * F.lit(test_size)).cast("bigint"),
            }
        )
        .where((F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_rows")))
        .select("_class", "_bucket", (F.col("_quota") - F.col("_before")).alias("_take"))
    )
    in_bucket = Window.partitionBy("_class").orderBy("_hash", key)
    threshold = (
        hashed.select("_class", "_hash", key, bucket.alias("_bucket"))
        .join(F.broadcast(edge), ["_class", "_bucket"])
        .withColumn("_rank", F.row_number().over(in_bucket))
        .where("_rank = _take")
        .select("_class", F.struct("_hash", key).alias("_last"))
    )
    return (
        hashed.join(F.broadcast(threshold), "_class", "left")
        .withColumn("is_test", F.coalesce(F.struct("_hash", key) <= F.col("_last"), F.lit(False)))
        .drop("_class", "_hash", "_last")
    )


def class_weights(df: DataFrame, label: str = "churned") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("row_count"))
    sums = counts.agg(F.struct(F.sum("row_count").alias("n"), F.count("*").alias("k"))).scalar()
    return (
        counts.withColumn("_all", sums)
        .withColumn("class_weight", F.col("_all.n") / (F.col("_all.k") * F.col("row_count")))
        .drop("_all")
    )


def label_base_rate(df: DataFrame, label: str = "churned") -> DataFrame:
    return df.agg(F.avg(F.col(label).cast("double")).alias("base_rate"))
