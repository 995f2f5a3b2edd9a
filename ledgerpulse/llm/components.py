"""Connected components of a graph whose links are a table, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerpulse.session import stage


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one type): root is the smallest node it reaches.

    Rounds of large-star and small-star steps, each written to the shared
    folder, until the links no longer change. A step groups by node, which is
    combined before the shuffle, and joins two stored tables, so that a node
    with very many links is split by the adaptive skew join.
    """
    links = stage(_ordered(links), "links")
    size = None
    while True:
        links = _star(_star(links, large=True), large=False)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == size:
            break
        size = state
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.withColumn("root", F.col("node"))).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    a, b = F.col("a"), F.col("b")
    return links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (large) or smaller (small) neighbours to the smallest of itself and its neighbours."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")
    joined = both.join(least, "a")
    if large:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return stage(_ordered(moved), "star")
