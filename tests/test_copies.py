"""Removal of exact copies by counted hashes."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerpulse.operators import cleaning
from ledgerpulse.plans.catalog import raw_customers, raw_transactions
from ledgerpulse.sources import schemas

SCHEMA = "a string, b bigint, c double"


def contents(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("most", [cleaning.BROADCAST_HASHES, 0])
def test_every_row_stays_once(spark, most):
    rows = [("x", 1, 1.0), ("x", None, 1.0), (None, 1, None), ("", 1, None), (None, None, None)]
    rows += [("hot", 0, 0.0)] * 300 + rows[:3] + [(f"r{i}", i, None) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    assert contents(cleaning.drop_copies(df, most)) == Counter(set(rows))


def test_without_copies_and_empty(spark):
    df = spark.createDataFrame([("x", 1, 1.0), ("y", 1, 1.0)], SCHEMA)
    assert contents(cleaning.drop_copies(df)) == contents(df)
    assert "Exchange" not in cleaning.drop_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert cleaning.drop_copies(df.limit(0)).count() == 0


def test_rows_under_one_hash_all_stay(spark, monkeypatch):
    """Whatever collides, only whole rows are compared."""
    monkeypatch.setattr(cleaning, "row_hash", lambda columns: F.lit(1).cast("bigint"))
    rows = [("x", 1, 1.0), ("x", 1, 2.0), ("x", None, 1.0), ("x", 1, 1.0)]
    assert contents(cleaning.drop_copies(spark.createDataFrame(rows, SCHEMA))) == Counter(set(rows))


def test_hashes_tell_missing_from_present(spark):
    df = spark.createDataFrame([(None, "1"), ("1", None), (None, None), ("", "")], "a string, b string")
    found = df.select(cleaning.row_hash(["a", "b"]).alias("h")).collect()
    assert len(set(found)) == 4


def test_names_that_clash(spark):
    df = spark.createDataFrame([(1, 2, 3)] * 2 + [(1, 2, 4)], "_hash int, __hash int, `a.b` int")
    assert contents(cleaning.drop_copies(df)) == Counter({(1, 2, 3): 1, (1, 2, 4): 1})


def shuffled(spark, action):
    """Bytes that the action's shuffles wrote, by the plans that it ran."""
    sizes = []
    seen = spark._jsparkSession.sharedState().statusStore()
    before = seen.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for execution in range(before, seen.executionsCount()):
        for e in [seen.executionsList().apply(execution)]:
            metrics = seen.executionMetrics(e.executionId())
            names = {m.accumulatorId(): m.name() for m in (e.metrics().apply(i) for i in range(e.metrics().size()))}
            for accumulator, name in names.items():
                if name == "shuffle bytes written" and metrics.contains(accumulator):
                    size = re.match(r"(?:total[^\n]*\n)?([0-9.]+) (B|KiB|MiB|GiB)", metrics.apply(accumulator))
                    sizes.append(float(size[1]) * 1024 ** ["B", "KiB", "MiB", "GiB"].index(size[2]))
    return sum(sizes)


def test_shuffle_of_rows_without_copies_is_a_third_at_most(spark):
    data = "/root/testdata/sf0.01"
    typed = cleaning.coerce_types(raw_transactions(spark, data), schemas.TRANSACTIONS).cache()
    typed.count()
    whole = shuffled(spark, lambda: typed.dropDuplicates().write.format("noop").mode("overwrite").save())
    by_hash = shuffled(spark, lambda: cleaning.drop_copies(typed).write.format("noop").mode("overwrite").save())
    typed.unpersist()
    assert 0 < by_hash <= whole / 3, (by_hash, whole)


def test_copies_of_the_whole_table(spark, data):
    raw = raw_customers(spark, data)
    assert cleaning.clean(raw, schemas.CUSTOMERS).count() * 2 == raw.count()
