"""Every query with a SQL twin returns the same rows as DuckDB does."""

import math

import duckdb
import pytest

from ledgerpulse.plans.catalog import QUERIES
from ledgerpulse.plans.oracle import ORACLES

TABLES = ("region", "nation", "customer", "orders", "lineitem")


@pytest.fixture(scope="module")
def duck(data):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data}/{table}.parquet')")
    return connection


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, data, name):
    result = QUERIES[name](spark, data)
    columns = sorted(result.columns)
    mine = sorted([tuple(row[c] for c in columns) for row in result.collect()], key=repr)
    answer = duck.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(row[names.index(c)] for c in columns) for row in answer.fetchall()], key=repr)
    assert len(mine) == len(theirs)
    assert mine, "an empty result checks nothing"
    for left, right in zip(mine, theirs):
        assert all(same(a, b) for a, b in zip(left, right)), (left, right)


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
