"""Dates in several formats: how cells are read, and how the cells of a column decide between day and month."""

import datetime as dt
import logging

import pytest
from pyspark.sql import functions as F

from ledgerpulse.functions import coerce
from ledgerpulse.operators.cleaning import clean, date_orders, date_votes
from ledgerpulse.plans.analysis import load_table
from ledgerpulse.sources import schemas

D = dt.datetime


def column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")


def read(spark, texts, order):
    rows = column(spark, texts).select("i", coerce.to_timestamp(F.col("d"), order).alias("d")).orderBy("i").collect()
    return [r.d for r in rows]


@pytest.mark.parametrize(
    "text, month_first, day_first, unsure",
    [
        ("31/12/2024", None, D(2024, 12, 31), D(2024, 12, 31)),
        ("12/31/2024", D(2024, 12, 31), None, D(2024, 12, 31)),
        ("3/4/2024", D(2024, 3, 4), D(2024, 4, 3), None),
        ("05.05.2024 7:05", *[D(2024, 5, 5, 7, 5)] * 3),
        ("1-2-2024 3:30 PM", D(2024, 1, 2, 15, 30), D(2024, 2, 1, 15, 30), None),
        ("12/31/24", D(2024, 12, 31), None, D(2024, 12, 31)),
        ("31.12.69 12:00:01 am", None, *[D(1969, 12, 31, 0, 0, 1)] * 2),
        ("2024/3/9 10:11:12", *[D(2024, 3, 9, 10, 11, 12)] * 3),
        ("20240309", *[D(2024, 3, 9)] * 3),
        (" 31 Dec 2024", *[D(2024, 12, 31)] * 3),
        ("Sept. 3, 2024", *[D(2024, 9, 3)] * 3),
        ("DECEMBER 31, 2024 12:05 am", *[D(2024, 12, 31, 0, 5)] * 3),
        ("2024-02-29", *[D(2024, 2, 29)] * 3),
        *[(x, None, None, None) for x in ("99-1-2", "2024-02-30", "13/13/2024", "2/30/2024", "Decoy 3, 2024", "1/2", "", None, "1/2-2024", "@24-1-1")],
    ],
)
def test_cells(spark, text, month_first, day_first, unsure):
    df = column(spark, [text])
    got = df.select(*[coerce.to_timestamp(F.col("d"), o).alias(o) for o in coerce.DATE_ORDERS]).first()
    assert tuple(got) == (month_first, day_first, unsure)


def orders(spark, texts):
    return date_orders(column(spark, texts), {"d": "datetime"})["d"]


def test_the_cells_of_a_column_tell_the_order(spark):
    assert orders(spark, ["3/4/2024", "31/12/2024", "x", None]) == "day_first"
    assert orders(spark, ["3/4/2024", "12/31/2024", "2024-12-31"]) == "month_first"
    assert orders(spark, ["3/4/2024", "5/6/2024"]) == "month_first"  # no evidence
    assert orders(spark, ["3/4/2024", "31/12/2024", "12/31/2024"]) == "unsure"
    assert orders(spark, []) == "month_first"


def test_votes(spark):
    df = column(spark, ["3/4/2024", "31/12/2024", "12/31/2024", "2024-12-31", "3 May 2024", "x", None, "2024/1/1"])
    vote = date_votes(df.withColumn("i", F.current_timestamp()), {"d": "datetime", "i": "datetime", "absent": "datetime"}).collect()
    assert [tuple(v) for v in vote] == [("d", 7, 1, 1, 1, 1, 2, 1, "unsure")]
    assert date_votes(df, {"i": "int"}).collect() == []


def test_mixed_evidence_is_reported_and_not_guessed(spark, tmp_path, caplog):
    cells = {"T1": "31/12/2024", "T2": "12/30/2024", "T3": "3/4/2024", "T4": "2024-05-06", "T5": "07/07/2024"}
    file = tmp_path / "transactions.csv"
    file.write_text(",".join(schemas.TRANSACTIONS) + "\n" + "".join(f"{k},C1,5,{v},card\n" for k, v in cells.items()))
    with caplog.at_level(logging.WARNING):
        rows = load_table(spark, str(file), "transactions").collect()
    assert "transactions.transaction_date" in caplog.text and "2 that can be either" in caplog.text
    want = {"T1": D(2024, 12, 31), "T2": D(2024, 12, 30), "T3": None, "T4": D(2024, 5, 6), "T5": D(2024, 7, 7)}
    assert {r.transaction_id: r.transaction_date for r in rows} == want
    told = load_table(spark, str(file), "transactions", dates="day_first").collect()
    assert {r.transaction_id: r.transaction_date for r in told} == want | {"T2": None, "T3": D(2024, 4, 3)}


def test_day_first_column_is_loaded(spark, tmp_path):
    file = tmp_path / "transactions.csv"
    file.write_text(",".join(schemas.TRANSACTIONS) + "\nT1,C1,5,03/04/2024,card\nT2,C1,5,31/12/2024,card\n")
    rows = load_table(spark, str(file), "transactions").collect()
    assert {r.transaction_id: r.transaction_date for r in rows} == {"T1": D(2024, 4, 3), "T2": D(2024, 12, 31)}


def test_one_job_counts_all_columns(spark):
    df = spark.createDataFrame([("31/12/2024", "12/31/2024")], "a string, b string")
    plan = date_votes(df, {"a": "datetime", "b": "datetime"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") <= 2 and "partial_count(kind" in plan
    assert clean(df, {"a": "datetime", "b": "datetime"}, {"a": "day_first"}).first() == (D(2024, 12, 31),) * 2


def test_no_value_is_bound_by_an_array(spark):
    """An element of a transformed array asks the whole reading of a cell for its type with every row."""
    df = column(spark, ["1/2/2024 12:05 AM", "1/2/2024 12:05:07 pm", "1/2/2024 1:05 PM", "1/2/2024 13:05 PM", "May 3rd, 24 11:00 am", "1|2"])
    read = df.select("d", coerce.to_timestamp(F.col("d")).alias("t"), coerce.date_kind(F.col("d")).alias("k"))
    assert [r.t for r in read.collect()] == [D(2024, 1, 2, 0, 5), D(2024, 1, 2, 12, 5, 7), D(2024, 1, 2, 13, 5), None, D(2024, 5, 3, 11), None]
    assert "transform(" not in read._jdf.queryExecution().executedPlan().toString()
