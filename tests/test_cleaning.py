import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerpulse.functions import coerce
from ledgerpulse.operators import cohorts
from ledgerpulse.operators.cleaning import clean, duplicate_counts, require_schema, validate_schema
from ledgerpulse.operators.quality import column_profile, quality_gate, quality_report, quality_scores
from ledgerpulse.operators.merge import merge_datasets
from ledgerpulse.plans.analysis import bad_row_counts, load_directory
from ledgerpulse.sources import schemas
from ledgerpulse.sources.files import dated_name, export_csv, load_file, split_bad_rows, write_table


def values(spark, function, texts, kind="string"):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], f"i int, v {kind}")
    return [r.v for r in df.select("i", function(F.col("v")).alias("v")).orderBy("i").collect()]


def test_integer(spark):
    assert values(spark, coerce.to_integer, ["3", "x", None, "2.9", "-2.9", "1e400", "NaN"]) == [3, 0, 0, 2, -2, 0, 0]


def test_boolean(spark):
    assert values(spark, coerce.to_boolean, [True, None, False], "boolean") == [True, True, False]
    texts = ["False", "no", "0", "0.0", "2", "maybe", None, "True"]
    assert values(spark, coerce.to_boolean, texts) == [False, False, False, False, True, True, True, True]


def test_text(spark):
    assert values(spark, coerce.to_text, [" x ", None, "nan", " nan\t", "Nan"]) == ["x", None, None, None, "Nan"]


def test_double_and_timestamp(spark):
    assert values(spark, coerce.to_double, ["1.5", "abc", None, "NaN"]) == [1.5, None, None, None]
    assert values(spark, coerce.to_timestamp, ["2024-02-30", "2024-02-29", None]) == [
        None,
        dt.datetime(2024, 2, 29),
        None,
    ]


def test_duplicates_treat_missing_as_equal(spark):
    rows = [("T1", None, "5", None, "card"), ("T1", None, "5", None, "card"), ("T2", None, "5", None, "card")]
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in schemas.TRANSACTIONS))
    assert clean(raw, schemas.TRANSACTIONS).count() == 2
    assert duplicate_counts(raw, schemas.TRANSACTIONS).first().asDict() == {
        "rows_before": 3, "rows_after": 2, "duplicates_removed": 1,
    }


def test_duplicate_counts_of_nothing(spark):
    raw = spark.createDataFrame([], ", ".join(f"{c} string" for c in schemas.TRANSACTIONS))
    assert tuple(duplicate_counts(raw, schemas.TRANSACTIONS).first()) == (0, 0, 0)


def test_validation(spark):
    lacking = spark.createDataFrame([("C1",)], "customer_id string")
    report = validate_schema(lacking, schemas.CUSTOMERS, "customers")
    assert not report.valid and "plan" in report.missing_columns
    with pytest.raises(ValueError, match="plan"):
        require_schema(lacking, schemas.CUSTOMERS, "customers")
    extra = spark.createDataFrame([("x",) * 6], ", ".join(f"{c} string" for c in [*schemas.TRANSACTIONS, "note"]))
    report = validate_schema(extra, schemas.TRANSACTIONS, "transactions")
    assert report.valid and report.extra_columns == ["note"] and report.warnings
    assert "note" in clean(extra, schemas.TRANSACTIONS).columns


def test_quality_score(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k int, v string")
    assert quality_scores({"t": df}).first().quality_score == 75.0
    assert quality_scores({"t": df.select("k")}).first().quality_score == 100.0
    report = quality_report({"t": df}).collect()
    assert [(r.column_name, r.missing, r.missing_pct) for r in report] == [("v", 1, 25.0)]


def test_not_a_number_counts_as_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert column_profile(df, "t").first().missing == 2


def test_empty_table_profile(spark):
    row = column_profile(spark.createDataFrame([], "v double"), "t").first()
    assert (row.total_rows, row.missing, row.missing_pct) == (0, 0, 0.0)


def test_quality_gate(periods):
    good = [("C1", "2024-01-01", 1.0, 0)] * 4
    assert all(r.passed for r in quality_gate(periods(good)).collect())
    bad = periods(good + [("C1", "2024-01-01", None, 0)] * 2)
    verdict = {r.check_name: r.passed for r in quality_gate(bad.unionAll(bad.limit(1))).collect()}
    assert verdict["missing:revenue"] is False and verdict["duplicates"] is False and verdict["date_range"] is True


def test_load_csv(spark, tmp_path):
    file = tmp_path / "customers.csv"
    file.write_text('customer_id,plan,note\n007,pro,"say ""hi"", then go"\n008,NA,\n')
    rows = load_file(spark, str(file)).orderBy("customer_id").collect()
    assert [tuple(r) for r in rows] == [("007", "pro", 'say "hi", then go'), ("008", None, None)]


def test_files_with_other_columns_fail(spark, tmp_path):
    (tmp_path / "t.csv").mkdir()
    (tmp_path / "t.csv" / "a.csv").write_text("customer_id,plan\nC1,pro\n")
    (tmp_path / "t.csv" / "b.csv").write_text("plan,customer_id\npro,C2\n")
    with pytest.raises(Exception, match="header"):
        load_file(spark, str(tmp_path / "t.csv")).collect()


def test_load_formats(spark, tmp_path):
    df = spark.createDataFrame([("C1", 2)], "customer_id string, n int")
    for kind in ("parquet", "json", "orc"):
        path = str(tmp_path / f"t.{kind}")
        df.write.format(kind).save(path)
        assert load_file(spark, path).select("customer_id", "n").first() == ("C1", 2)
    with pytest.raises(ValueError, match="xlsx"):
        load_file(spark, str(tmp_path / "t.xlsx"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_file(spark, str(tmp_path / "absent.csv"))


def test_load_directory(spark, tmp_path):
    for name, schema in schemas.SCHEMAS.items():
        (tmp_path / f"{name}.csv").write_text(f"{','.join(schema)}\n{',' * (len(schema) - 1)}\nC1{',' * (len(schema) - 1)}\n")
    dataset = load_directory(spark, str(tmp_path))
    assert set(dataset.tables) == set(schemas.SCHEMAS) and dataset.customers.where("customer_id = 'C1'").count() == 1


def test_exports(spark, tmp_path):
    assert dated_name("at_risk_customers", dt.date(2024, 3, 9)) == "at_risk_customers_20240309.csv"
    df = spark.createDataFrame([("C1", 'a "b", c', 1.5), ("C2", None, None)], "k string, v string, n double")
    back = load_file(spark, export_csv(df, str(tmp_path / "out.csv"))).orderBy("k").collect()
    assert [tuple(r) for r in back] == [("C1", 'a "b", c', "1.5"), ("C2", None, None)]
    assert load_file(spark, write_table(df, str(tmp_path / "out.parquet"), ("k",))).where("k = 'C1'").first().n == 1.5


def test_dates_and_numbers_of_text_files(spark):
    cells = [("01/05/2024", "100d"), ("2024-01-05 10:00:00", "12f"), ("1/5/2024 3:07", "1e3"), ("+29999-01-01", " 7 "), ("13/45/2024", "-.5"), (None, "x")]
    df = spark.createDataFrame(cells, "d string, n string").coalesce(1)
    rows = df.select(coerce.to_timestamp(F.col("d")).cast("string"), coerce.to_double(F.col("n")), coerce.to_money(F.col("n")).cast("double"), coerce.to_integer(F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [
        ("2024-01-05 00:00:00", None, None, 0), ("2024-01-05 10:00:00", None, None, 0), ("2024-01-05 03:07:00", 1000.0, 1000.0, 1000),
        (None, 7.0, 7.0, 7), (None, -0.5, -0.5, 0), (None, None, None, 0),
    ]


def test_rows_that_do_not_fit_the_header(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text('a,b\n1,2\n3,4,5\n6,"x\ny"\n')
    with pytest.raises(Exception, match="MALFORMED"):
        load_file(spark, str(file), multiline=True).collect()
    good, bad = split_bad_rows(load_file(spark, str(file), multiline=True, bad_rows="keep"))
    assert sorted(tuple(r) for r in good.collect()) == [("1", "2"), ("6", "x\ny")]
    assert [r[0].strip() for r in bad.collect()] == ["3,4,5"]
    assert tuple(bad_row_counts(spark, {"t": str(file)}, multiline=True).first()) == ("t", 3, 1)


def test_absent_tables(periods):
    subs = periods([("C1", "2024-01-01", 1.0, 0)])
    assert cohorts.cohort_grid(subs, None).count() == 0
    with pytest.raises(ValueError, match="customers"):
        merge_datasets(subs, None)
