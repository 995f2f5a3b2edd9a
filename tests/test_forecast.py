import datetime as dt
import math

import pytest

from ledgerpulse.operators import forecast, reporting


def months(count, start=(2020, 1)):
    first = start[0] * 12 + start[1] - 1
    return [dt.date((first + i) // 12, (first + i) % 12 + 1, 1) for i in range(count)]


@pytest.fixture
def seasonal(spark):
    """Exact line times an exact yearly pattern, four years."""
    rows = [(d, (1000.0 + 20 * i) * (1 + 0.1 * math.sin(2 * math.pi * d.month / 12))) for i, d in enumerate(months(48))]
    return spark.createDataFrame(rows, "date date, MRR double")


def test_seasonal_series_is_fitted(seasonal):
    rows = forecast.predict(forecast.fit(seasonal)).orderBy("date").collect()
    assert len(rows) == 51
    assert all(math.isfinite(r.lower_bound) and r.lower_bound <= r.predicted <= r.upper_bound for r in rows)
    accuracy = forecast.accuracy(forecast.predict(forecast.fit(seasonal))).first()
    assert accuracy.MAPE < 2  # a quarter of the yearly pattern is held back after four years
    future = rows[48:]
    assert [r.date for r in future] == months(3, (2024, 1)) and all(r.actual is None for r in future)
    truth = (1000.0 + 20 * 48) * (1 + 0.1 * math.sin(2 * math.pi / 12))
    assert future[0].predicted == pytest.approx(truth, rel=0.04)


def test_additive_mode_and_unknown_mode(spark):
    rows = [(d, 100.0 + 5 * i + (30 if d.month == 12 else 0)) for i, d in enumerate(months(36))]
    series = spark.createDataFrame(rows, "date date, MRR double")
    effects = {r.month: r.effect for r in forecast.coefficients(forecast.fit(series, mode="additive")).collect()}
    assert max(effects, key=effects.get) == 12 and sum(effects.values()) == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError, match="mode"):
        forecast.fit(series, mode="other")


def test_short_series_has_no_yearly_pattern(spark):
    series = spark.createDataFrame([(d, 10.0 + i) for i, d in enumerate(months(5))], "date date, MRR double")
    future = forecast.future_forecast(forecast.predict(forecast.fit(series), 2), 2).orderBy("date").collect()
    assert [r.predicted for r in future] == [15.0, 16.0]


def test_yearly_pattern_can_be_switched_off(seasonal):
    effects = forecast.coefficients(forecast.fit(seasonal, yearly=False)).collect()
    assert {r.effect for r in effects} == {1.0}


def test_single_month_is_continued_flat(spark):
    series = spark.createDataFrame([(dt.date(2024, 5, 1), 7.0)], "date date, MRR double")
    rows = forecast.predict(forecast.fit(series)).orderBy("date").collect()
    assert [r.predicted for r in rows] == [7.0] * 4 and rows[-1].date == dt.date(2024, 8, 1)


def test_empty_series(spark):
    series = spark.createDataFrame([], "date date, MRR double")
    assert forecast.predict(forecast.fit(series)).count() == 0


def test_series_are_fitted_apart(spark):
    rows = [("a", d, 10.0 + i) for i, d in enumerate(months(4))] + [("b", d, 50.0) for d in months(6)]
    series = spark.createDataFrame(rows, "plan string, date date, MRR double")
    model = forecast.fit(series, by=("plan",))
    future = forecast.future_forecast(forecast.predict(model, 2, by=("plan",)), 2, by=("plan",)).orderBy("plan", "date")
    assert [(r.plan, str(r.date), r.predicted) for r in future.collect()] == [
        ("a", "2020-05-01", 14.0), ("a", "2020-06-01", 15.0), ("b", "2020-07-01", 50.0), ("b", "2020-08-01", 50.0),
    ]
    assert forecast.accuracy(forecast.predict(model, by=("plan",)), by=("plan",)).count() == 2


def test_gaps_are_kept(spark):
    series = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 3, 1), 3.0)], "date date, MRR double")
    rows = forecast.future_frame(forecast.fit(series), 1).orderBy("date").collect()
    assert [str(r.date) for r in rows] == ["2024-01-01", "2024-03-01", "2024-04-01"]


def test_zero_values_do_not_break_the_error_measure(spark):
    series = spark.createDataFrame([(d, 0.0) for d in months(3)], "date date, MRR double")
    row = forecast.accuracy(forecast.predict(forecast.fit(series))).first()
    assert (row.MAE, row.MAPE) == (0.0, None)


def test_model_survives_storage(spark, seasonal, tmp_path):
    model, future, accuracy = forecast.train_and_forecast(seasonal, 3, str(tmp_path / "model"))
    loaded = forecast.load_model(spark, str(tmp_path / "model"))
    again = forecast.future_forecast(forecast.predict(loaded))
    assert again.orderBy("date").collect() == future.orderBy("date").collect()
    assert accuracy.first().MAE >= 0


def test_expected_revenue(seasonal):
    model = forecast.fit(seasonal)
    ahead = forecast.future_forecast(forecast.predict(model)).orderBy("date").collect()[-1].predicted
    assert forecast.expected_mrr(forecast.predict(model)).first()[0] == ahead
    last = seasonal.orderBy("date").collect()[-1].MRR
    assert forecast.expected_mrr(forecast.predict(model, 0)).first()[0] == pytest.approx(last * 1.05, rel=1e-12)


def test_prepared_columns(seasonal):
    prepared = forecast.prepare_series(seasonal)
    assert prepared.columns == ["ds", "y"]
    days = [r.ds for r in prepared.collect()]
    assert days == sorted(days)


def test_yearly_pattern_grows_with_what_is_known(spark):
    """A month seen once has no effect, a month seen n times has all but 1/n of it."""
    wave = [1.5 if m == 6 else 1.0 for m in range(1, 13)]
    effects = {}
    for years in (1, 2, 4):
        rows = [(d, 100.0 * wave[d.month - 1]) for d in months(12 * years)]
        model = forecast.fit(spark.createDataFrame(rows, "date date, MRR double"))
        effects[years] = model.first().effects[6] - 1
    assert effects[1] == 0 < effects[2] < effects[4]
    raw = {n: e * n / (n - 1) for n, e in effects.items() if n > 1}
    assert raw[2] == pytest.approx(raw[4], rel=0.1)


def test_forecast_and_accuracy_are_stored_with_the_model(spark, seasonal, tmp_path):
    model = forecast.fit(seasonal)
    forecast.save_model(model, str(tmp_path / "m"), 5)
    assert forecast.load_forecast(spark, str(tmp_path / "m")).count() == 53
    assert forecast.load_accuracy(spark, str(tmp_path / "m")).first() == forecast.accuracy(forecast.predict(model, 5)).first()


def kpi_row(spark, growth=2.34, churn=5.21):
    return spark.createDataFrame(
        [(245892.50, 2950710.0, growth, 8234, 29.87, 573.32, churn, 100 - churn)],
        "current_mrr double, arr double, mrr_growth_mom double, active_customers bigint, arpu double, clv double, "
        "churn_rate double, retention_rate double",
    )


def test_kpi_cards(spark):
    cards = {r.label: r.value for r in reporting.kpi_cards(kpi_row(spark)).collect()}
    assert cards == {
        "Current MRR": f"${245892.50:,.0f}", "ARR": "$2,950,710", "Active Customers": "8,234", "Churn Rate": "5.2%",
        "ARPU": "$29.87", "CLV": "$573.32",
    }


@pytest.mark.parametrize(
    "growth,label,text",
    [(5.01, "strong growth", "+5.0% MoM"), (5.0, "moderate growth", "+5.0% MoM"), (0.0, "slight decline", "+0.0% MoM"),
     (-4.99, "slight decline", "-5.0% MoM"), (-5.0, "concerning decline", "-5.0% MoM")],
)
def test_trend_words(spark, growth, label, text):
    row = reporting.kpi_deltas(kpi_row(spark, growth)).first()
    assert (row.mrr_trend, row.mrr_delta, row.churn_delta) == (label, text, "0.2%")


def risks(spark):
    rows = [("CUST_000123", 0.85, 499.0, 424.15, 12.34), ("CUST_000456", 0.78, 299.0, 233.22, 8.0), ("CUST_000789", 0.9, 99.0, 89.1, 3.25)]
    return spark.createDataFrame(rows, "customer_id string, churn_probability double, current_revenue double, risk_score double, tenure_months double")


def test_digest(spark):
    text = reporting.risk_digest(risks(spark), 2).first()[0]
    assert text == "Customer CUST_000123 ($499/mo, 85% risk), Customer CUST_000456 ($299/mo, 78% risk)"
    assert reporting.risk_digest(risks(spark).limit(0)).first()[0] == "No high-risk customers identified"


def test_risk_table(spark):
    rows = [tuple(r) for r in reporting.risk_table(risks(spark), 2).collect()]
    assert rows == [("CUST_000123", "85.0%", "$499.00", 424.15, 12.3), ("CUST_000456", "78.0%", "$299.00", 233.22, 8.0)]


def test_chart_has_a_row_per_value(seasonal):
    summary = forecast.forecast_summary(forecast.predict(forecast.fit(seasonal)))
    lines = {r.line: r["count"] for r in reporting.chart_data(summary).groupBy("line").count().collect()}
    assert lines == {"Actual MRR": 48, "Predicted MRR": 51, "Upper Bound": 51, "Lower Bound": 51}


def test_bounds_widen_with_the_horizon(spark):
    rows = [(dt.date(2022 + m // 12, m % 12 + 1, 1), 100.0 + 3 * m + (7 if m % 5 == 0 else -2)) for m in range(24)]
    series = spark.createDataFrame(rows, "date date, MRR double")
    model = forecast.fit(series, mode="additive", yearly=False)
    predicted = forecast.predict(model, 12).orderBy("date").collect()
    widths = [r.upper_bound - r.lower_bound for r in predicted]
    assert all(a < b for a, b in zip(widths[24:], widths[25:]))  # the future
    assert min(range(24), key=widths.__getitem__) in (11, 12)  # narrowest in the middle of the history
    # the textbook's prediction interval of a straight line
    spread, n = model.first().spread, 24
    for step, row in enumerate(predicted[24:]):
        leverage = 1 / n + (24 + step - 11.5) ** 2 / sum((t - 11.5) ** 2 for t in range(n))
        assert (row.upper_bound - row.predicted) == pytest.approx(1.2816 * spread * (1 + leverage) ** 0.5)


def test_bounds_of_a_single_month(spark):
    series = spark.createDataFrame([(dt.date(2024, 1, 1), 5.0)], "date date, MRR double")
    rows = forecast.predict(forecast.fit(series)).collect()
    assert all(r.lower_bound == r.predicted == r.upper_bound for r in rows)


def kinked(spark, noise=0.0, seasonal=False):
    """Three series: one that flattens after its second year, one that turns, and a straight one; four years each."""
    rows = []
    for key, change in (("flat", -20.0), ("turn", -45.0), ("straight", 0.0)):
        for i, d in enumerate(months(48)):
            level = 1000.0 + 20 * i + change * max(0, i - 24)
            wave = 1 + 0.05 * math.sin(2 * math.pi * d.month / 12) if seasonal else 1.0
            rows.append((key, d, level * wave + noise * math.sin(7.0 * i * i)))
    return spark.createDataFrame(rows, "k string, date date, MRR double")


def truth(key, i):
    return 1000.0 + 20 * i + {"flat": -20.0, "turn": -45.0, "straight": 0.0}[key] * max(0, i - 24)


@pytest.mark.parametrize("noise, seasonal, off", [(0.0, False, 0.02), (10.0, False, 0.04), (0.0, True, 0.12)])
def test_a_kinked_trend_is_followed(spark, noise, seasonal, off):
    data = kinked(spark, noise, seasonal)

    def errors(bends):
        model = forecast.fit(data, by=("k",), bends=bends)
        future = forecast.predict(model, 6, by=("k",)).where("actual is null").orderBy("k", "date").collect()
        worst = {}
        for key in ("flat", "turn", "straight"):
            for step, row in enumerate([r for r in future if r.k == key]):
                wave = 1 + 0.05 * math.sin(2 * math.pi * row.date.month / 12) if seasonal else 1.0
                value = truth(key, 48 + step) * wave
                worst[key] = max(worst.get(key, 0), abs(row.predicted - value) / value)
        return worst

    straight, bent = errors(0), errors(12)
    for key in ("flat", "turn"):
        assert bent[key] < off and bent[key] < straight[key] / 2, (key, bent, straight)
    assert bent["straight"] < max(off, 1.01 * straight["straight"])


def test_a_straight_series_keeps_its_line(spark):
    data = kinked(spark).where("k = 'straight'")
    line, bent = forecast.fit(data).first(), forecast.fit(data, bends=12).first()
    assert (line.slope, line.intercept) == (bent.slope, bent.intercept) and not bent.bends
    noisy = kinked(spark, noise=60.0).where("k = 'straight'")
    line, bent = forecast.fit(noisy, yearly=False).first(), forecast.fit(noisy, yearly=False, bends=12).first()
    assert bent.slope == pytest.approx(line.slope, rel=0.05)


def test_bends_of_short_and_empty_series(spark):
    rows = [("one", dt.date(2024, 1, 1), 5.0), ("two", dt.date(2024, 1, 1), 5.0), ("two", dt.date(2024, 2, 1), 6.0), (None, dt.date(2024, 2, 1), None)]
    data = spark.createDataFrame(rows, "k string, date date, MRR double")
    found = {r.k: r.predicted for r in forecast.predict(forecast.fit(data, by=("k",), bends=5), 1, ("k",)).where("actual is null").collect()}
    assert found["one"] == 5.0 and found["two"] == pytest.approx(7.0)
    assert forecast.fit(data.limit(0), by=("k",), bends=5).collect() == []


def test_bends_of_one_series_equal_those_fitted_together(spark, monkeypatch):
    data = kinked(spark, noise=10.0)
    together = {r.k: r.bends for r in forecast.fit(data, by=("k",), bends=6).collect()}
    monkeypatch.setattr(forecast, "SERIES_AT_ONCE", 1)
    for r in forecast.fit(data, by=("k",), bends=6).collect():
        one = {round(b.at, 6): b.change for b in r.bends or []}
        both = {round(b.at, 6): b.change for b in together[r.k] or []}
        for place in one.keys() | both.keys():
            assert one.get(place, 0) == pytest.approx(both.get(place, 0), abs=0.05)
