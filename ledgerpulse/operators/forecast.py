"""Forecast of monthly series: linear trend times (or plus) a calendar-month effect.

A fitted model is a table with one row per series: the trend line, the map of
calendar-month effects, the residual spread and the history. It is saved and
read like any other table. Everything here works on monthly aggregates, one
row per series and month, and series are processed in parallel.
"""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerpulse.functions.dates import month_number
from ledgerpulse.functions.numbers import half_even
from ledgerpulse.session import stage
from ledgerpulse.sources.versions import latest_version, new_version

HORIZON_MONTHS = 3
# Fixed value: 80 % interval of a normal distribution.
INTERVAL = 1.2816
MODES = ("multiplicative", "additive")
# Part of the history in which the trend may bend, and the scale of the prior of a bend.
BEND_RANGE = 0.8
BEND_SCALE = 0.05
#: Series whose bends are fitted in one regression; the driver holds their coefficients.
SERIES_AT_ONCE = 10_000
#: Coefficients up to which a regression is solved from normal equations.
GATHERED = 1000


def prepare_series(series: DataFrame, value: str = "MRR", by: tuple[str, ...] = ()) -> DataFrame:
    """Model columns ``ds`` and ``y`` in date order."""
    return series.select(*by, F.col("date").cast("date").alias("ds"), F.col(value).cast("double").alias("y")).orderBy(
        *by, "ds"
    )


def fit(
    series: DataFrame,
    value: str = "MRR",
    by: tuple[str, ...] = (),
    mode: str = "multiplicative",
    yearly: bool = True,
    bends: int = 0,
) -> DataFrame:
    """One model row per series.

    The trend is the least-squares line over the month number; the effect of a
    calendar month is the mean ratio to (or difference from) the trend, drawn
    towards no effect by the share 1/n of its n observations: a month seen once
    tells nothing about the year, and every further one tells more.

    With ``bends`` the trend may change its slope at that many places, evenly
    spread over the first BEND_RANGE of the history: see ``_bent``. It runs jobs
    then, so ``series`` should be stored.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r} (expected one of {', '.join(MODES)})")
    whole, same_month = Window.partitionBy(*by), Window.partitionBy(*by, "month")
    y, t = F.col("y"), F.col("t")
    neutral = _neutral(mode)
    points = (
        series.select(*by, F.col("date").cast("date").alias("ds"), F.col(value).cast("double").alias("y"))
        .withColumns({"t": month_number(F.col("ds")), "month": F.month("ds")})
        .withColumns(
            {
                "slope": F.coalesce(F.regr_slope(y, t).over(whole), F.lit(0.0)),
                "intercept": F.coalesce(F.regr_intercept(y, t).over(whole), F.avg(y).over(whole)),
                "bends": F.lit(None).cast(_BENDS),
            }
        )
    )

    def with_effect(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("trend", _trend(t))
        effect = F.try_divide(y, F.col("trend")) if mode == "multiplicative" else y - F.col("trend")
        seen = F.count(effect).over(same_month)
        drawn = neutral + (F.avg(effect).over(same_month) - neutral) * F.try_divide(seen - 1, seen)
        return rows.withColumn("effect", F.coalesce(drawn, neutral) if yearly else neutral)

    fitted = with_effect(points)
    if bends:
        level = F.try_divide(y, F.col("effect")) if mode == "multiplicative" else y - F.col("effect")
        fitted = with_effect(_bent(fitted.withColumn("level", level), by, bends).drop("level", "trend", "effect"))
    fitted = fitted.withColumn("residual", y - _combine(mode, F.col("trend"), F.col("effect")))
    return (
        fitted.groupBy(*by)
        .agg(
            F.max("slope").alias("slope"),
            F.max("intercept").alias("intercept"),
            F.first("bends", ignorenulls=True).alias("bends"),
            F.map_from_entries(F.array_sort(F.collect_set(F.struct("month", "effect")))).alias("effects"),
            F.coalesce(F.stddev_samp("residual"), F.lit(0.0)).alias("spread"),
            F.count(y).alias("months"),
            F.regr_avgx(y, t).alias("centre"),
            F.coalesce(F.regr_sxx(y, t), F.lit(0.0)).alias("extent"),
            F.array_sort(F.collect_list(F.struct(F.col("ds").alias("date"), F.col("y").alias("actual")))).alias(
                "history"
            ),
            F.lit(mode).alias("mode"),
        )
        .where(F.size("history") > 0)
    )


def _bent(points: DataFrame, by: tuple[str, ...], bends: int) -> DataFrame:
    """``points`` with the slope, intercept and bends of a trend that may change its slope.

    The changes are the coefficients of hinges max(0, t - place) in one elastic-net regression over all series, in which
    every series has features of its own. Its penalty is that of a Laplace prior of BEND_SCALE on the change, history and
    values of a series being scaled to 1, against the variance of its scatter, which the second differences tell whatever the
    trend; so a series that is straight keeps its line, and one that bends less than it scatters hardly bends. Line and level are not penalised: what they explain is taken out of the
    values and the hinges before, and the line is fitted again to what the bends leave.
    """
    columns = points.columns
    if not by:
        points, by = points.withColumn("_all", F.lit(1)), ("_all",)
    whole = Window.partitionBy(*by)
    t, x, places = F.col("t"), F.col("_x"), [BEND_RANGE * k / (bends + 1) for k in range(1, bends + 1)]
    first, last = F.min(t).over(whole), F.max(t).over(whole)
    scaled = points.withColumns({"_first": first, "_width": last - first, "_size": F.max(F.abs("level")).over(whole), "_n": F.count("level").over(whole)})
    scaled = scaled.withColumns({"_x": F.try_divide(t - F.col("_first"), F.col("_width")), "_v": F.try_divide("level", F.col("_size"))})
    hinges = {f"_h{k}": F.greatest(x - place, F.lit(0.0)) for k, place in enumerate(places)}
    scaled = scaled.withColumns(hinges)

    def left(name: str) -> Column:
        value = F.col(name)
        line = F.coalesce(F.regr_slope(value, x).over(whole), F.lit(0.0)) * x + F.coalesce(F.regr_intercept(value, x).over(whole), F.avg(value).over(whole))
        return value - line

    parts = scaled.where(F.col("_v").isNotNull() & x.isNotNull()).withColumns({name: left(name) for name in ["_v", *hinges]})
    # a penalty of its own for each series: its hinges are divided by it
    ahead = whole.orderBy("t")
    second = F.col("_v") - 2 * F.lag("_v").over(ahead) + F.lag("_v", 2).over(ahead)
    parts = parts.withColumn("_second", second)
    # independent scatter of variance s has second differences of variance 6 s
    parts = parts.withColumn("_penalty", F.try_divide(F.avg(F.col("_second") * F.col("_second")).over(whole), F.col("_n") * 6 * BEND_SCALE))
    # a series on its line but for rounding has nothing to bend
    rows = stage(parts.where(F.col("_penalty") > 1e-18).select(*by, "_n", "_penalty", "_v", F.array(*hinges).alias("_hinges")), "hinges")
    series = stage(rows.select(*by).distinct().withColumn("_series", F.monotonically_increasing_id()), "series")
    found = None
    for chunk in range(-(-series.count() // SERIES_AT_ONCE)):
        part = series.withColumn("_nr", F.row_number().over(Window.orderBy("_series")) - 1).where(F.floor(F.col("_nr") / SERIES_AT_ONCE) == chunk)
        part = part.withColumn("_nr", F.col("_nr") % SERIES_AT_ONCE)
        changes = _changes(rows, part, by, bends)
        found = changes if found is None else found.unionByName(changes)
    if found is None:
        return points.select(*columns)
    joined = scaled.join(found, [scaled[c].eqNullSafe(found[c]) for c in by], "left").select(scaled["*"], found["_changes"])
    # back in months and values
    unit = F.try_divide("_size", "_width")
    made = F.transform(
        F.arrays_zip(F.array(*[F.lit(p) for p in places]).alias("at"), F.col("_changes").alias("change")),
        lambda b: F.struct((F.col("_first") + b["at"] * F.col("_width")).alias("at"), (b["change"] * unit).alias("change")),
    )
    bent = joined.withColumn("bends", F.filter(made, lambda b: b["change"] != 0).cast(_BENDS))
    rest = F.col("level") - _bending(t)
    line = {"slope": F.regr_slope(rest, t).over(whole), "intercept": F.regr_intercept(rest, t).over(whole)}
    moved = F.coalesce(F.size("bends") > 0, F.lit(False))
    bent = bent.withColumns({c: F.when(moved, v).otherwise(F.col(c)) for c, v in line.items()})
    return bent.select(*columns)


def _changes(rows: DataFrame, series: DataFrame, by: tuple[str, ...], bends: int) -> DataFrame:
    """The scaled changes of slope of the numbered series."""
    spark, n = rows.sparkSession, series.count()
    keyed = rows.join(series, [rows[c].eqNullSafe(series[c]) for c in by])

    @F.udf(VectorUDT())
    def block(nr, penalty, hinges):
        return SparseVector(n * bends, range(nr * bends, (nr + 1) * bends), [h / penalty for h in hinges])

    examples = keyed.select(block("_nr", "_penalty", "_hinges").alias("features"), F.col("_v").alias("label"), F.try_divide(F.lit(1.0), F.col("_n")).alias("weight"))
    # few coefficients: one pass gathers the normal equations; many: a pass for each step
    solver, steps, tolerance = ("normal", 10_000, 1e-13) if n * bends <= GATHERED else ("l-bfgs", 500, 1e-8)
    regression = LinearRegression(
        weightCol="weight", regParam=1.0 / n, elasticNetParam=1.0, fitIntercept=False, standardization=False, solver=solver, maxIter=steps, tol=tolerance
    )
    fitted = regression.fit(examples).coefficients.toArray().reshape(n, bends)
    table = spark.createDataFrame([(nr, [float(c) for c in row]) for nr, row in enumerate(fitted)], "_nr bigint, _scaled array<double>")
    penalties = keyed.groupBy("_nr").agg(F.max("_penalty").alias("_penalty"))
    changes = series.join(table, "_nr").join(penalties, "_nr")
    return changes.select(*by, F.transform("_scaled", lambda c: F.try_divide(c, F.col("_penalty"))).alias("_changes"))


def coefficients(model: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The effect of each calendar month in long form, beside the trend line."""
    return model.select(*by, "slope", "intercept", "spread", F.explode("effects").alias("month", "effect"))


def future_frame(model: DataFrame, periods: int = HORIZON_MONTHS, by: tuple[str, ...] = ()) -> DataFrame:
    """History months with their values and ``periods`` month starts after the last one."""
    return model.select(*by, F.inline(_timeline(periods)))


def predict(model: DataFrame, periods: int = HORIZON_MONTHS, by: tuple[str, ...] = ()) -> DataFrame:
    """Fitted history and forecast with the bounds of the 80 % interval.

    The variance of a prediction is that of the residuals times 1 + leverage, the row's diagonal entry of the hat matrix of
    the trend's normal equations: 1/n + (t - mean)^2 / sum of squares. So the interval is narrowest in the middle of the
    history and widens with the horizon, the more so the shorter the history is.
    """
    dated = model.select("*", F.inline(_timeline(periods)))
    effect = F.element_at("effects", F.month("date"))
    value = F.when(
        F.col("mode") == "multiplicative",
        _combine("multiplicative", _trend(month_number(F.col("date"))), F.coalesce(effect, F.lit(1.0))),
    ).otherwise(_combine("additive", _trend(month_number(F.col("date"))), F.coalesce(effect, F.lit(0.0))))
    away = month_number(F.col("date")) - F.col("centre")
    leverage = F.try_divide(F.lit(1.0), F.col("months")) + F.coalesce(F.try_divide(away * away, F.col("extent")), F.lit(0.0))
    margin = F.col("spread") * INTERVAL * F.sqrt(1 + leverage)
    return dated.withColumn("predicted", value).select(
        *by,
        "date",
        "predicted",
        (F.col("predicted") - margin).alias("lower_bound"),
        (F.col("predicted") + margin).alias("upper_bound"),
        "actual",
    )


def forecast_summary(forecast: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Date, prediction, bounds and actual value, rounded to two decimals."""
    values = [half_even(F.col(c), 2).alias(c) for c in ("predicted", "lower_bound", "upper_bound", "actual")]
    return forecast.select(*by, "date", *values)


def future_forecast(forecast: DataFrame, months_ahead: int = HORIZON_MONTHS, by: tuple[str, ...] = ()) -> DataFrame:
    """The first ``months_ahead`` rows after the last actual value of each series."""
    series = Window.partitionBy(*by)
    return (
        forecast_summary(forecast, by)
        .withColumn("_last", F.max(F.when(F.col("actual").isNotNull(), F.col("date"))).over(series))
        .where(F.col("date") > F.col("_last"))
        .withColumn("_step", F.row_number().over(series.orderBy("date")))
        .where(F.col("_step") <= months_ahead)
        .drop("_last", "_step")
    )


def accuracy(forecast: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean absolute, root mean square and mean absolute percentage error over the months with a value."""
    error = F.col("actual") - F.col("predicted")
    return (
        forecast.where(F.col("actual").isNotNull())
        .groupBy(*by)
        .agg(
            half_even(F.avg(F.abs(error)), 2).alias("MAE"),
            half_even(F.sqrt(F.avg(error * error)), 2).alias("RMSE"),
            half_even(F.avg(F.abs(F.try_divide(error, F.col("actual")))) * 100, 2).alias("MAPE"),
        )
    )


def expected_mrr(forecast: DataFrame) -> DataFrame:
    """Last forecast value, or 5 % above the last actual value when nothing is forecast."""
    known = F.col("actual").isNotNull()
    ahead = F.max_by("predicted", F.when(~known, F.col("date")))
    current = F.max_by("actual", F.when(known, F.col("date")))
    return forecast.agg(F.coalesce(half_even(ahead, 2), current * 1.05).alias("forecast_mrr"))


def train_and_forecast(
    series: DataFrame, months: int = HORIZON_MONTHS, path: str | None = None, by: tuple[str, ...] = (), bends: int = 0
):
    """Fit, predict and measure; returns the model, the future rows and the accuracy."""
    model = fit(series, by=by, bends=bends)
    if path:
        model = save_model(model, path, months, by)
    forecast = predict(model, months, by)
    return model, future_forecast(forecast, months, by), accuracy(forecast, by)


def save_model(model: DataFrame, path: str, months: int = HORIZON_MONTHS, by: tuple[str, ...] = ()) -> DataFrame:
    """Write the model table, its forecast and its accuracy as a new version below ``path``; returns the stored model."""
    spark = model.sparkSession
    with new_version(spark, path) as folder:
        model.write.parquet(f"{folder}/model")
        stored = spark.read.schema(model.schema).parquet(f"{folder}/model")
        forecast = predict(stored, months, by)
        forecast.write.parquet(f"{folder}/forecast")
        accuracy(forecast, by).write.parquet(f"{folder}/accuracy")
    return stored


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{latest_version(spark, path)}/model")


def load_forecast(spark: SparkSession, path: str) -> DataFrame:
    """History and future rows as they were stored with the model."""
    return spark.read.parquet(f"{latest_version(spark, path)}/forecast")


def load_accuracy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{latest_version(spark, path)}/accuracy")


_BENDS = "array<struct<at: double, change: double>>"


def _bending(t: Column) -> Column:
    """What the bends add to the line."""
    none = F.lit(0.0)
    added = F.aggregate("bends", none, lambda total, b: total + b["change"] * F.greatest(t - b["at"], none))
    return F.coalesce(added, none)


def _trend(t: Column) -> Column:
    return F.col("slope") * t + F.col("intercept") + _bending(t)


def _neutral(mode: str) -> Column:
    return F.lit(1.0 if mode == "multiplicative" else 0.0)


def _combine(mode: str, trend: Column, effect: Column) -> Column:
    return trend * effect if mode == "multiplicative" else trend + effect


def _timeline(periods: int) -> Column:
    """The history entries, followed by ``periods`` month starts without a value."""
    start = F.trunc(F.element_at("history", -1)["date"], "month")
    ahead = F.transform(
        F.sequence(F.lit(1), F.lit(periods)),
        lambda i: F.struct(F.add_months(start, i).alias("date"), F.lit(None).cast("double").alias("actual")),
    )
    return F.concat("history", ahead) if periods > 0 else F.col("history")
