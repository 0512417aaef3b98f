"""Forecasts for many series in one job, their error and their interval.

Input is a series frame (``series_id``, ``t``, ``y``) without gaps. It is read
several times, so pass a written table where it comes from a large job: the
queries use ``materialise``. Forecast frames have ``series_id``, ``model``, ``t``, ``h`` (steps ahead), ``yhat``,
``sigma`` (deviation of the one-step error in the history) and ``fit_ok`` (false where the
model could not be fitted and the forecast only carries the series on).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.least_squares import (
    dot, gram_matrix, numbers, product_sums, regression_of, solved, squared_residuals, stable, steps,
)
from tillwork.functions.measures import ratio
from tillwork.functions.recursions import durbin_levinson, let
from tillwork.operators.series import (
    holdout_split, in_time, lagged_products, past_values, product_arrays, whole,
)
from tillwork.sources.scratch import materialise

PERIODS = "periods"


def _periods(periods: int | None) -> Column:
    """The horizon: a number, or the frame's own ``periods`` column."""
    return F.lit(periods) if periods is not None else F.first(PERIODS)


def _autoregressive_residuals(rows: DataFrame, order: int) -> DataFrame:
    """Add ``e``, the residual of a long autoregression of ``w`` per series."""
    steps_only = rows.where(F.col("w").isNotNull())
    coefficients = product_arrays(lagged_products(steps_only, "w", order), order).select(
        "series_id", durbin_levinson(F.col("products"), order)["ar"].alias("ar"))
    explained = F.aggregate(
        F.zip_with("ar", "past", lambda a, w: a * w), F.lit(0.0), lambda x, y: x + y)
    return (
        rows.withColumn("past", past_values("w", order)).join(coefficients, "series_id", "left")
        .withColumn("e", F.when(F.size("past") == order, F.col("w") - explained))
        .drop("past", "ar")
    )


def _differenced(series: DataFrame, times: int) -> DataFrame:
    """Add ``w``, the differences of so many orders, and ``levels``, the value and all lower differences."""
    rows = series.withColumn("w", F.col("y")).withColumn("levels", F.array().cast("array<double>"))
    for _ in range(times):
        rows = rows.withColumn("levels", F.concat("levels", F.array("w"))).withColumn(
            "w", F.col("w") - F.lag("w").over(in_time()))
    return rows


def arima_parameters(
    series: DataFrame, periods: int | None = 30, order: tuple[int, int, int] = (1, 1, 1), long_order: int = 20
) -> DataFrame:
    """ARIMA of any order per series by the two regressions of Hannan and Rissanen, without a constant.

    First a long autoregression of the differences gives residuals, then the
    differences are regressed on their last values and last residuals. Both come
    down to sums of products per series.

    ``fit_ok`` is false where the series is too short, the regression is singular, or its
    result is not stationary or not invertible. Then all coefficients are zero, so the forecast
    goes on from the last value (and slope, with two differences) alone.
    """
    p, d, q = order
    if min(order) < 0 or long_order < max(1, q):
        raise ValueError("orders must not be negative, nor the long order below the third")
    differences = _differenced(series, d)
    known = _autoregressive_residuals(differences, long_order) if q else differences.withColumn("e", F.lit(0.0))
    nothing = F.array().cast("array<double>")
    rows = known.withColumns({
        "past_w": past_values("w", p) if p else nothing, "past_e": past_values("e", q) if q else nothing})
    usable = (F.size("past_w") == p) & (F.size("past_e") == q)
    features = [F.get("past_w", F.lit(i)) for i in range(p)] + [F.get("past_e", F.lit(i)) for i in range(q)]
    c = F.col
    # Series without a step of their order are kept, so all rows are grouped once.
    sums = rows.groupBy("series_id").agg(
        *product_sums(features, c("w"), usable & c("w").isNotNull()),
        F.max("t").alias("last_t"), F.max_by("y", "t").alias("last_y"), F.max_by("levels", "t").alias("levels"),
        F.max_by(F.slice(F.concat(F.array("w"), "past_w"), 1, p), "t").alias("last_ws"),
        F.max_by(F.slice(F.concat(F.array(F.coalesce("e", F.lit(0.0))), "past_e"), 1, q), "t").alias("last_es"),
        _periods(periods).alias(PERIODS))
    fitted = regression_of(sums, p + q).withColumn("fit", solved(c("gram"), c("moment")) if p + q else nothing)
    ar, ma = F.slice("fit", 1, p), F.slice("fit", p + 1, q)
    ok = (
        (c("rows") > p + q) & ~F.exists(F.coalesce(c("fit"), F.array(F.lit(None).cast("double"))), F.isnull)
        & stable(ar) & stable(F.transform(ma, lambda x: -x)))
    fitted = fitted.withColumn("fit_ok", F.coalesce(ok, F.lit(False)))

    def zeros(count: int) -> Column:
        return F.array(*[F.lit(0.0)] * count).cast("array<double>")

    chosen = fitted.withColumns({
        "ar": F.when(c("fit_ok"), ar).otherwise(zeros(p)), "ma": F.when(c("fit_ok"), ma).otherwise(zeros(q))})
    squares = squared_residuals(c("gram"), c("moment"), c("squares"), F.concat("ar", "ma")) if p + q else c("squares")

    def first(column: str) -> Column:
        return F.get(column, F.lit(0))

    def full(column: str, count: int) -> Column:
        # Of a series too short for them, differences count as zero.
        return F.transform(F.slice(F.concat(column, zeros(count)), 1, count), lambda x: F.coalesce(x, F.lit(0.0)))

    return chosen.select(
        "series_id", "ar", "ma", "fit_ok", F.sqrt(ratio(squares, c("rows"))).alias("sigma"), c("rows").alias("points"),
        first("ar").alias("phi"), first("ma").alias("theta"), first("last_ws").alias("last_w"), first("last_es").alias("last_e"),
        "last_t", "last_y", full("last_ws", p).alias("last_ws"), full("last_es", q).alias("last_es"),
        full("levels", d).alias("levels"), PERIODS)


def _future_steps(periods: Column) -> Column:
    """The differences so many steps ahead, by the recursion of the model; later errors are zero."""
    c = F.col

    def ahead(state: Column, _: Column) -> Column:
        value = dot(c("ar"), state["w"]) + dot(c("ma"), state["e"])
        return let(value, lambda w: F.struct(
            F.slice(F.concat(F.array(w), state["w"]), F.lit(1), F.size("ar")).alias("w"),
            F.slice(F.concat(F.array(F.lit(0.0)), state["e"]), F.lit(1), F.size("ma")).alias("e"),
            F.concat(state["out"], F.array(w)).alias("out")))

    start = F.struct(
        c("last_ws").alias("w"), c("last_es").alias("e"), F.array().cast("array<double>").alias("out"))
    return F.aggregate(steps(F.lit(1), periods.cast("int")), start, ahead, lambda state: state["out"])


def _summed_up(changes: Column, level: Column) -> Column:
    """``level`` plus the changes so far, for each of them."""
    start = F.struct(level.alias("at"), F.array().cast("array<double>").alias("out"))

    def add(state: Column, change: Column) -> Column:
        return let(state["at"] + change, lambda at: F.struct(
            at.alias("at"), F.concat(state["out"], F.array(at)).alias("out")))

    return F.aggregate(changes, start, add, lambda state: state["out"])


def arima_forecast(
    series: DataFrame, periods: int | None = 30, order: tuple[int, int, int] = (1, 1, 1), long_order: int = 20
) -> DataFrame:
    """Forecast the days after each series' last from ``arima_parameters``."""
    fitted = arima_parameters(series, periods, order, long_order).withColumn("path", _future_steps(F.col(PERIODS)))
    for k in reversed(range(order[1])):
        fitted = fitted.withColumn("path", _summed_up(F.col("path"), F.get("levels", F.lit(k))))
    # Outer, or the optimiser would test the size of the path by computing it, model and all, again.
    ahead = fitted.select("*", F.posexplode_outer("path").alias("at", "yhat")).where(F.col("at").isNotNull())
    return ahead.select(
        "series_id", F.lit("arima").alias("model"), F.expr("date_add(last_t, at + 1)").alias("t"),
        (F.col("at") + 1).cast("bigint").alias("h"), "yhat", "sigma", "fit_ok")


# Days per year and week with the number of Fourier pairs for each.
SEASONS = ((365.25, 10), (7.0, 3))


def additive_forecast(
    series: DataFrame,
    periods: int | None = 30,
    changepoints: int = 25,
    changepoint_range: float = 0.8,
    changepoint_scale: float = 0.05,
    seasonality_scale: float = 10.0,
    seasons: tuple[tuple[float, int], ...] = SEASONS,
) -> DataFrame:
    """Forecast from a piecewise linear trend plus yearly and weekly seasons.

    A ridge fit: a prior scale s on a coefficient is the weight noise / s^2, and the noise
    comes from the fit before, from 0.0025 on, three times. The forecast keeps the last slope.

    The features depend on the first day and the length of a series only, so their Gram matrix
    is added up once for each such calendar, however many series share it; a series adds its
    products with them. ``fit_ok`` is true where a series has two days or more.
    """
    shape = _Additive(changepoints, changepoint_range, changepoint_scale, seasonality_scale, seasons)
    c = F.col
    facts = series.groupBy("series_id").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count("y").alias("points"),
        F.coalesce(F.nullif(F.max(F.abs("y")), F.lit(0.0)), F.lit(1.0)).alias("scale"),
        F.sum(F.col("y") * F.col("y")).alias("squares"), _periods(periods).alias(PERIODS))
    facts = facts.withColumn("n", F.datediff("last", "first") + 1).withColumn("bends", shape.bends(c("n")))
    calendars = facts.select("first", "n", "bends").distinct()
    days = calendars.select("*", F.explode(F.sequence(F.lit(0), c("n") - 1)).alias("at"))
    grams = gram_matrix(
        days, ["first", "n"], shape.features(c("at"), c("first"), c("n"), c("bends"))).drop("rows")
    # One row for each series in the join.
    valued = series.join(facts.select("series_id", "first", "n", "bends", "scale"), "series_id")
    moments = (
        valued.select("series_id", (c("y") / c("scale")).alias("y"), F.posexplode_outer(shape.features(
            F.datediff("t", "first"), c("first"), c("n"), c("bends"))).alias("j", "x"))
        .groupBy("series_id", "j").agg(F.sum(c("x") * c("y")).alias("v"))
        .groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("j", "v")))["v"].alias("moment")))
    # A fit takes far longer than the shuffle of its row, so few series are spread too.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fitted = facts.join(moments, "series_id").join(grams, ["first", "n"]).repartition(tasks)
    fitted = fitted.withColumn("squares", c("squares") / (c("scale") * c("scale")))
    fitted = fitted.withColumn("beta", shape.fit(c("gram"), c("moment"), c("squares"), c("points"), c("n")))
    # The first feature is 1, so its sums give the mean residual.
    mean = (F.get("moment", F.lit(0)) - dot(F.get("gram", F.lit(0)), c("beta"))) / c("points")
    spread = squared_residuals(c("gram"), c("moment"), c("squares"), c("beta")) / c("points") - mean * mean
    fitted = fitted.withColumn("sigma", F.sqrt(F.greatest(spread, F.lit(0.0))) * c("scale"))
    ahead = fitted.select("*", F.explode(steps(F.lit(1), c(PERIODS).cast("int"))).alias("h"))
    features = shape.features(c("n") - 1 + c("h"), c("first"), c("n"), c("bends"))
    return ahead.select(
        "series_id", F.lit("additive").alias("model"), F.expr("date_add(last, h)").alias("t"),
        c("h").cast("bigint").alias("h"), (dot(features, c("beta")) * c("scale")).alias("yhat"), "sigma",
        (c("points") > 1).alias("fit_ok"))


def _span(n: Column) -> Column:
    return F.greatest(n - 1, F.lit(1)).cast("double")


@dataclass(frozen=True)
class _Additive:
    """Features and fit of the additive model, as column expressions."""

    changepoints: int
    changepoint_range: float
    changepoint_scale: float
    seasonality_scale: float
    seasons: tuple[tuple[float, int], ...]

    def _last_change(self, n: Column) -> Column:
        return F.floor(n * F.lit(self.changepoint_range)).cast("int") - 1

    def _changes(self, n: Column) -> Column:
        """How many changes of slope a series of ``n`` days can have."""
        return F.greatest(F.least(F.lit(self.changepoints), self._last_change(n)), F.lit(0))

    def bends(self, n: Column) -> Column:
        """The times at which the slope may change, in a series of ``n`` days."""
        changes = self._changes(n)
        return F.transform(steps(F.lit(1), changes), lambda k: F.rint(
            k * self._last_change(n) / changes) / _span(n))

    def features(self, at: Column, first: Column, n: Column, bends: Column) -> Column:
        """1, the time, the time since each bend, and the seasons, on a day by its number."""
        s = at.cast("double") / _span(n)
        bent = F.transform(bends, lambda bend: F.greatest(s - bend, F.lit(0.0)))
        day = F.unix_date(first) + at
        waves = [
            wave(2 * math.pi * k * day / F.lit(period))
            for period, order in self.seasons for k in range(1, order + 1) for wave in (F.sin, F.cos)]
        return F.concat(F.array(F.lit(1.0), s), bent, F.array(*waves))

    def fit(self, gram: Column, moment: Column, squares: Column, points: Column, n: Column) -> Column:
        """The coefficients."""
        waves = 2 * sum(order for _, order in self.seasons)
        prior = F.concat(
            F.array(F.lit(5.0), F.lit(5.0)),
            F.array_repeat(F.lit(self.changepoint_scale), self._changes(n)),
            F.array_repeat(F.lit(self.seasonality_scale), waves))

        def again(state: Column, _: Column) -> Column:
            ridged = F.transform(gram, lambda row, i: F.transform(row, lambda v, j: F.when(
                i == j, v + state["noise"] / F.pow(F.get(prior, i), F.lit(2)) + 1e-10).otherwise(v)))
            return let(solved(ridged, moment), lambda beta: F.struct(
                F.greatest(squared_residuals(gram, moment, squares, beta) / points, F.lit(1e-8)).alias("noise"),
                beta.alias("beta")))

        start = F.struct(F.lit(0.0025).alias("noise"), F.array().cast("array<double>").alias("beta"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, again, lambda state: state["beta"])


MODELS: dict[str, Callable[..., DataFrame]] = {
    "arima": arima_forecast,
    "additive": additive_forecast,
}


def forecast_panel(series: DataFrame, periods: int | None = 30, model_type: str = "all") -> DataFrame:
    """Forecasts of one model or of all, in one long table."""
    names = list(MODELS) if model_type == "all" else [model_type]
    panel = None
    for name in names:
        forecast = MODELS[name](series, periods)
        panel = forecast if panel is None else panel.unionByName(forecast)
    return panel


def forecast_interval(forecast: DataFrame, z: float = 1.96) -> DataFrame:
    """Add a band around the forecast that widens with the root of the steps ahead."""
    band = F.lit(z) * F.col("sigma") * F.sqrt("h")
    return forecast.withColumns({"lower": F.col("yhat") - band, "upper": F.col("yhat") + band})


def forecast_metrics(actual: DataFrame, forecast: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean absolute, squared, root squared and percentage error per model.

    The percentage error is over the days with an actual other than zero, of
    which ``mape_points`` says how many there are.
    """
    error = F.col("y") - F.col("yhat")
    relative = F.try_divide(F.abs(error), F.abs(F.col("y")))
    joined = forecast.join(actual.select("series_id", "t", "y"), ["series_id", "t"])
    return joined.groupBy(*by).agg(
        F.count(error).alias("points"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("mse"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (F.avg(relative) * 100).alias("mape"),
        F.count(relative).alias("mape_points"),
    ).withColumn("accuracy", 100 - F.col("mape"))


def evaluate_models(
    series: DataFrame, model_type: str = "all", test_size: float = 0.2, by: Sequence[str] = ("model",)
) -> DataFrame:
    """Fit on the first part of each series and measure the forecast of the rest."""
    # The fits read their part several times.
    split = materialise(holdout_split(series, test_size).withColumn(
        PERIODS, F.count_if(F.col("role") == "test").over(whole())), "split")
    train = split.where(F.col("role") == "train").drop("role")
    test = split.where(F.col("role") == "test")
    return forecast_metrics(test, forecast_panel(train, None, model_type), by)
