"""Forecasts and regressions over daily revenue per region."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillwork.operators import forecasting, learning, series
from tillwork.plans.oracle import on_sales, rounded
from tillwork.plans.registry import query
from tillwork.plans.regression_sql import additive_ctes, arima_ctes, design, elimination, residual_ctes
from tillwork.plans.series_queries import CRITICAL, PLACED, SERIES, W, by_region, recursive
from tillwork.sources.scratch import materialise
from tillwork.sources.star import Star


def daily(star: Star):
    """Daily revenue per region, written once as the forecasts read it several times."""
    return materialise(by_region(star), "series")


def features(star: Star):
    """Features of the one series of all sales."""
    return series.feature_matrix(
        series.series_from_sales(star.summed(["transaction_date"], ["total_amount"])))


FORECAST = f"""SELECT series_id, model, t, CAST(h AS BIGINT) AS h, {rounded('yhat', 2)} AS yhat,
       {rounded('sigma', 2)} AS sigma, fit_ok"""
BOTH = "(SELECT * FROM arima UNION ALL BY NAME SELECT * FROM additive) AS panel"
BOTH_MODELS = (*SERIES, *arima_ctes(), *additive_ctes())


@query("arima_forecast", recursive(on_sales(f"{FORECAST} FROM arima", *SERIES, *arima_ctes())), digits=2)
def arima_forecast(star: Star):
    return forecasting.arima_forecast(daily(star))


# Stable by the known triangles of the second order; the steps ahead by recursion.
@query("arima_forecast_order_2_1_2", recursive(on_sales(f"""
SELECT series_id, 'arima' AS model, CAST(last_t + CAST(h AS INTEGER) AS DATE) AS t, CAST(h AS BIGINT) AS h,
       {rounded('level', 2)} AS yhat, {rounded('sigma', 2)} AS sigma, fit_ok
FROM ahead JOIN sigmas USING (series_id) WHERE h > 0""", *SERIES, *residual_ctes("series"), f"""
lagged AS MATERIALIZED (
  SELECT *, LAG(w, 1) OVER {W} AS w1, LAG(w, 2) OVER {W} AS w2, LAG(e, 1) OVER {W} AS e1, LAG(e, 2) OVER {W} AS e2
  FROM residuals
)""", *design(["w1", "w2", "e1", "e2"], "lagged", "w", "e2 IS NOT NULL"), *elimination("fit", "system"), """
wide AS (
  SELECT *, abs(p2) < 1 AND p2 + p1 < 1 AND p2 - p1 < 1 AND abs(q2) < 1 AND q2 + q1 > -1 AND q2 - q1 > -1 AS fit_ok
  FROM (SELECT series_id, MAX(v) FILTER (i = 0) AS p1, MAX(v) FILTER (i = 1) AS p2, MAX(v) FILTER (i = 2) AS q1,
               MAX(v) FILTER (i = 3) AS q2 FROM fit GROUP BY 1) AS coefficients
)""", """
model AS MATERIALIZED (
  SELECT series_id, fit_ok, CASE WHEN fit_ok THEN p1 ELSE 0 END AS p1, CASE WHEN fit_ok THEN p2 ELSE 0 END AS p2,
         CASE WHEN fit_ok THEN q1 ELSE 0 END AS q1, CASE WHEN fit_ok THEN q2 ELSE 0 END AS q2
  FROM wide
)""", """
sigmas AS (
  SELECT series_id, sqrt(AVG(pow(w - p1 * w1 - p2 * w2 - q1 * e1 - q2 * e2, 2))) AS sigma
  FROM lagged JOIN model USING (series_id) WHERE e2 IS NOT NULL GROUP BY 1
)""", f"""
ahead AS (
  SELECT series_id, 0 AS h, w AS a, w1 AS b, e AS c, e1 AS d, last_t, level, fit_ok, p1, p2, q1, q2
  FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY t DESC) AS age FROM lagged) AS latest
  JOIN model USING (series_id)
  JOIN (SELECT series_id, MAX(t) AS last_t, arg_max(y, t) AS level FROM series GROUP BY 1) AS ends_of USING (series_id)
  WHERE age = 1
  UNION ALL
  SELECT series_id, h + 1, p1 * a + p2 * b + q1 * c + q2 * d, a, 0, c, last_t,
         level + p1 * a + p2 * b + q1 * c + q2 * d, fit_ok, p1, p2, q1, q2
  FROM ahead WHERE h < 30
)""")), digits=2)
def arima_forecast_order_2_1_2(star: Star):
    return forecasting.arima_forecast(daily(star), order=(2, 1, 2))


@query("additive_forecast", recursive(on_sales(f"{FORECAST} FROM additive", *SERIES, *additive_ctes())), digits=2)
def additive_forecast(star: Star):
    return forecasting.additive_forecast(daily(star))


@query("forecast_panel", recursive(on_sales(f"{FORECAST} FROM {BOTH}", *BOTH_MODELS)), digits=2)
def forecast_panel(star: Star):
    return forecasting.forecast_panel(daily(star))


@query("forecast_interval", recursive(on_sales(f"""{FORECAST},
       {rounded('yhat - 1.96 * sigma * sqrt(h)', 2)} AS lower, {rounded('yhat + 1.96 * sigma * sqrt(h)', 2)} AS upper
FROM {BOTH}""", *BOTH_MODELS)), digits=2)
def forecast_interval(star: Star):
    return forecasting.forecast_interval(forecasting.forecast_panel(daily(star)))


# The days of a test part, from the length of its training part.
_TRAIN_CUT = "floor(n * (1 - CAST(0.2 AS DOUBLE)))"
_TEST_DAYS = "(SELECT COUNT(*) FROM placed WHERE placed.series_id = ends_of.series_id) - n"


@query("forecast_metrics", recursive(on_sales(f"""
SELECT model, COUNT(*) AS points, {rounded('AVG(abs(y - yhat))', 2)} AS mae,
       {rounded('AVG((y - yhat) * (y - yhat)) / 1e6', 2)} AS mse_millions,
       {rounded('sqrt(AVG((y - yhat) * (y - yhat)))', 2)} AS rmse,
       {rounded('AVG(abs((y - yhat) / NULLIF(y, 0))) * 100', 2)} AS mape, COUNT(NULLIF(y, 0)) AS mape_points,
       {rounded('100 - AVG(abs((y - yhat) / NULLIF(y, 0))) * 100', 2)} AS accuracy
FROM {BOTH} JOIN test USING (series_id, t) GROUP BY model""", *SERIES, PLACED, f"""
train AS MATERIALIZED (SELECT series_id, t, y FROM placed WHERE pos < {_TRAIN_CUT})""", f"""
test AS (SELECT series_id, t, y FROM placed WHERE pos >= {_TRAIN_CUT})""",
    *arima_ctes("train", _TEST_DAYS), *additive_ctes("train", _TEST_DAYS))), digits=2)
def forecast_metrics(star: Star):
    # The squares are large, so in millions.
    scores = forecasting.evaluate_models(daily(star))
    return scores.withColumn("mse_millions", F.col("mse") / 1e6).drop("mse")


def _lagged_test(lags: int = 7) -> str:
    """The regression on a constant, the level and earlier differences, of values brought to one scale."""
    names = ["1.0::DOUBLE", "x", *(f"d{k}" for k in range(1, lags + 1))]
    fit = " - ".join(["d", *(f"b[{i + 1}] * {name}" for i, name in enumerate(names))])
    past = ", ".join(f"LAG(d, {k}) OVER {W} AS d{k}" for k in range(1, lags + 1))
    return recursive(on_sales(f"""
SELECT series_id, n_obs, {rounded('statistic')} AS statistic, {rounded(CRITICAL)} AS critical_value,
       statistic < {CRITICAL} AS is_stationary
FROM (
  SELECT series_id, COUNT(*) AS n_obs,
         any_value(b[2]) / sqrt(SUM(pow({fit}, 2)) / (COUNT(*) - {lags + 2}) * any_value(inverse)) AS statistic
  FROM past JOIN (SELECT series_id, list(v ORDER BY i) AS b FROM beta GROUP BY 1) AS coefficients USING (series_id)
  JOIN (SELECT series_id, v AS inverse FROM unit_beta WHERE i = 1) AS inverted USING (series_id)
  WHERE d{lags} IS NOT NULL GROUP BY series_id
) AS tested""", *SERIES, f"""
level AS (
  SELECT series_id, t, (y - AVG(y) OVER p) / STDDEV_SAMP(y) OVER p AS z FROM series
  WINDOW p AS (PARTITION BY series_id)
)""", f"""
change AS (SELECT *, LAG(z) OVER {W} AS x, z - LAG(z) OVER {W} AS d FROM level)""", f"""
past AS MATERIALIZED (SELECT *, {past} FROM change)""",
        *design(names, "past", "d", f"d{lags} IS NOT NULL"), *elimination("beta", "system"), f"""
unit AS (SELECT series_id, i, j, CASE WHEN j < {lags + 2} THEN v WHEN i = 1 THEN 1 ELSE 0 END AS v FROM system)""",
        *elimination("unit_beta", "unit")))


@query("stationarity_test_lagged", _lagged_test())
def stationarity_test_lagged(star: Star):
    return series.stationarity_test(daily(star), lags=7)


@query("fit_random_forest")
def fit_random_forest(star: Star):
    return learning.fit_and_predict(features(star), "random_forest")


@query("fit_gradient_boosting")
def fit_gradient_boosting(star: Star):
    return learning.fit_and_predict(features(star), "gradient_boosting")


_FEATURES = ("EXTRACT(YEAR FROM t)", "EXTRACT(MONTH FROM t)", "EXTRACT(DAY FROM t)", "EXTRACT(ISODOW FROM t) - 1",
             "EXTRACT(QUARTER FROM t)", "CASE WHEN EXTRACT(ISODOW FROM t) >= 6 THEN 1 ELSE 0 END",
             *(f"LAG(y, {k}) OVER {W}" for k in (1, 7, 30)),
             *(f"{f}(y) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
               for w in (7, 30) for f in ("AVG", "STDDEV_SAMP")))


@query("fit_linear_regression", recursive(on_sales(f"""
SELECT series_id, t, {rounded('any_value(y)', 2)} AS y, {rounded('any_value(mean_y) + SUM(z * v)', 2)} AS prediction
FROM scaled JOIN beta USING (series_id) WHERE beta.i = scaled.j AND NOT train GROUP BY series_id, t""", """
daily AS (
  SELECT 'all' AS series_id, CAST(transaction_date AS DATE) AS t, CAST(SUM(total_amount) AS DOUBLE) AS y
  FROM sales WHERE transaction_date IS NOT NULL GROUP BY 2
)""", *SERIES[1:], f"""
known AS (
  SELECT *, row_number() OVER {W} - 1 < floor(COUNT(*) OVER (PARTITION BY series_id) * (1 - CAST(0.2 AS DOUBLE))) AS train
  FROM (SELECT series_id, t, y, row_number() OVER {W} AS pos, [{", ".join(f"({f})::DOUBLE" for f in _FEATURES)}] AS x
        FROM series) AS computed
  WHERE pos > 30
)""", """
entry AS (
  SELECT series_id, t, y, train, j - 1 AS j, x[j] AS x, AVG(y) FILTER (train) OVER (PARTITION BY series_id, j) AS mean_y,
         AVG(x[j]) FILTER (train) OVER (PARTITION BY series_id, j) AS mean_x,
         STDDEV_SAMP(x[j]) FILTER (train) OVER (PARTITION BY series_id, j) AS std_x
  FROM known, range(1, 14) AS r(j)
)""", """
scaled AS MATERIALIZED (SELECT *, (x - mean_x) / std_x AS z FROM entry)""", """
normal AS MATERIALIZED (
  SELECT a.series_id, a.j AS i, b.j, SUM(a.z * b.z) AS v
  FROM scaled AS a JOIN scaled AS b USING (series_id, t) WHERE a.train GROUP BY 1, 2, 3
  UNION ALL
  SELECT series_id, j, 13, SUM(z * (y - mean_y)) FROM scaled WHERE train GROUP BY 1, 2
)""", *elimination("beta", "normal"))), digits=2)
def fit_linear_regression(star: Star):
    return learning.fit_and_predict(features(star), "linear_regression")


@query("model_selection")
def model_selection(star: Star):
    return learning.model_selection(features(star)).scores
