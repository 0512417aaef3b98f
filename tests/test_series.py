"""Time-series operators against numpy."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwork.operators import forecasting, learning, series

START = datetime.date(2023, 1, 1)


def frame(spark, **named):
    rows = [
        (name, START + datetime.timedelta(days=i), float(v))
        for name, values in named.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id STRING, t DATE, y DOUBLE")


def column(df, name, series_id="a", order="t"):
    rows = df.where(F.col("series_id") == series_id).orderBy(order).select(name).collect()
    return [r[0] for r in rows]


def noise(n, seed=3):
    return np.random.default_rng(seed).normal(size=n)


def arma(n, phi, theta, seed=1):
    e = noise(n + 1, seed)
    w = np.zeros(n + 1)
    for i in range(1, n + 1):
        w[i] = phi * w[i - 1] + e[i] + theta * e[i - 1]
    return w[1:]


def acf_of(y, lags):
    d = y - y.mean()
    return np.array([d[k:] @ d[:len(d) - k] for k in range(lags + 1)]) / (d @ d)


def test_fill_days(spark):
    rows = spark.createDataFrame(
        [("a", START, 1.0), ("a", START + datetime.timedelta(days=3), 2.0), ("b", START, 5.0)],
        "series_id STRING, t DATE, y DOUBLE")
    filled = series.fill_days(rows)
    assert column(filled, "y") == [1.0, 0.0, 0.0, 2.0] and column(filled, "y", "b") == [5.0]


def test_prepare_drops_missing_and_parses(spark):
    rows = spark.createDataFrame(
        [("2024-01-02", 2.0), ("2024-01-01", None), ("2024-01-03", float("nan"))], "date STRING, sales DOUBLE")
    got = series.prepare_series(rows, "date", "sales", None).collect()
    assert [(r["series_id"], str(r["t"]), r["y"]) for r in got] == [("all", "2024-01-02", 2.0)]


def test_acf_and_pacf(spark):
    y = arma(300, 0.6, 0.2)
    df = frame(spark, a=y, b=y[::-1][:50])
    acf = acf_of(y, 10)
    assert np.allclose(column(series.autocorrelation(df, 10), "acf", order="lag"), acf)
    expected = [1.0]
    for k in range(1, 11):
        toeplitz = np.array([[acf[abs(i - j)] for j in range(k)] for i in range(k)])
        expected.append(np.linalg.solve(toeplitz, acf[1:k + 1])[-1])
    assert np.allclose(column(series.partial_autocorrelation(df, 10), "pacf", order="lag"), expected)


def test_rolling_window_edges(spark):
    for n in (5, 30, 31):
        got = series.rolling_stats(frame(spark, a=range(n)), 30)
        assert sum(v is not None for v in column(got, "rolling_mean")) == max(n - 29, 0)
    ahead = series.rolling_features(frame(spark, a=range(10)), (7,), exclude_current=True)
    assert column(ahead, "y_rolling_mean_7") == [None] * 7 + [3.0, 4.0, 5.0]


@pytest.mark.parametrize("period", [7, 6])
@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_decomposition(spark, period, model):
    n = 60
    base = 50 + 0.5 * np.arange(n) + noise(n)
    y = base + 5 * np.sin(2 * np.pi * np.arange(n) / period)
    got = series.seasonal_decompose(frame(spark, a=y), period, model)
    trend = np.array(column(got, "trend"), dtype=float)
    weights = np.ones(period) / period if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5] / period
    half = period // 2
    expected = np.full(n, np.nan)
    expected[half:n - half] = np.convolve(y, weights, "valid")
    assert np.allclose(trend, expected, equal_nan=True)
    detrended = y - expected if model == "additive" else y / expected
    means = np.array([np.nanmean(detrended[p::period]) for p in range(period)])
    means = means - means.mean() if model == "additive" else means / means.mean()
    assert np.allclose(column(got, "seasonal"), np.resize(means, n))
    residual = np.array(column(got, "residual"), dtype=float)
    whole = trend + np.resize(means, n) + residual if model == "additive" else trend * np.resize(means, n) * residual
    assert np.allclose(whole[half:n - half], y[half:n - half])


def test_decomposition_needs_two_periods(spark):
    got = series.seasonal_decompose(frame(spark, a=range(13)), 7)
    assert column(got, "trend") == [None] * 13 and column(got, "seasonal") == [None] * 13


def test_dickey_fuller(spark):
    walk, still = np.cumsum(noise(400)), noise(400)
    df = frame(spark, a=walk, b=still, c=[1.0, 2.0])
    got = {r["series_id"]: r for r in series.stationarity_test(df).collect()}
    assert got["b"]["is_stationary"] and not got["a"]["is_stationary"] and got["c"]["statistic"] is None
    x, d = still[:-1], np.diff(still)
    design = np.column_stack([np.ones(399), x])
    beta, rss, *_ = np.linalg.lstsq(design, d, rcond=None)
    error = np.sqrt(rss[0] / 397 * np.linalg.inv(design.T @ design)[1, 1])
    assert got["b"]["statistic"] == pytest.approx(beta[1] / error)
    lagged = {r["series_id"]: r for r in series.stationarity_test(df, lags=3).collect()}
    assert lagged["b"]["is_stationary"] and not lagged["a"]["is_stationary"]
    assert lagged["a"]["n_obs"] == 396


def test_folds(spark):
    got = series.time_series_split(frame(spark, a=range(10)), 3)
    folds = {}
    for r in got.collect():
        folds.setdefault((r["fold"], r["role"]), []).append(int(r["y"]))
    assert {k: sorted(v) for k, v in folds.items()} == {
        (0, "train"): [0, 1, 2, 3], (0, "test"): [4, 5], (1, "train"): list(range(6)), (1, "test"): [6, 7],
        (2, "train"): list(range(8)), (2, "test"): [8, 9]}


@pytest.mark.parametrize("phi,theta", [(0.6, 0.3), (-0.5, 0.2), (0.3, -0.4)])
def test_arima_recovers_parameters(spark, phi, theta):
    n = 4000
    df = frame(spark, a=100 + np.cumsum(arma(n, phi, theta)))
    row = forecasting.arima_parameters(df).first()
    # Three asymptotic standard errors; they are wide where phi and -theta nearly cancel.
    factor = 3 * (1 + phi * theta) / abs(phi + theta) / np.sqrt(n)
    assert abs(row["phi"] - phi) < factor * np.sqrt(1 - phi**2)
    assert abs(row["theta"] - theta) < factor * np.sqrt(1 - theta**2)
    assert row["sigma"] == pytest.approx(1.0, abs=0.05)


def test_arima_forecast_follows_the_recursion(spark):
    df = frame(spark, a=100 + np.cumsum(arma(500, 0.6, 0.3)), short=[3.0, 4.0, 4.0])
    p = {r["series_id"]: r for r in forecasting.arima_parameters(df).collect()}
    forecast = forecasting.arima_forecast(df, 5)
    step, level, expected = p["a"]["phi"] * p["a"]["last_w"] + p["a"]["theta"] * p["a"]["last_e"], p["a"]["last_y"], []
    for _ in range(5):
        level += step
        step *= p["a"]["phi"]
        expected.append(level)
    assert np.allclose(column(forecast, "yhat", order="h"), expected)
    # Too short to fit: the last value stays.
    assert column(forecast, "yhat", "short", order="h") == [4.0] * 5
    assert column(forecast, "t", order="h")[0] == START + datetime.timedelta(days=500)


def test_additive_forecast_beats_the_last_value(spark):
    t = np.arange(800)
    y = 100 + 0.1 * t + 10 * np.sin(2 * np.pi * t / 7) + 20 * np.sin(2 * np.pi * t / 365.25) + noise(800)
    scores = forecasting.evaluate_models(frame(spark, a=y, b=2 * y), "additive", by=("series_id", "model"))
    naive = np.abs(y[640:] - y[639]).mean()
    for row in scores.collect():
        assert row["points"] == 160 and row["mae"] < naive * (2 if row["series_id"] == "b" else 1) / 3


def test_metrics_skip_zero_actuals_in_the_percentage(spark):
    actual = frame(spark, a=[0.0, 10.0])
    forecast = actual.select("series_id", "t", F.lit("m").alias("model"), (F.col("y") + 1).alias("yhat"))
    row = forecasting.forecast_metrics(actual, forecast).first()
    assert (row["mae"], row["mse"], row["rmse"], row["mape_points"]) == (1.0, 1.0, 1.0, 1)
    assert row["mape"] == pytest.approx(10.0)


def test_panel_and_interval(spark):
    df = frame(spark, a=50 + noise(200), b=noise(200))
    panel = forecasting.forecast_panel(df, 4)
    assert panel.count() == 2 * 2 * 4
    assert forecasting.forecast_panel(df, 4, "arima").select("model").distinct().count() == 1
    rows = forecasting.forecast_interval(panel, 2.0).where("h = 4").collect()
    assert all(r["upper"] - r["yhat"] == pytest.approx(4 * r["sigma"]) for r in rows)


def test_selection_prefers_the_model_that_fits(spark):
    t = np.arange(160)
    df = series.feature_matrix(frame(spark, a=10 + 2.0 * t + 0.1 * noise(160)))
    small = {"random_forest": {"numTrees": 5, "maxDepth": 4}, "gradient_boosting": {"maxIter": 4}}
    chosen = learning.model_selection(df, 3, params=small)
    assert chosen.best == "linear_regression"
    assert chosen.scores.where("is_best").first()["model"] == chosen.best
    errors = chosen.model.transform(df).select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    assert errors < 1.0
    predicted = learning.fit_and_predict(df, "random_forest", **small["random_forest"])
    assert predicted.count() == 26
