"""Sums of products, elimination, the step-down test and the fits built on them, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_series import column, frame, noise
from tillwork.functions.least_squares import (
    gram_matrix, product_sums, regression_of, solved, squared_residuals, stable,
)
from tillwork.operators import forecasting, series


def test_gram_matrix_and_solution(spark):
    chance = np.random.default_rng(1)
    x = chance.normal(size=(400, 6)) * [1, 10, 0.1, 3, 1, 5]
    y = x @ [1, -2, 3, 0, 0.5, 1] + chance.normal(size=400)
    rows = spark.createDataFrame(
        [(i % 2, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "g int, x array<double>, y double")
    wide = {r["g"]: r for r in gram_matrix(rows.repartition(5), ["g"], F.concat("x", F.array("y"))).collect()}
    sums = rows.groupBy("g").agg(*product_sums([F.get("x", F.lit(i)) for i in range(6)], F.col("y"), F.lit(True)))
    fits = regression_of(sums, 6).withColumn("b", solved(F.col("gram"), F.col("moment"))).withColumn(
        "rss", squared_residuals(F.col("gram"), F.col("moment"), F.col("squares"), F.col("b")))
    for r in fits.collect():
        xs, ys = x[r["g"]::2], y[r["g"]::2]
        whole = np.column_stack([xs, ys])
        assert np.allclose(wide[r["g"]]["gram"], whole.T @ whole) and wide[r["g"]]["rows"] == r["rows"] == 200
        expected, rss, *_ = np.linalg.lstsq(xs, ys, rcond=None)
        assert np.allclose(r["b"], expected) and r["rss"] == pytest.approx(rss[0])


def test_singular_systems_have_no_solution(spark):
    rows = spark.createDataFrame(
        [([[1.0, 2.0], [2.0, 4.0]], [1.0, 2.0]), ([[0.0]], [1.0]), ([[4.0]], [1.0])],
        "a array<array<double>>, b array<double>")
    found = [r[0] for r in rows.select(solved(F.col("a"), F.col("b"))).collect()]
    assert None in found[0] and found[1:] == [[None], [0.25]]


def test_step_down_is_the_test_of_the_roots(spark):
    chance = np.random.default_rng(3)
    cases = [[], [0.5], [1.0], [-1.2], [None]]
    cases += [[float(v) for v in chance.uniform(-1.2, 1.2, k)] for k in (1, 2, 3, 4) for _ in range(60)]
    rows = spark.createDataFrame([(c,) for c in cases], "ar array<double>")
    found = [r[0] for r in rows.select(stable(F.col("ar"))).collect()]
    for case, ok in zip(cases, found, strict=True):
        if None in case:
            assert not ok
        else:
            # All roots of z^p - a_1 z^(p-1) - ... lie inside the unit circle.
            assert ok == all(abs(root) < 1 for root in np.roots([1.0, *(-a for a in case)]))
    assert 20 < sum(found) < 220


def arma_of(n, ar, ma, seed=1):
    e = noise(n + 50, seed)
    w = np.zeros(n + 50)
    for i in range(len(w)):
        w[i] = e[i] + sum(a * w[i - k] for k, a in enumerate(ar, 1) if i >= k) + sum(
            b * e[i - k] for k, b in enumerate(ma, 1) if i >= k)
    return w[50:]


@pytest.mark.parametrize("order,ar,ma", [
    ((2, 1, 0), [0.5, -0.3], []), ((0, 1, 1), [], [0.6]), ((2, 0, 1), [0.9, -0.2], [0.4]), ((1, 2, 0), [-0.4], []),
    ((2, 1, 2), [0.4, -0.5], [0.5, 0.3])])
def test_orders_recover_their_parameters(spark, order, ar, ma):
    y = arma_of(6000, ar, ma)
    for _ in range(order[1]):
        y = np.cumsum(y)
    row = forecasting.arima_parameters(frame(spark, a=y), 3, order).first()
    assert row["fit_ok"] and np.allclose([*row["ar"], *row["ma"]], [*ar, *ma], atol=0.08)
    # The forecast is the recursion, summed up as often as the series was differenced.
    w, e, steps = list(row["last_ws"]), list(row["last_es"]), []
    for _ in range(3):
        steps.append(np.dot(row["ar"], w) + np.dot(row["ma"], e))
        w, e = [steps[-1], *w][:order[0]], [0.0, *e][:order[2]]
    for level in reversed(row["levels"]):
        steps = list(level + np.cumsum(steps))
    forecast = forecasting.arima_forecast(frame(spark, a=y), 3, order)
    assert np.allclose(column(forecast, "yhat", order="h"), steps)
    assert forecast.where("fit_ok").count() == 3
    assert row["sigma"] == pytest.approx(1.0, abs=0.06)


def test_fits_that_fail_say_so(spark):
    grow = 1.3 ** np.arange(60)
    df = frame(spark, grow=np.cumsum(grow), flat=[5.0] * 60, short=[1.0, 2.0], one=[7.0])
    for order in ((1, 1, 0), (1, 1, 1), (2, 2, 1)):
        rows = forecasting.arima_forecast(df, 2, order, long_order=3).collect()
        assert len(rows) == 8 and not any(r["fit_ok"] for r in rows if r["series_id"] != "grow")
        got = {(r["series_id"], r["h"]): r["yhat"] for r in rows}
        assert got["flat", 2] == 5.0 and got["one", 2] == 7.0
        assert got["short", 2] == (2.0 if order[1] == 1 else 4.0)
    assert not forecasting.arima_parameters(df.where("series_id = 'grow'"), 2, (1, 1, 0)).first()["fit_ok"]
    assert forecasting.arima_forecast(df, 0, (1, 1, 0)).count() == 0
    with pytest.raises(ValueError, match="negative"):
        forecasting.arima_forecast(df, 2, (1, -1, 0))


def additive_by_hand(y, first_day, periods):
    n = len(y)
    scale, span, last = np.abs(y).max() or 1.0, max(n - 1, 1), int(n * 0.8) - 1
    count = max(min(25, last), 0)
    bends = np.rint(np.arange(1, count + 1) * last / count) / span if count else np.zeros(0)

    def design(at):
        s = at / span
        columns = [np.ones(len(at)), s, *(np.maximum(s - b, 0) for b in bends)]
        for period, order in ((365.25, 10), (7.0, 3)):
            for k in range(1, order + 1):
                angle = 2 * np.pi * k * (first_day + at) / period
                columns += [np.sin(angle), np.cos(angle)]
        return np.column_stack(columns)

    x, noise_of = design(np.arange(n)), 0.0025
    prior = np.r_[5.0, 5.0, np.full(count, 0.05), np.full(26, 10.0)]
    for _ in range(3):
        beta = np.linalg.solve(x.T @ x + np.diag(noise_of / prior ** 2 + 1e-10), x.T @ (y / scale))
        left = y / scale - x @ beta
        noise_of = max(left @ left / n, 1e-8)
    return design(n - 1 + np.arange(1, periods + 1)) @ beta * scale, left.std() * scale


def test_additive_fit_is_the_ridge_regression(spark):
    t = np.arange(500)
    named = {"long": 100 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 7) + noise(500), "short": 5 + noise(12),
             "zero": np.zeros(40), "two": np.array([1.0, 3.0])}
    rows = forecasting.additive_forecast(frame(spark, **named), 6).orderBy("h").collect()
    for name, y in named.items():
        yhat, sigma = additive_by_hand(y, 19358, 6)
        assert np.allclose([r["yhat"] for r in rows if r["series_id"] == name], yhat, rtol=1e-6, atol=1e-6)
        assert next(r["sigma"] for r in rows if r["series_id"] == name) == pytest.approx(sigma, rel=1e-4, abs=1e-6)
    one = forecasting.additive_forecast(frame(spark, a=[4.0]), 2).collect()
    assert len(one) == 2 and not any(r["fit_ok"] for r in one)


def test_series_of_one_calendar_share_their_gram_matrix(spark):
    df = frame(spark, **{f"s{i}": noise(60, i) for i in range(5)}, other=noise(30))
    days = []
    real = forecasting.gram_matrix

    def counted(rows, *rest):
        days.append(rows.count())
        return real(rows, *rest)

    forecasting.gram_matrix = counted
    try:
        assert forecasting.additive_forecast(df, 1).count() == 6
    finally:
        forecasting.gram_matrix = real
    assert days == [90]


def test_lagged_dickey_fuller_is_the_regression(spark):
    walk, lags = 1e6 + 1e3 * np.cumsum(noise(200)), 4
    got = {r["series_id"]: r for r in series.stationarity_test(
        frame(spark, a=walk, b=range(6), c=[3.0] * 40), lags).collect()}
    d = np.diff(walk)
    x = np.column_stack([np.ones(len(d) - lags), walk[lags:-1], *(d[lags - k:len(d) - k] for k in range(1, lags + 1))])
    z = np.column_stack([x[:, :1], (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)])
    beta, rss, *_ = np.linalg.lstsq(z, d[lags:], rcond=None)
    error = np.sqrt(rss[0] / (len(z) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    assert got["a"]["statistic"] == pytest.approx(beta[1] / error, rel=1e-6) and got["a"]["n_obs"] == len(d) - lags
    assert got["b"]["statistic"] is None and got["c"]["statistic"] is None and got["b"]["n_obs"] == 1
