"""Time-series features and tests over daily revenue per region."""

from __future__ import annotations

from functools import partial

from tillwork.operators import series
from tillwork.plans.oracle import on_sales, rounded as rounded_to
from tillwork.plans.registry import query
from tillwork.sources.star import Star

# Daily revenue is large, so two places leave enough digits for rounding noise.
PLACES = 2
revenue_query = partial(query, digits=PLACES)


def rounded(expression: str) -> str:
    return rounded_to(expression, PLACES)


DAILY = """
daily AS (
  SELECT region AS series_id, CAST(transaction_date AS DATE) AS t,
         CAST(SUM(total_amount) AS DOUBLE) AS y
  FROM sales WHERE region IS NOT NULL AND transaction_date IS NOT NULL GROUP BY 1, 2
)"""
SERIES = (DAILY, """
ends AS (SELECT series_id, MIN(t) AS first_t, MAX(t) AS last_t FROM daily GROUP BY 1)""", """
spine AS (
  SELECT series_id, CAST(unnest(generate_series(first_t, last_t, INTERVAL 1 DAY)) AS DATE) AS t
  FROM ends
)""", """
series AS (
  SELECT spine.series_id, spine.t, COALESCE(daily.y, 0) AS y
  FROM spine LEFT JOIN daily ON daily.series_id = spine.series_id AND daily.t = spine.t
)""")
W = "(PARTITION BY series_id ORDER BY t)"


def by_region(star: Star, fill: bool = True):
    return series.series_from_sales(
        star.summed(["region", "transaction_date"], ["total_amount"]), "region", fill=fill)


@revenue_query("prepare_series", on_sales(f"SELECT series_id, t, {rounded('y')} AS y FROM daily", DAILY))
def prepare_series(star: Star):
    return by_region(star, fill=False)


@revenue_query("date_spine", on_sales(f"SELECT series_id, t, {rounded('y')} AS y FROM series", *SERIES))
def date_spine(star: Star):
    return by_region(star)


@query("future_days", on_sales("""
SELECT series_id, CAST(last_t + CAST(h AS INTEGER) AS DATE) AS t, CAST(h AS BIGINT) AS h
FROM ends CROSS JOIN (SELECT unnest(generate_series(1, 30)) AS h) AS steps""", *SERIES))
def future_days(star: Star):
    return series.future_days(by_region(star), 30)


N_OBS = "CAST(n_obs AS DOUBLE)"
CRITICAL = f"(-2.86154 - 2.8903 / {N_OBS} - 4.234 / ({N_OBS} * {N_OBS}) - 40.040 / ({N_OBS} * {N_OBS} * {N_OBS}))"


@query("stationarity_test", on_sales(f"""
SELECT series_id, n_obs, {rounded_to('statistic')} AS statistic,
       {rounded_to(CRITICAL)} AS critical_value, statistic < {CRITICAL} AS is_stationary
FROM (
  SELECT series_id, n_obs,
         (sxy / sxx) / sqrt((syy - sxy * sxy / sxx) / (n_obs - 2) / sxx) AS statistic
  FROM (
    SELECT series_id, CAST(regr_count(d, x) AS BIGINT) AS n_obs, regr_sxx(d, x) AS sxx,
           regr_sxy(d, x) AS sxy, regr_syy(d, x) AS syy
    FROM (SELECT series_id, LAG(y) OVER {W} AS x, y - LAG(y) OVER {W} AS d FROM series) AS steps
    WHERE x IS NOT NULL GROUP BY series_id
  ) AS sums
) AS fitted""", *SERIES))
def stationarity_test(star: Star):
    return series.stationarity_test(by_region(star))


def rolling_sql(window: int, names: tuple[str, str], first: int = 0) -> str:
    frame = f"(PARTITION BY series_id ORDER BY t ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return ",\n       ".join(
        f"CASE WHEN COUNT(y) OVER {frame} = {window} THEN {rounded(f'{function}(y) OVER {frame}')} END"
        f" AS {name}" for function, name in zip(("AVG", "STDDEV_SAMP"), names))


@revenue_query("rolling_stats", on_sales(f"""
SELECT series_id, t, {rounded('y')} AS y, {rolling_sql(30, ('rolling_mean', 'rolling_std'))}
FROM series""", *SERIES))
def rolling_stats(star: Star):
    return series.rolling_stats(by_region(star))


@query("autocorrelation", on_sales(f"""
SELECT series_id, lag, {rounded_to('product / variance')} AS acf
FROM (
  SELECT a.series_id, k AS lag, SUM(a.d * b.d) AS product
  FROM centred AS a
  CROSS JOIN (SELECT unnest(generate_series(0, 40)) AS k) AS lags
  JOIN centred AS b ON b.series_id = a.series_id AND b.pos = a.pos - k
  GROUP BY a.series_id, k
) AS products
JOIN (SELECT series_id, SUM(d * d) AS variance FROM centred GROUP BY 1) AS v USING (series_id)""",
    *SERIES, f"""
centred AS (
  SELECT series_id, row_number() OVER {W} AS pos,
         y - AVG(y) OVER (PARTITION BY series_id) AS d
  FROM series
)"""))
def autocorrelation(star: Star):
    return series.autocorrelation(by_region(star))


def levinson_ctes(rows: str, column: str, lags: int) -> tuple[str, ...]:
    """CTEs that end in ``levinson``: per series and order, coefficients and the last of them."""
    return (f"""
at_row AS (
  SELECT series_id, t, row_number() OVER {W} AS pos, {column} AS v FROM {rows}
)""", f"""
lag_products AS (
  SELECT a.series_id, k, SUM(a.v * b.v) AS product
  FROM at_row AS a CROSS JOIN (SELECT unnest(generate_series(0, {lags})) AS k) AS ks
  JOIN at_row AS b ON b.series_id = a.series_id AND b.pos = a.pos - k
  GROUP BY 1, 2
)""", """
product_list AS (
  SELECT series_id, list(product ORDER BY k) AS r FROM lag_products GROUP BY 1
)""", f"""
levinson AS (
  SELECT series_id, 0 AS k, CAST([] AS DOUBLE[]) AS ar, r[1] AS rest, CAST(1 AS DOUBLE) AS phi
  FROM product_list
  UNION ALL
  SELECT series_id, k + 1,
         list_append(list_transform(range(1, k + 1), lambda j: ar[j] - new_phi * ar[k + 1 - j]), new_phi),
         rest * (1 - new_phi * new_phi), new_phi
  FROM (
    SELECT levinson.series_id, k, ar, rest,
           (r[k + 2] - COALESCE(list_sum(list_transform(
              range(1, k + 1), lambda j: ar[j] * r[k + 2 - j])), 0)) / rest AS new_phi
    FROM levinson JOIN product_list ON product_list.series_id = levinson.series_id
    WHERE k < {lags}
  ) AS solved
)""")


def recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


@query("partial_autocorrelation", recursive(on_sales(
    f"SELECT series_id, CAST(k AS BIGINT) AS lag, {rounded_to('phi')} AS pacf FROM levinson",
    *SERIES, """
deviations AS (SELECT series_id, t, y - AVG(y) OVER (PARTITION BY series_id) AS d FROM series)""",
    *levinson_ctes("deviations", "d", 40))))
def partial_autocorrelation(star: Star):
    return series.partial_autocorrelation(by_region(star))


@revenue_query("seasonal_decompose", on_sales(f"""
SELECT series_id, t, {rounded('y')} AS y, {rounded('trend')} AS trend,
       {rounded('phase_mean - level')} AS seasonal,
       {rounded('y - trend - (phase_mean - level)')} AS residual
FROM trended
JOIN phases USING (series_id, phase)
JOIN (SELECT series_id, AVG(phase_mean) AS level FROM phases GROUP BY 1) AS levels
  USING (series_id)""", *SERIES, f"""
placed AS (
  SELECT *, row_number() OVER {W} - 1 AS pos, COUNT(*) OVER (PARTITION BY series_id) AS n
  FROM series
)""", """
trended AS (
  SELECT *, pos % 7 AS phase,
         CASE WHEN pos >= 3 AND pos < n - 3 THEN AVG(y) OVER (
           PARTITION BY series_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS trend
  FROM placed
)""", """
phases AS (
  SELECT series_id, phase, AVG(y - trend) AS phase_mean FROM trended GROUP BY 1, 2
)"""))
def seasonal_decompose(star: Star):
    return series.seasonal_decompose(by_region(star), period=7)


CALENDAR = """EXTRACT(YEAR FROM t) AS year, EXTRACT(MONTH FROM t) AS month,
       EXTRACT(DAY FROM t) AS day, EXTRACT(ISODOW FROM t) - 1 AS dayofweek,
       EXTRACT(QUARTER FROM t) AS quarter,
       CAST(CASE WHEN EXTRACT(ISODOW FROM t) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend"""
LAGGED = ", ".join(f"{rounded(f'LAG(y, {k}) OVER {W}')} AS y_lag_{k}" for k in series.LAGS)
ROLLED = ",\n       ".join(
    rolling_sql(w, (f"y_rolling_mean_{w}", f"y_rolling_std_{w}")) for w in series.WINDOWS)


@revenue_query("calendar_features", on_sales(
    f"SELECT series_id, t, {rounded('y')} AS y, {CALENDAR} FROM series", *SERIES))
def calendar_features(star: Star):
    return series.calendar_features(by_region(star))


@revenue_query("lag_features", on_sales(
    f"SELECT series_id, t, {rounded('y')} AS y, {LAGGED} FROM series", *SERIES))
def lag_features(star: Star):
    return series.lag_features(by_region(star))


@revenue_query("rolling_features", on_sales(
    f"SELECT series_id, t, {rounded('y')} AS y, {ROLLED} FROM series", *SERIES))
def rolling_features(star: Star):
    return series.rolling_features(by_region(star))


@revenue_query("feature_matrix", on_sales(f"""
SELECT * FROM (
  SELECT series_id, t, {rounded('y')} AS y, {CALENDAR}, {LAGGED}, {ROLLED} FROM series
) AS features
WHERE y_lag_30 IS NOT NULL AND y_rolling_std_30 IS NOT NULL""", *SERIES))
def feature_matrix(star: Star):
    return series.feature_matrix(by_region(star))


PLACED = f"""
placed AS (
  SELECT *, row_number() OVER {W} - 1 AS pos, COUNT(*) OVER (PARTITION BY series_id) AS n
  FROM series
)"""


@revenue_query("time_series_split", on_sales(f"""
SELECT series_id, t, {rounded('y')} AS y, fold, role
FROM (
  SELECT series_id, t, y, CAST(fold AS BIGINT) AS fold,
         CASE WHEN pos < n - (3 - fold) * (n // 4) THEN 'train'
              WHEN pos < n - (2 - fold) * (n // 4) THEN 'test' END AS role
  FROM placed CROSS JOIN (SELECT unnest(generate_series(0, 2)) AS fold) AS folds
) AS split
WHERE role IS NOT NULL""", *SERIES, PLACED))
def time_series_split(star: Star):
    return series.time_series_split(by_region(star))


@revenue_query("holdout_split", on_sales(f"""
SELECT series_id, t, {rounded('y')} AS y,
       CASE WHEN pos < floor(n * (1 - CAST(0.2 AS DOUBLE))) THEN 'train' ELSE 'test' END AS role
FROM placed""", *SERIES, PLACED))
def holdout_split(star: Star):
    return series.holdout_split(by_region(star))


@revenue_query("history_window", on_sales(f"""
SELECT series_id, t, {rounded('y')} AS y FROM placed WHERE pos >= n - 90""", *SERIES, PLACED))
def history_window(star: Star):
    return series.history_window(by_region(star))
