"""Least squares and the forecasts that need it, as SQL: sums of products, then elimination by recursion."""

from __future__ import annotations

from tillwork.plans.series_queries import W, levinson_ctes


def elimination(name: str, system: str, width: str = "width") -> tuple[str, ...]:
    """CTEs that solve ``system`` (``series_id, i, j, v``, the right side in column ``width``) into ``name``."""
    return (f"""
{name}_steps AS (
  SELECT series_id, 0 AS k, i, j, CAST(v AS DOUBLE) AS v FROM {system}
  UNION ALL
  SELECT e.series_id, e.k + 1, e.i, e.j,
         CASE WHEN e.i = e.k THEN e.v / chosen.v ELSE e.v - own.v * across.v / chosen.v END
  FROM {name}_steps AS e
  JOIN {name}_steps AS chosen ON chosen.series_id = e.series_id AND chosen.i = e.k AND chosen.j = e.k
  JOIN {name}_steps AS across ON across.series_id = e.series_id AND across.i = e.k AND across.j = e.j
  JOIN {name}_steps AS own ON own.series_id = e.series_id AND own.i = e.i AND own.j = e.k
)""", f"""
{name} AS MATERIALIZED (
  SELECT series_id, i, v FROM (SELECT *, MAX(j) OVER (PARTITION BY series_id) AS {width} FROM {name}_steps)
  WHERE k = {width} AND j = {width}
)""")


def design(features: list[str], rows: str, target: str, where: str) -> tuple[str, ...]:
    """CTE ``system`` of the regression of ``target`` on a few ``features`` of ``rows``."""
    count = len(features)
    values = [*features, target]
    sums = ", ".join(f"SUM({values[i]} * {values[j]}) AS s_{i}_{j}"
                     for i in range(count) for j in range(count + 1))
    entries = "\n  UNION ALL ".join(
        f"SELECT series_id, {i} AS i, {j} AS j, s_{i}_{j} AS v FROM products"
        for i in range(count) for j in range(count + 1))
    return (f"""
products AS MATERIALIZED (SELECT series_id, {sums} FROM {rows} WHERE {where} GROUP BY 1)""", f"""
system AS MATERIALIZED (
  {entries}
)""")


def residual_ctes(series: str, order: int = 20) -> tuple[str, ...]:
    """CTEs that end in ``residuals``: differences of ``series`` and what a long autoregression leaves of them."""
    return (f"""
steps AS (
  SELECT * FROM (SELECT series_id, t, y, y - LAG(y) OVER {W} AS w FROM {series}) AS d
  WHERE w IS NOT NULL
)""", *levinson_ctes("steps", "w", order), f"""
residuals AS MATERIALIZED (
  SELECT a.series_id, a.t, a.pos, a.v AS w, a.v - SUM(ar[CAST(a.pos - b.pos AS INTEGER)] * b.v) AS e
  FROM at_row AS a
  JOIN (SELECT series_id, ar FROM levinson WHERE k = {order}) AS long_fit
    ON long_fit.series_id = a.series_id
  JOIN at_row AS b ON b.series_id = a.series_id AND b.pos BETWEEN a.pos - {order} AND a.pos - 1
  WHERE a.pos > {order}
  GROUP BY a.series_id, a.t, a.pos, a.v
)""")


_SQUARES = """ww + phi * phi * aa + theta * theta * bb - 2 * phi * wa - 2 * theta * wb
                + 2 * phi * theta * ab"""


def arima_ctes(series: str = "series", horizon: str = "30") -> tuple[str, ...]:
    """CTEs that end in ``arima``: the forecast of order (1,1,1) in closed form.

    ``horizon`` is an expression over the series' last row, ``ends_of``.
    """
    return (*residual_ctes(series), f"""
paired AS (
  SELECT *, LAG(w) OVER {W} AS w1, LAG(e) OVER {W} AS e1 FROM residuals
)""", """
sums AS (
  SELECT series_id, SUM(w1 * w1) AS aa, SUM(w1 * e1) AS ab, SUM(e1 * e1) AS bb, SUM(w * w1) AS wa,
         SUM(w * e1) AS wb, COUNT(e1) AS points, SUM(CASE WHEN e1 IS NOT NULL THEN w * w END) AS ww,
         arg_max(w, t) AS last_w, arg_max(e, t) AS last_e
  FROM paired GROUP BY 1
)""", """
fits AS (
  SELECT *, (bb * wa - ab * wb) / (aa * bb - ab * ab) AS own_phi,
         (aa * wb - ab * wa) / (aa * bb - ab * ab) AS own_theta
  FROM sums
)""", """
fitted AS (
  SELECT *, abs(own_phi) < 1 AND abs(own_theta) < 1 AS fit_ok,
         CASE WHEN abs(own_phi) < 1 AND abs(own_theta) < 1 THEN own_phi ELSE 0 END AS phi,
         CASE WHEN abs(own_phi) < 1 AND abs(own_theta) < 1 THEN own_theta ELSE 0 END AS theta
  FROM fits
)""", f"""
arima AS (
  SELECT fitted.series_id, 'arima' AS model, CAST(last_t + CAST(h AS INTEGER) AS DATE) AS t, CAST(h AS BIGINT) AS h,
         last_y + (phi * last_w + theta * last_e) * (1 - pow(phi, h)) / (1 - phi) AS yhat,
         sqrt(({_SQUARES}) / points) AS sigma, fit_ok
  FROM fitted
  JOIN (SELECT series_id, MAX(t) AS last_t, arg_max(y, t) AS last_y, COUNT(*) AS n FROM {series} GROUP BY 1) AS ends_of
    ON ends_of.series_id = fitted.series_id
  CROSS JOIN (SELECT unnest(generate_series(1, 3000)) AS h) AS horizon
  WHERE h <= {horizon}
)""")


def additive_ctes(series: str = "series", horizon: str = "30") -> tuple[str, ...]:
    """CTEs that end in ``additive``: the ridge fit of bends and seasons, from its definition.

    25 bends in the first 80 %, ten pairs of waves a year and three a week; prior scales 5, 0.05
    and 10. The noise is that of the residuals themselves, taken row by row.
    """
    ctes = [f"""
shape AS (
  SELECT *, last_bend, greatest(least(25, last_bend), 0) AS bends, greatest(n - 1, 1)::DOUBLE AS span,
         {horizon} AS periods
  FROM (
    SELECT series_id, MIN(t) AS first_t, COUNT(*) AS n, CAST(floor(COUNT(*) * 0.8::DOUBLE) AS INTEGER) - 1 AS last_bend,
           COALESCE(NULLIF(MAX(abs(y)), 0), 1) AS scale
    FROM {series} GROUP BY 1) AS ends_of
)""", """
grid AS (
  SELECT *, nth / span AS s, CAST(first_t - DATE '1970-01-01' AS BIGINT) + nth AS day
  FROM (SELECT *, unnest(range(0, n + periods)) AS nth FROM shape) AS days
)""", """
wave AS (
  SELECT period, k, 20 * (period = 7.0)::INTEGER + 2 * (k - 1) AS place
  FROM (VALUES (365.25::DOUBLE, 10), (7.0::DOUBLE, 3)) AS w(period, waves), range(1, 11) AS r(k) WHERE k <= waves
)""", """
feature AS MATERIALIZED (
  SELECT series_id, nth, 0 AS j, 5.0 AS prior, 1.0::DOUBLE AS x FROM grid
  UNION ALL SELECT series_id, nth, 1, 5.0, s FROM grid
  UNION ALL
  SELECT series_id, nth, 1 + k, 0.05, greatest(s - round_even(k * last_bend / bends::DOUBLE, 0) / span, 0)
  FROM grid, range(1, 26) AS r(k) WHERE k <= bends
  UNION ALL SELECT series_id, nth, 2 + bends + place, 10.0, sin(2 * pi() * k * day / period) FROM grid, wave
  UNION ALL SELECT series_id, nth, 3 + bends + place, 10.0, cos(2 * pi() * k * day / period) FROM grid, wave
)""", f"""
value AS MATERIALIZED (
  SELECT series_id, t - first_t AS nth, y / scale AS y FROM {series} JOIN shape USING (series_id)
)""", """
gram AS MATERIALIZED (
  SELECT a.series_id, a.j AS i, b.j AS j, SUM(a.x * b.x) AS v, any_value(a.prior) AS prior
  FROM feature AS a JOIN feature AS b ON b.series_id = a.series_id AND b.nth = a.nth
  JOIN shape ON shape.series_id = a.series_id WHERE a.nth < n GROUP BY 1, 2, 3
)""", """
moment AS MATERIALIZED (
  SELECT series_id, j AS i, SUM(x * y) AS v FROM feature JOIN value USING (series_id, nth) GROUP BY 1, 2
)""", """
noise_0 AS (SELECT series_id, 0.0025::DOUBLE AS noise FROM shape)"""]
    for k in (1, 2, 3):
        ctes += [f"""
ridge_{k} AS (
  SELECT gram.series_id, i, j, v + CASE WHEN i = j THEN noise / (prior * prior) + 1e-10 ELSE 0 END AS v
  FROM gram JOIN noise_{k - 1} USING (series_id)
  UNION ALL
  SELECT series_id, i, COUNT(*) OVER (PARTITION BY series_id), v FROM moment
)""", *elimination(f"beta_{k}", f"ridge_{k}"), f"""
left_{k} AS MATERIALIZED (
  SELECT series_id, nth, any_value(value.y) - SUM(x * v) AS e
  FROM feature JOIN value USING (series_id, nth) JOIN beta_{k} USING (series_id) WHERE beta_{k}.i = feature.j GROUP BY 1, 2
)""", f"""
noise_{k} AS (SELECT series_id, greatest(AVG(e * e), 1e-8) AS noise FROM left_{k} GROUP BY 1)"""]
    return (*ctes, """
additive AS (
  SELECT series_id, 'additive' AS model, CAST(first_t + CAST(n - 1 + h AS INTEGER) AS DATE) AS t, h, yhat * scale AS yhat,
         deviation * scale AS sigma, n > 1 AS fit_ok
  FROM (
    SELECT series_id, nth - n + 1 AS h, SUM(x * v) AS yhat
    FROM feature JOIN shape USING (series_id) JOIN beta_3 USING (series_id)
    WHERE beta_3.i = feature.j AND nth >= n GROUP BY 1, 2) AS ahead
  JOIN shape USING (series_id)
  JOIN (SELECT series_id, stddev_pop(e) AS deviation FROM left_3 GROUP BY 1) AS spread USING (series_id)
)""")
