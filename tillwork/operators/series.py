"""Features and tests for many time series in one job.

A series frame is long: ``series_id``, ``t`` (DATE) and ``y`` (DOUBLE), one
row per series and day. A series is bounded by the calendar, whatever the
number of sales behind it, so a window or a task per series stays small; the
series themselves are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tillwork.functions.dates import day_of
from tillwork.functions.least_squares import product_sums, regression_of, solved, squared_residuals
from tillwork.functions.measures import ratio
from tillwork.functions.recursions import durbin_levinson


# MacKinnon's (2010) response surface for the 5 % critical value
# of the Dickey-Fuller statistic with a constant, in powers of 1/n.
MACKINNON_5_PERCENT = (-2.86154, -2.8903, -4.234, -40.040)

LAGS = (1, 7, 30)
WINDOWS = (7, 30)


def in_time() -> WindowSpec:
    return Window.partitionBy("series_id").orderBy("t")


def whole() -> WindowSpec:
    return Window.partitionBy("series_id")


def series_from_sales(
    sales: DataFrame, by: str | None = None, measure: str = "total_amount", fill: bool = True
) -> DataFrame:
    """Daily totals of ``measure``, one series per value of ``by`` or one in all.

    ``fill`` adds the days without sales as zeros.
    """
    series_id = F.lit("all") if by is None else F.col(by)
    daily = (
        sales.where(F.col("transaction_date").isNotNull() & series_id.isNotNull())
        .groupBy(series_id.alias("series_id"), day_of(F.col("transaction_date")).alias("t"))
        .agg(F.sum(measure).cast("double").alias("y"))
    )
    daily = prepare_series(daily)
    return fill_days(daily) if fill else daily


def prepare_series(
    df: DataFrame, date_column: str = "t", target: str = "y", series: str | None = "series_id"
) -> DataFrame:
    """Bring a table into series form: parse dates, drop rows without a value."""
    series_id = F.lit("all") if series is None else F.col(series).cast("string")
    value = F.col(target).cast("double")
    return df.select(
        series_id.alias("series_id"), F.to_date(date_column).alias("t"),
        F.when(~F.isnan(value), value).alias("y"),
    ).dropna()


def fill_days(series: DataFrame, value: float = 0.0) -> DataFrame:
    """Add the missing days between a series' first and last, with ``value``.

    Each row brings the days up to the next row along, so nothing is joined.
    """
    upto = F.coalesce(F.date_sub(F.lead("t").over(in_time()), 1), F.col("t"))
    return (
        series.withColumn("upto", upto)
        .withColumn("day", F.explode(F.sequence("t", "upto")))
        .select("series_id", F.col("day").alias("t"),
                F.when(F.col("day") == F.col("t"), F.col("y")).otherwise(F.lit(value)).alias("y"))
    )


def future_days(series: DataFrame, periods: int) -> DataFrame:
    """The ``periods`` days after each series' last, numbered from 1 in ``h``."""
    last = series.groupBy("series_id").agg(F.max("t").alias("last"))
    return last.select(
        "series_id", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"), "last",
    ).select("series_id", F.date_add("last", F.col("h")).alias("t"), "h")


def dickey_fuller_critical(n: Column) -> Column:
    b0, b1, b2, b3 = MACKINNON_5_PERCENT
    n = F.nullif(n, F.lit(0.0))
    return F.lit(b0) + F.lit(b1) / n + F.lit(b2) / (n * n) + F.lit(b3) / (n * n * n)


def _augmented_dickey_fuller(series: DataFrame, lags: int) -> DataFrame:
    """Length and t-statistic of the level in a regression of differences on a constant, the level and
    ``lags`` differences before.

    The statistic is the same for standardised values, whose sums lose fewer digits.
    """
    deviation = F.coalesce(F.nullif(F.stddev_samp("y").over(whole()), F.lit(0.0)), F.lit(1.0))
    scaled = series.withColumn("z", (F.col("y") - F.avg("y").over(whole())) / deviation).withColumn(
        "x", F.lag("z").over(in_time())).withColumn("d", F.col("z") - F.col("x"))
    steps = scaled.where(F.col("d").isNotNull()).withColumn("past", past_values("d", lags))
    features = [F.lit(1.0), F.col("x"), *(F.get("past", F.lit(k)) for k in range(lags))]
    sums = regression_of(steps.groupBy("series_id").agg(
        *product_sums(features, F.col("d"), F.size("past") == lags)), lags + 2)
    # The level is the second feature: its row of the inverse matrix gives its variance.
    unit = F.array(*(F.lit(1.0 if i == 1 else 0.0) for i in range(lags + 2)))
    fitted = sums.withColumn("beta", solved(F.col("gram"), F.col("moment"))).withColumn(
        "inverse", solved(F.col("gram"), unit))
    rest = squared_residuals(F.col("gram"), F.col("moment"), F.col("squares"), F.col("beta"))
    variance = F.try_divide(rest, F.col("rows") - (lags + 2))
    error = F.sqrt(variance * F.get("inverse", F.lit(1)))
    statistic = F.when(F.col("rows") > lags + 2, F.try_divide(F.get("beta", F.lit(1)), error))
    lengths = series.groupBy("series_id").agg(F.greatest(F.count("y") - 1 - lags, F.lit(0)).alias("n_obs"))
    return lengths.join(fitted.select("series_id", statistic.alias("statistic")), "series_id", "left")


def stationarity_test(series: DataFrame, lags: int = 0) -> DataFrame:
    """Dickey-Fuller test with a constant; stationary when below the 5 % critical value.

    ``lags`` adds lagged differences to the regression.
    """
    if lags == 0:
        previous = F.lag("y").over(in_time())
        steps = series.withColumn("x", previous).withColumn("d", F.col("y") - F.col("x"))
        fitted = steps.where(F.col("x").isNotNull()).groupBy("series_id").agg(
            F.regr_count("d", "x").alias("n_obs"), F.regr_sxx("d", "x").alias("sxx"),
            F.regr_sxy("d", "x").alias("sxy"), F.regr_syy("d", "x").alias("syy"),
        )
        slope = ratio(F.col("sxy"), F.col("sxx"))
        error = F.sqrt(F.try_divide(
            (F.col("syy") - slope * F.col("sxy")) / F.nullif(F.col("n_obs") - 2, F.lit(0)), F.col("sxx")))
        fitted = fitted.select("series_id", "n_obs", ratio(slope, error).alias("statistic"))
    else:
        fitted = _augmented_dickey_fuller(series, lags)
    critical = dickey_fuller_critical(F.col("n_obs").cast("double"))
    return fitted.select(
        "series_id", "n_obs", "statistic", critical.alias("critical_value"),
        (F.col("statistic") < critical).alias("is_stationary"),
    )


def rolling(column: str, window: int, exclude_current: bool = False) -> tuple[Column, Column]:
    """Mean and sample deviation of the last ``window`` rows; NULL until there are that many."""
    end = -1 if exclude_current else 0
    frame = in_time().rowsBetween(end - window + 1, end)
    full = F.count(column).over(frame) == window
    return (
        F.when(full, F.avg(column).over(frame)),
        F.when(full, F.stddev_samp(column).over(frame)),
    )


def rolling_stats(series: DataFrame, window: int = 30) -> DataFrame:
    """Rolling mean and deviation of each series."""
    average, deviation = rolling("y", window)
    return series.select(
        "series_id", "t", "y", average.alias("rolling_mean"), deviation.alias("rolling_std"))


def past_values(column: str, lags: int) -> Column:
    """The values of a column one to ``lags`` rows earlier, latest first; fewer at the start."""
    return F.reverse(F.collect_list(column).over(in_time().rowsBetween(-lags, -1)))


def lagged_products(series: DataFrame, column: str, lags: int) -> DataFrame:
    """Per series and lag 0 to ``lags``: the sum of products of a column with its earlier self.

    Rows stay with their series' window partition, so this needs no shuffle.
    """
    past = F.concat(F.array(column), past_values(column, lags))
    return (
        series.select("series_id", F.col(column).alias("value"), past.alias("past"))
        .select("series_id", "value", F.posexplode("past").alias("lag", "earlier"))
        .groupBy("series_id", "lag").agg(F.sum(F.col("value") * F.col("earlier")).alias("product"))
    )


def centred(series: DataFrame) -> DataFrame:
    """Add ``d``, the value less the series' mean."""
    return series.withColumn("d", F.col("y") - F.avg("y").over(whole()))


def product_arrays(products: DataFrame, lags: int) -> DataFrame:
    """``lagged_products`` as one array per series; lags a series is too short for are zero."""
    by_lag = F.map_from_entries(F.collect_list(F.struct("lag", "product")))
    filled = F.transform(
        F.sequence(F.lit(0), F.lit(lags)), lambda k: F.coalesce(by_lag[k], F.lit(0.0)))
    return products.groupBy("series_id").agg(filled.alias("products"))


def autocorrelation(series: DataFrame, lags: int = 40) -> DataFrame:
    """Autocorrelation of each series at lags 0 to ``lags``."""
    variance = F.max(F.when(F.col("lag") == 0, F.col("product"))).over(whole())
    return lagged_products(centred(series), "d", lags).select(
        "series_id", "lag", F.try_divide("product", variance).alias("acf"))


def partial_autocorrelation(series: DataFrame, lags: int = 40) -> DataFrame:
    """Partial autocorrelation of each series at lags 0 to ``lags``."""
    products = product_arrays(lagged_products(centred(series), "d", lags), lags)
    with_zero = F.concat(F.array(F.lit(1.0)), durbin_levinson(F.col("products"), lags)["pacf"])
    return products.select("series_id", F.posexplode(with_zero).alias("lag", "pacf"))


def seasonal_decompose(series: DataFrame, period: int = 365, model: str = "additive") -> DataFrame:
    """Trend, seasonal and residual part of each series.

    The trend is a centred moving average over one period, with half weights at
    both ends when the period is even; the seasonal part is the mean deviation
    of each phase. A series shorter than two periods gets NULLs.
    """
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    half = period // 2
    inner = in_time().rowsBetween(-half, half) if period % 2 else in_time().rowsBetween(1 - half, half - 1)
    window_sum = F.sum("y").over(inner)
    if period % 2 == 0:
        window_sum = window_sum + 0.5 * (F.lag("y", half).over(in_time()) + F.lead("y", half).over(in_time()))
    whole_window = (F.col("at") >= half) & (F.col("at") < F.col("n") - half)
    long_enough = F.col("n") >= 2 * period

    def remove(whole: Column, part: Column) -> Column:
        return whole - part if model == "additive" else F.try_divide(whole, part)

    at = (F.row_number().over(in_time()) - 1).alias("at")
    rows = series.select("*", at, F.count("y").over(whole()).alias("n")).withColumn(
        "trend", F.when(long_enough & whole_window, window_sum / period))
    by_phase = Window.partitionBy("series_id", "phase")
    phased = (
        rows.withColumn("phase", F.col("at") % period)
        .withColumn("detrended", remove(F.col("y"), F.col("trend")))
        .withColumn("phase_mean", F.avg("detrended").over(by_phase))
        .withColumn("phase_share", F.col("phase_mean") / F.count(F.lit(1)).over(by_phase))
        # Each phase's shares add up to its mean.
        .withColumn("level", F.sum("phase_share").over(whole()) / period)
        .withColumn("seasonal", F.when(long_enough, remove(F.col("phase_mean"), F.col("level"))))
    )
    residual = remove(remove(F.col("y"), F.col("trend")), F.col("seasonal"))
    return phased.select("series_id", "t", "y", "trend", "seasonal", residual.alias("residual"))


def calendar_features(series: DataFrame) -> DataFrame:
    """Add year, month, day, weekday (Monday = 0), quarter and a weekend flag."""
    t = F.col("t")
    return series.withColumns({
        "year": F.year(t), "month": F.month(t), "day": F.day(t), "dayofweek": F.weekday(t),
        "quarter": F.quarter(t), "is_weekend": F.weekday(t).isin(5, 6).cast("int"),
    })


def lag_features(series: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    """Add the value so many rows earlier."""
    return series.withColumns({f"y_lag_{k}": F.lag("y", k).over(in_time()) for k in lags})


def rolling_features(
    series: DataFrame, windows: Sequence[int] = WINDOWS, exclude_current: bool = False
) -> DataFrame:
    """Add rolling means and deviations.

    By default a window ends with the row itself, so the target is part of its
    own features; ``exclude_current`` ends it one row earlier.
    """
    columns = {}
    for window in windows:
        average, deviation = rolling("y", window, exclude_current)
        columns[f"y_rolling_mean_{window}"] = average
        columns[f"y_rolling_std_{window}"] = deviation
    return series.withColumns(columns)


def feature_names(lags: Sequence[int] = LAGS, windows: Sequence[int] = WINDOWS) -> list[str]:
    names = ["year", "month", "day", "dayofweek", "quarter", "is_weekend"]
    names += [f"y_lag_{k}" for k in lags]
    for window in windows:
        names += [f"y_rolling_mean_{window}", f"y_rolling_std_{window}"]
    return names


def feature_matrix(series: DataFrame, exclude_current: bool = False) -> DataFrame:
    """All features of the rows where every one is known."""
    features = rolling_features(lag_features(calendar_features(series)), exclude_current=exclude_current)
    return features.dropna()


def with_position(series: DataFrame) -> DataFrame:
    """Add ``at``, the row's place from 0, and ``n``, the length of its series."""
    return series.withColumns({
        "at": F.row_number().over(in_time()) - 1,
        "n": F.count(F.lit(1)).over(whole()),
    })


def time_series_split(rows: DataFrame, folds: int = 3) -> DataFrame:
    """Rows repeated per fold with ``role`` train or test.

    Test blocks are the last ``folds`` blocks of ``n div (folds + 1)`` rows; a
    fold trains on all rows before its block.
    """
    size = F.floor(F.col("n") / (folds + 1))
    start = F.col("n") - (F.lit(folds) - F.col("fold")) * size
    role = F.when(F.col("at") < start, "train").when(F.col("at") < start + size, "test")
    return (
        with_position(rows)
        .withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
        .withColumn("role", role)
        .where(F.col("role").isNotNull())
        .drop("at", "n")
    )


def holdout_split(series: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Mark the first part of each series ``train`` and the rest ``test``."""
    cut = F.floor(F.col("n") * F.lit(1 - test_size))
    return with_position(series).withColumn(
        "role", F.when(F.col("at") < cut, "train").otherwise("test")).drop("at", "n")


def history_window(series: DataFrame, points: int = 90) -> DataFrame:
    """The last ``points`` rows of each series."""
    backwards = Window.partitionBy("series_id").orderBy(F.col("t").desc())
    return (
        series.withColumn("_age", F.row_number().over(backwards))
        .where(F.col("_age") <= points).drop("_age")
    )
