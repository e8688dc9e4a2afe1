"""Forecasts of daily series.

A day's place in its series is a rank, and a fit follows from sums over ranks and
values, so a series of any length is fitted without gathering it. Any number of
series is fitted in parallel; the raw rows are only ever pre-aggregated. Days
without rows are not filled: the rank counts the days that are present.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import DateLike, since
from tidemark.functions.numeric import rounded, sum_if

HISTORY_DAYS = 90
ALPHA = 0.3
#: The logarithm of the largest weight in a smoothing block; its inverse is far below what a double can tell.
_BLOCK_WEIGHT = 300.0
_SERIES_KEY = "series"


#: Number of a day in its series, from 0.
_RANK = "rank"


def _ranked(daily: DataFrame, keys: Sequence[str], date_col: str, value_col: str) -> DataFrame:
    """``keys``, ``rank`` and ``y``: the values in date order (equal dates by value), missing ones as 0."""
    value = F.coalesce(F.col(value_col).cast("double"), F.lit(0.0)).alias("y")
    in_order = Window.partitionBy(*keys).orderBy("day", "y")
    return daily.select(*keys, F.col(date_col).alias("day"), value).select(*keys, (F.row_number().over(in_order) - 1).alias(_RANK), "y")


def _per_series(days: DataFrame, keys: Sequence[str]):
    """Grouped by series; without keys the one series has a row even when there are no days."""
    return days.groupBy(*keys) if keys else days.groupBy()


def _project(fitted: DataFrame, keys: Sequence[str], horizon: int, point: Column, lower: Column) -> DataFrame:
    """The horizon's rows: ``point`` and ``lower`` may use ``day_offset``, ``point`` and ``spread``."""
    return (
        fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(max(int(horizon), 1)))).alias("day_offset"))
        .withColumn("point", point)
        .select(
            *keys,
            "day_offset",
            rounded(F.col("point"), 2).alias("value"),
            rounded(lower, 2).alias("lower"),
            rounded(F.col("point") + F.col("spread"), 2).alias("upper"),
        )
    )


def _floored() -> Column:
    return F.greatest(F.col("point") - F.col("spread"), F.lit(0.0))


def forecast_linear(
    daily: DataFrame, horizon: int = 30, keys: Sequence[str] = (), date_col: str = "date", value_col: str = "value"
) -> DataFrame:
    """Least-squares line through each series, extended by ``horizon`` days.

    The band is one standard deviation of the residuals. A series with fewer
    than two days continues flat.
    """
    whole = Window.partitionBy(*keys)
    n, x = F.col("n").cast("double"), F.col(_RANK).cast("double")
    days = (
        _ranked(daily, keys, date_col, value_col)
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .withColumn("y_mean", F.sum("y").over(whole) / n)
        .withColumn("slope", F.when(n >= 2, F.sum((x - (n - 1) / 2) * (F.col("y") - F.col("y_mean"))).over(whole) / (n * (n * n - 1) / 12)).otherwise(F.lit(0.0)))
        .withColumn("start", F.col("y_mean") - F.col("slope") * (n - 1) / 2)
    )
    residual = F.col("y") - F.col("start") - F.col("slope") * x
    zero = F.lit(0.0)
    # The fit is the same on all days of a series; the residuals are summed.
    fitted = _per_series(days, keys).agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        *[F.coalesce(F.max(name), zero).alias(name) for name in ("y_mean", "slope", "start")],
        F.coalesce(F.sum(residual * residual), zero).alias("squares"),
    )
    spread = F.when(n >= 2, F.sqrt(F.col("squares") / F.greatest(n - 2, F.lit(1.0)))).otherwise(zero)
    fitted = fitted.withColumn("spread", spread)
    trend = F.greatest(F.col("start") + F.col("slope") * (n + F.col("day_offset") - 1), F.lit(0.0))
    is_line = F.col("n") >= 2
    return _project(
        fitted,
        keys,
        horizon,
        F.when(is_line, trend).otherwise(F.col("y_mean")),
        F.when(is_line, _floored()).otherwise(F.col("point")),
    )


def forecast_exponential(
    daily: DataFrame,
    horizon: int = 30,
    keys: Sequence[str] = (),
    date_col: str = "date",
    value_col: str = "value",
    alpha: float = ALPHA,
) -> DataFrame:
    """Simple exponential smoothing: flat at the last level.

    The band is the mean distance of level and value from the second day on.
    """
    if not 0 <= alpha <= 1:
        raise ValueError("alpha is between 0 and 1")
    zero = F.lit(0.0)
    levels = _levels(_ranked(daily, keys, date_col, value_col), keys, float(alpha))
    error = F.when(F.col(_RANK) > 0, F.abs(F.col("level") - F.col("y")))
    fitted = _per_series(levels, keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.max_by("level", _RANK), zero).alias("level"),
        F.coalesce(F.sum(error), zero).alias("error"),
    )
    fitted = fitted.withColumn("spread", F.when(F.col("n") >= 2, F.col("error") / (F.col("n") - 1)).otherwise(zero))
    return _project(fitted, keys, horizon, F.col("level"), _floored())


def _levels(days: DataFrame, keys: Sequence[str], alpha: float) -> DataFrame:
    """``days`` with the smoothed ``level`` of each: alpha * y + (1 - alpha) * the level before; the first is its value.

    With q = 1 - alpha a level is the sum of alpha * y_i * q^(t - i). It is taken as
    q^t times a running sum of y_i / q^i, in blocks so short that q^-i stays a
    number; a block starts from the last level of the one before, in which what
    came before that block weighs less than any double can tell.
    """
    if alpha == 1:
        return days.withColumn("level", F.col("y"))
    q = 1 - alpha
    length = 2**62 if q == 1 else max(1, int(_BLOCK_WEIGHT / -math.log(q)))
    series, blocks = Window.partitionBy(*keys).orderBy(_RANK), Window.partitionBy(*keys, "block").orderBy(_RANK)
    inside, power = F.col(_RANK) % length, lambda x: F.pow(F.lit(q), x.cast("double"))
    weight = F.when(F.col(_RANK) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    summed = days.withColumn("block", F.floor(F.col(_RANK) / length)).withColumn(
        "own", power(inside) * F.sum(weight * F.col("y") * power(-inside)).over(blocks.rowsBetween(Window.unboundedPreceding, 0))
    )
    # The first day of a block sees the last one of the block before.
    carried = summed.withColumn("last", F.lag("own", 1, 0.0).over(series)).withColumn("before", F.first("last").over(blocks))
    return carried.withColumn("level", F.col("own") + power(inside + 1) * F.col("before"))


def trend_label(first: Column, last: Column) -> Column:
    """Up or Down when the last forecast is more than 2 percent off the first, else Flat."""
    return F.when(last > first * 1.02, "Up").when(last < first * 0.98, "Down").otherwise("Flat")


def with_trend(forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per series: first and last forecast value and the trend between them."""
    grouped = forecast.groupBy(*keys) if keys else forecast.groupBy()
    return grouped.agg(
        F.min_by("value", "day_offset").alias("first_value"), F.max_by("value", "day_offset").alias("last_value")
    ).withColumn("trend", trend_label(F.col("first_value"), F.col("last_value")))


def daily_totals(
    table: DataFrame, metric: str, as_of: DateLike, date_col: str = "date", keys: Sequence[str] = ()
) -> DataFrame:
    """Daily sums of the last 90 days, per series when ``keys`` are given."""
    return (
        table.filter(since(F.col(date_col), as_of, HISTORY_DAYS))
        .groupBy(*keys, F.to_date(F.col(date_col)).alias("date"))
        .agg(F.sum(metric).alias("value"))
    )


def forecast_metric(
    table: DataFrame,
    metric: str,
    as_of: DateLike,
    date_col: str = "date",
    horizon: int = 30,
    method: str = "linear",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Forecast of a metric's daily sum from its last 90 days."""
    fit = forecast_exponential if method == "exponential" else forecast_linear
    return fit(daily_totals(table, metric, as_of, date_col, keys), horizon, keys)


def forecast_growth_kpis(
    spend: DataFrame, events: DataFrame, as_of: DateLike, horizon: int = 30
) -> DataFrame:
    """Daily spend and daily active users: recent average, forecast at the horizon, trend.

    ``current_avg`` divides the last week's total by 7: spend, and *distinct*
    weekly users. ``avg_daily_users`` is the true average of daily users over
    the same days; it is null for spend.
    """
    recent = since(F.col("date"), as_of, 7)
    spend_days = daily_totals(spend, "spend", as_of).select(
        F.lit("Daily Spend").alias(_SERIES_KEY), "date", F.col("value").cast("double").alias("value")
    )
    # Users are deduplicated per day once; the week's distinct users need one more step from there.
    user_days = (
        events.filter(since(F.col("event_date"), as_of, HISTORY_DAYS))
        .select(F.to_date("event_date").alias("date"), "user_id")
        .groupBy("date")
        .agg(F.countDistinct("user_id").cast("double").alias("value"))
        .select(F.lit("Daily Active Users").alias(_SERIES_KEY), "date", "value")
    )
    days = spend_days.unionByName(user_days)
    outlook = with_trend(forecast_linear(days, horizon, [_SERIES_KEY]), [_SERIES_KEY])
    weekly = days.groupBy(_SERIES_KEY).agg(
        sum_if(recent, F.col("value")).alias("recent_total"),
        F.avg(F.when(recent, F.col("value"))).alias("recent_mean"),
    )
    week_users = events.filter(since(F.col("event_date"), as_of, 7)).agg(F.countDistinct("user_id").alias("n"))
    is_users = F.col(_SERIES_KEY) == "Daily Active Users"
    total = F.when(is_users, week_users.scalar().cast("double")).otherwise(F.col("recent_total"))
    return weekly.join(outlook, _SERIES_KEY).select(
        F.col(_SERIES_KEY).alias("kpi"),
        rounded(total / 7, 2).alias("current_avg"),
        F.col("last_value").alias("forecast"),
        "trend",
        rounded(F.when(is_users, F.col("recent_mean")), 2).alias("avg_daily_users"),
    )
