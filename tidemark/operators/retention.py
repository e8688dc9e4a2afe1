"""Cohort retention by week or month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.numeric import mean, percent, rounded
from tidemark.functions.thresholds import DEFAULT_RETENTION, RETENTION, classify_metric

PERIODS = ("week", "month")


def _check(period: str) -> str:
    period = period.strip().lower()
    if period not in PERIODS:
        raise ValueError("period must be 'week' or 'month'")
    return period


def _distance(period: str, start: Column, end: Column) -> Column:
    """Whole periods between two period starts."""
    if period == "week":
        return F.floor(F.date_diff(end, start) / 7).cast("int")
    return (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)


def cohort_retention(events: DataFrame, period: str = "month") -> DataFrame:
    """``cohort, cohort_size, period_number, active_users, retention_pct``.

    A user's events shrink to the periods they were active in before anything
    is shuffled (a hash aggregate of fixed-width rows), so the distinct count
    per cohort is a plain count and the cohort comes without a join. Weeks
    start on Monday.
    """
    period = _check(period)
    start = F.trunc(F.col("event_date"), period)
    users = (
        events.filter(F.col("user_id").isNotNull() & F.col("event_date").isNotNull())
        .select("user_id", start.alias("active_in"))
        .distinct()
        .groupBy("user_id")
        .agg(F.collect_list("active_in").alias("periods"))
    )
    cells = (
        users.select(F.array_min("periods").alias("cohort"), F.explode("periods").alias("active_in"))
        .withColumn("period_number", _distance(period, F.col("cohort"), F.col("active_in")))
        .groupBy("cohort", "period_number")
        .agg(F.count(F.lit(1)).alias("active_users"))
    )
    # Every user is active in period 0, so that cell holds the cohort's size.
    size = F.max(F.when(F.col("period_number") == 0, F.col("active_users"))).over(Window.partitionBy("cohort"))
    return cells.select(
        "cohort",
        size.alias("cohort_size"),
        "period_number",
        "active_users",
        percent(F.col("active_users"), size).alias("retention_pct"),
    )


def retention_benchmark_verdict(retention: DataFrame, period: str = "month") -> DataFrame:
    """Average period-1 retention of a cohort table against the threshold."""
    good, ok = RETENTION.get(_check(period), (DEFAULT_RETENTION, DEFAULT_RETENTION))
    average = mean(F.when(F.col("period_number") == 1, F.col("retention_pct")))
    return (
        retention.agg(average.alias("average"))
        .select(
            F.lit(period).alias("period"),
            rounded(F.col("average"), 1).alias("avg_retention_pct"),
            F.lit(good).alias("benchmark_pct"),
            (F.col("average") > good).alias("above_benchmark"),
            classify_metric(F.col("average"), F.lit(good), F.lit(ok)).alias("verdict"),
        )
        .filter(F.col("avg_retention_pct").isNotNull())
    )
