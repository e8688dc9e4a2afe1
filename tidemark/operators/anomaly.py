"""Daily anomalies and drift between two adjacent periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike, before, since, since_both, to_date
from tidemark.functions.numeric import count_if, mean, rounded

SPIKE, DROP, ELEVATED, BELOW, NORMAL = "Spike", "Drop", "Elevated", "Below Normal", "Normal"


def detect_anomalies(
    table: DataFrame, metric: str, as_of: DateLike, date_col: str = "date", lookback_days: int = 30
) -> DataFrame:
    """Days of the lookback whose total lies more than 1.5 deviations off the mean.

    ``z_score`` is rounded before it meets the thresholds.
    """
    lookback_days = max(int(lookback_days), 1)
    day = F.to_date(F.col(date_col))
    daily = (
        table.filter(since(F.col(date_col), as_of, lookback_days))
        .groupBy(day.alias("date"))
        .agg(F.sum(metric).alias("daily_value"))
    )
    # The whole pass is one row per day; mean and deviation come from the same exchange.
    stats = daily.agg(
        F.struct(
            mean(F.col("daily_value")).alias("mean"),
            F.stddev_samp("daily_value").alias("deviation"),
        )
    )
    z = F.col("z_score")
    return (
        daily.withColumn("stats", stats.scalar())
        .select(
            "date",
            "daily_value",
            rounded(F.col("stats.mean"), 2).alias("avg_value"),
            F.when(
                F.col("stats.deviation") > 0,
                rounded((F.col("daily_value").cast("double") - F.col("stats.mean")) / F.col("stats.deviation"), 2),
            )
            .otherwise(F.lit(0.0))
            .alias("z_score"),
        )
        .filter(F.abs(z) > 1.5)
        .withColumn(
            "status",
            F.when(z > 2, SPIKE).when(z < -2, DROP).when(z > 1.5, ELEVATED).when(z < -1.5, BELOW).otherwise(NORMAL),
        )
    )


def anomaly_explanation(anomalies: DataFrame) -> DataFrame:
    """How many spikes and drops there are, each with the causes to look into first."""
    causes = F.when(
        F.col("status") == SPIKE, "Campaign launches, promotions or bot traffic on these dates."
    ).otherwise("Tracking outages, product defects or seasonality on these dates.")
    return (
        anomalies.filter(F.col("status").isin(SPIKE, DROP))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
        .withColumn("hypothesis", causes)
    )


def _drift(table: DataFrame, metric: str, as_of: DateLike, date_col: str, lookback_days: int) -> DataFrame:
    """One row with the measures of both periods and their changes, from one scan."""
    current = since(F.col(date_col), as_of, lookback_days)
    previous = before(F.col(date_col), as_of, lookback_days)
    value = F.col(metric)
    measures = []
    for name, inside in (("current", current), ("previous", previous)):
        measures += [
            rounded(mean(F.when(inside, value)), 4).alias(f"{name}_avg"),
            rounded(F.sum(F.when(inside, value)), 4).alias(f"{name}_total"),
            count_if(inside).alias(f"{name}_rows"),
        ]

    def change(kind: str) -> Column:
        now = F.coalesce(F.col(f"current_{kind}"), F.lit(0.0))
        then = F.coalesce(F.col(f"previous_{kind}"), F.lit(0.0))
        return F.when(then != 0, (now - then) / then * 100)

    return (
        table.filter(since_both(F.col(date_col), as_of, lookback_days))
        .agg(*measures)
        .withColumn("avg_change", change("avg"))
        .withColumn("total_change", change("total"))
    )


def detect_data_drift(
    table: DataFrame, metric: str, as_of: DateLike, date_col: str = "date", lookback_days: int = 7
) -> DataFrame:
    """Current and previous period of equal length: average, total, rows and the changes.

    ``needs_review`` is set when the total moved by more than 20 percent.
    """
    rows = [
        F.struct(
            F.lit(name).alias("period"),
            F.col(f"{name}_avg").alias("avg_val"),
            F.col(f"{name}_total").alias("total_val"),
            F.col(f"{name}_rows").alias("n_rows"),
            rounded(F.col("avg_change"), 1).alias("avg_change_pct"),
            rounded(F.col("total_change"), 1).alias("total_change_pct"),
            F.coalesce(F.abs(F.col("total_change")) > 20, F.lit(False)).alias("needs_review"),
        )
        for name in ("current", "previous")
    ]
    return _drift(table, metric, as_of, date_col, max(int(lookback_days), 1)).select(F.inline(F.array(*rows)))


def drift_alert(
    table: DataFrame,
    metric: str,
    as_of: DateLike,
    date_col: str = "date",
    lookback_days: int = 7,
    threshold_pct: float = 20.0,
) -> DataFrame:
    """One alert row when the average moved by at least ``threshold_pct``, else none.

    The rows are meant for an append-only alerts table.
    """
    lookback_days = max(int(lookback_days), 1)
    change = F.col("avg_change")
    return (
        _drift(table, metric, as_of, date_col, lookback_days)
        .filter(F.abs(change) >= threshold_pct)
        .select(
            F.lit(metric).alias("metric"),
            F.lit(to_date(as_of)).alias("as_of"),
            F.lit(lookback_days).alias("lookback_days"),
            "current_avg",
            "previous_avg",
            rounded(change, 2).alias("change_pct"),
            F.when(change > 0, "up").otherwise("down").alias("direction"),
        )
    )
