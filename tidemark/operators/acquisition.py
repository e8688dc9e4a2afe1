"""Cost and value of acquired users per channel.

Users are first reduced to one row per (user, channel). That one shuffle gives
distinct counts and per-user sums together, and map-side combining keeps a
channel with a large share of all events from reaching one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.numeric import count_if, mean, ratio, rounded, zero_if_null
from tidemark.functions.thresholds import LTV_CAC, channel_threshold, classify_metric

def _user_channels(events: DataFrame) -> DataFrame:
    """Sign-up, revenue and lifetime of each user within each source."""
    return events.groupBy("user_id", F.col("utm_source").alias("channel")).agg(
        F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("signed_up"),
        F.sum("revenue").alias("revenue"),
        F.date_diff(F.max("event_date"), F.min("event_date")).alias("lifetime_days"),
    )


def _acquired() -> Column:
    return count_if((F.col("signed_up") == 1) & F.col("user_id").isNotNull()).alias("users_acquired")


def _lifetime_value() -> list[Column]:
    return [
        F.count("user_id").alias("users"),
        rounded(mean(F.col("revenue")), 2).alias("avg_ltv"),
        rounded(F.sum("revenue"), 2).alias("total_revenue"),
        rounded(F.avg("lifetime_days"), 0).alias("avg_lifetime_days"),
    ]


def _channel_spend(spend: DataFrame, channel_col: str) -> DataFrame:
    return spend.groupBy(F.col(channel_col).alias("channel")).agg(F.sum("spend").alias("total_spend"))


def cac_by_channel(spend: DataFrame, events: DataFrame, channel_col: str = "channel") -> DataFrame:
    """Spend per channel over its distinct sign-up users; channels without spend are left out."""
    signups = (
        events.filter(F.col("event_type") == "signup")
        .groupBy(F.col("utm_source").alias("channel"))
        .agg(F.countDistinct("user_id").alias("users_acquired"))
    )
    users = zero_if_null(F.col("users_acquired"))
    return (
        _channel_spend(spend, channel_col)
        .join(signups, "channel", "left")
        .select(
            "channel", "total_spend", users.alias("users_acquired"), ratio(F.col("total_spend"), users, 2).alias("cac")
        )
    )


def ltv_by_channel(events: DataFrame) -> DataFrame:
    """Observed revenue per user and channel; a user with two sources counts in both."""
    return _user_channels(events).groupBy("channel").agg(*_lifetime_value())


def compute_cac_ltv(spend: DataFrame, events: DataFrame, channel_col: str = "channel") -> DataFrame:
    """CAC and LTV per channel from one pass over the events; ``roas`` is LTV over CAC."""
    value = _user_channels(events).groupBy("channel").agg(_acquired(), *_lifetime_value())
    users = zero_if_null(F.col("users_acquired"))
    return (
        _channel_spend(spend, channel_col)
        .join(value, "channel", "left")
        .select(
            "channel",
            "total_spend",
            users.alias("users_acquired"),
            ratio(F.col("total_spend"), users, 2).alias("cac"),
            "avg_ltv",
        )
        .withColumn("roas", ratio(F.col("avg_ltv"), F.col("cac"), 2))
    )


def best_channels(cac_ltv: DataFrame) -> DataFrame:
    """One row: the channel with the lowest CAC and the one with the highest LTV:CAC."""
    by_cac = F.when(F.col("cac").isNotNull(), F.struct("cac", "channel"))
    # Negated so that equal ratios also go to the first channel name.
    by_roas = F.when(F.col("roas").isNotNull(), F.struct(-F.col("roas"), F.col("channel")))
    return cac_ltv.agg(F.min(by_cac).alias("low"), F.min_by(F.struct("channel", "roas"), by_roas).alias("high")).select(
        F.col("low.channel").alias("best_cac_channel"),
        F.col("low.cac").alias("best_cac"),
        F.col("high.channel").alias("best_roas_channel"),
        F.col("high.roas").alias("best_roas"),
    )


def channel_efficiency_review(spend: DataFrame, events: DataFrame, channel_col: str = "channel") -> DataFrame:
    """CAC, LTV and their ratio with a signal: Invest, Watch or Cut.

    The ratio is judged by the LTV:CAC thresholds. ``cac_verdict`` judges the
    CAC itself, lower being better, where the channel has a threshold.
    """
    good, ok = (F.lit(limit) for limit in LTV_CAC)
    verdict = classify_metric(F.col("roas"), good, ok)
    return (
        compute_cac_ltv(spend, events, channel_col)
        .withColumn("threshold", channel_threshold(F.col("channel")))
        .withColumn(
            "signal",
            F.when(verdict == "Good", "Invest").when(verdict == "Average", "Watch").when(verdict == "Poor", "Cut"),
        )
        .withColumn(
            "cac_verdict",
            F.when(
                F.col("threshold").isNotNull(),
                classify_metric(F.col("cac"), F.col("threshold.good"), F.col("threshold.ok"), higher_is_better=False),
            ),
        )
        .drop("threshold")
    )
