"""Churn by inactivity, by cancellation and by an explicit churn event.

Each mode is one aggregation per user and one over the users. The segments are
counted as columns of a single row, so the shares need no second pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike, days_before
from tidemark.functions.numeric import count_if, percent, rounded

ACTIVE, AT_RISK, CHURNED, RECENT = "Active", "At Risk", "Churned", "Recently Cancelled"


def _segments(users: DataFrame, names: list[str], averages: dict[str, Column] | None = None) -> DataFrame:
    """Users, share and averages per segment; segments without users are left out."""
    averages = averages or {}
    measures = []
    for i, name in enumerate(names):
        inside = F.col("segment") == name
        measures.append(count_if(inside).alias(f"n{i}"))
        for label, value in averages.items():
            measures.append(F.avg(F.when(inside, value)).alias(f"{label}{i}"))
    total = sum((F.col(f"n{i}") for i in range(len(names))), F.lit(0))
    rows = [
        F.struct(
            F.lit(name).alias("segment"),
            F.col(f"n{i}").alias("users"),
            percent(F.col(f"n{i}"), total).alias("pct"),
            *[rounded(F.col(f"{label}{i}"), 0).alias(label) for label in averages],
        )
        for i, name in enumerate(names)
    ]
    return users.agg(*measures).select(F.inline(F.array(*rows))).filter("users > 0")


def churn_inactivity(events: DataFrame, as_of: DateLike, inactive_days: int = 30) -> DataFrame:
    """Active up to a third of ``inactive_days``, At Risk up to all of it, else Churned."""
    inactive_days = max(int(inactive_days), 1)
    days = F.col("avg_days_inactive")
    users = (
        events.groupBy("user_id")
        .agg(F.max("event_date").alias("last_seen"), F.count(F.lit(1)).alias("avg_events"))
        .withColumn("avg_days_inactive", days_before(as_of, F.col("last_seen")))
        .withColumn(
            "segment",
            F.when(days <= max(inactive_days // 3, 1), ACTIVE).when(days <= inactive_days, AT_RISK).otherwise(CHURNED),
        )
    )
    return _segments(
        users, [ACTIVE, AT_RISK, CHURNED], {"avg_events": F.col("avg_events"), "avg_days_inactive": days}
    )


def churn_subscription(
    events: DataFrame, as_of: DateLike, cancelled_event: str = "cancel", recent_days: int = 30
) -> DataFrame:
    """Active without a cancellation, Recently Cancelled up to ``recent_days`` ago, else Churned."""
    cancelled = F.col("cancelled_at")
    users = (
        events.groupBy("user_id")
        .agg(F.max(F.when(F.col("event_type") == cancelled_event.strip(), F.col("event_date"))).alias("cancelled_at"))
        # Events without a user never match a cancellation, so that group stays active.
        .withColumn("cancelled_at", F.when(F.col("user_id").isNotNull(), cancelled))
        .select(
            F.when(cancelled.isNull(), ACTIVE)
            .when(days_before(as_of, cancelled) <= recent_days, RECENT)
            .otherwise(CHURNED)
            .alias("segment")
        )
    )
    return _segments(users, [ACTIVE, RECENT, CHURNED])


def churn_event_based(events: DataFrame, churn_event: str = "churn") -> DataFrame:
    """Churned with at least one ``churn_event``, else Active; with the average lifetime."""
    users = (
        events.groupBy("user_id")
        .agg(
            F.max(F.col("event_type") == churn_event.strip()).alias("left"),
            F.date_diff(F.max("event_date"), F.min("event_date")).alias("avg_lifetime_days"),
        )
        .withColumn("segment", F.when(F.col("left") & F.col("user_id").isNotNull(), CHURNED).otherwise(ACTIVE))
    )
    return _segments(users, [ACTIVE, CHURNED], {"avg_lifetime_days": F.col("avg_lifetime_days")})


def analyze_churn(events: DataFrame, as_of: DateLike, inactive_days: int = 30) -> DataFrame:
    """Inactivity segments with a headline for the groups that need attention."""
    segments = churn_inactivity(events, as_of, inactive_days)
    amount = F.format_string("%s users (%.1f%%)", F.format_number("users", 0), F.col("pct"))
    return segments.withColumn(
        "headline",
        F.when(F.col("segment") == CHURNED, F.concat(amount, F.lit(" churned")))
        .when(F.col("segment") == AT_RISK, F.concat(amount, F.lit(" at risk")))
        .otherwise(F.lit("")),
    )
