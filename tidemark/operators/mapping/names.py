"""Spend and events summed by spelled name, the tables that all reports on alias rules start from.

A name is resolved after its rows are summed, so these tables hold what any rule
set needs: spend per name, events per name, and events per name and user where
distinct users are counted. Reports that need them several times write them once
(``Names.kept``), so each raw table is scanned once whatever is asked of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.dates import DateLike, since
from tidemark.functions.numeric import count_if, sum_if
from tidemark.session import snapshot

DAYS = 30
SPEND_NAMES = ("channel", "campaign", "campaign_id")
_SPEND_SUMS = {"spend_30d": "spend", "clicks_30d": "clicks", "platform_conversions_30d": "conversions"}


def has_campaigns(events: DataFrame) -> bool:
    """Whether events carry a campaign name."""
    return "utm_campaign" in events.columns


def source_columns(by_campaign: bool) -> list[str]:
    """Columns that spell an event's name."""
    return ["utm_source", "utm_campaign"] if by_campaign else ["utm_source"]


def spend_names(
    spend: DataFrame, as_of: DateLike, by_campaign: bool = True, days: int = DAYS, known: DataFrame | None = None
) -> DataFrame:
    """Recent spend, clicks, conversions and ``rows`` per spelled name; names without recent rows stay, with 0.

    Without ``known`` that takes a scan of all spend ever. With ``known`` (from
    :func:`read_spend_names`) only the recent days are scanned, and the older
    names come from there.
    """
    names = list(SPEND_NAMES if by_campaign else SPEND_NAMES[:1])
    recent = since(F.col("date"), as_of, days)
    # The id is a key here, so that the pass over the raw rows only sums numbers (a hash aggregate).
    sums = [sum_if(recent, F.col(column)).alias(name) for name, column in _SPEND_SUMS.items()]
    counted = (spend if known is None else spend.filter(recent)).groupBy(*names).agg(*sums, count_if(recent).alias("rows"))
    if known is None:
        return counted
    zeros = [F.lit(0).cast(counted.schema[name].dataType).alias(name) for name in (*_SPEND_SUMS, "rows")]
    every = counted.unionByName(known.select(*names).distinct().select(*names, *zeros))
    return every.groupBy(*names).agg(*[F.sum(name).alias(name) for name in (*_SPEND_SUMS, "rows")])


def add_spend_names(batch: DataFrame, path: str) -> None:
    """Add the spelled names of newly loaded spend rows to those known below ``path``.

    A load appends its own distinct names without reading the earlier ones, so it
    costs no more than the load; names that were known are repeated, and
    :func:`compact_spend_names` drops the repetitions now and then.
    """
    batch.select(*SPEND_NAMES).distinct().write.mode("append").parquet(path)


def read_spend_names(spark: SparkSession, path: str) -> DataFrame:
    """All spelled names that :func:`add_spend_names` has seen, each once."""
    return spark.read.parquet(path).select(*SPEND_NAMES).distinct()


def compact_spend_names(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the known names once each to ``new_path``, for later loads to add to."""
    read_spend_names(spark, path).write.mode("error").parquet(new_path)


def event_users(events: DataFrame, as_of: DateLike, revenue_event: str = "purchase", days: int = DAYS) -> DataFrame:
    """Per spelled name and user of recent events: whether the user signed up and purchased, revenue and ``rows``.

    ``revenue`` is that of the revenue event, ``all_revenue`` that of every event.
    """
    is_revenue, known = F.col("event_type") == revenue_event, F.col("user_id").isNotNull()
    recent = events.filter(since(F.col("event_date"), as_of, days))
    return recent.groupBy(*source_columns(has_campaigns(events)), "user_id").agg(
        F.max(F.when((F.col("event_type") == "signup") & known, 1).otherwise(0)).alias("signed_up"),
        F.max(F.when(is_revenue & known, 1).otherwise(0)).alias("purchased"),
        sum_if(is_revenue, F.col("revenue")).alias("revenue"),
        F.sum("revenue").alias("all_revenue"),
        F.count(F.lit(1)).alias("rows"),
    )


def event_names(events: DataFrame, as_of: DateLike, revenue_event: str = "purchase", days: int = DAYS) -> DataFrame:
    """Revenue of the revenue event and ``rows`` per spelled name of recent events."""
    recent = events.filter(since(F.col("event_date"), as_of, days))
    revenue = sum_if(F.col("event_type") == revenue_event, F.col("revenue"))
    return recent.groupBy(*source_columns(has_campaigns(events))).agg(revenue.alias("revenue"), F.count(F.lit(1)).alias("rows"))


@dataclass(frozen=True)
class Names:
    """The tables of spelled names: ``spend``, ``events`` and ``users`` (events by name and user)."""

    spend: DataFrame
    events: DataFrame
    users: DataFrame
    by_campaign: bool

    def kept(self, users: bool = True) -> Names:
        """The same tables, written once; without ``users`` those stay a plan over the raw events."""
        if not users:
            return replace(self, spend=snapshot(self.spend), events=snapshot(self.events))
        kept = snapshot(self.users)
        events = kept.groupBy(*source_columns(self.by_campaign)).agg(F.sum("revenue").alias("revenue"), F.sum("rows").alias("rows"))
        return replace(self, spend=snapshot(self.spend), users=kept, events=snapshot(events))


def spelled_names(
    spend: DataFrame, events: DataFrame, as_of: DateLike, revenue_event: str = "purchase", known: DataFrame | None = None
) -> Names:
    """The tables of spelled names as plans; ``known`` as in :func:`spend_names`."""
    by_campaign = has_campaigns(events)
    return Names(
        spend_names(spend, as_of, by_campaign, known=known),
        event_names(events, as_of, revenue_event),
        event_users(events, as_of, revenue_event),
        by_campaign,
    )
