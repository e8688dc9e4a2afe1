"""Spend and events by canonical key, and the bridge between them.

Sums are taken per spelled name first (per name and user where distinct users
are counted), and the spelled names are resolved afterwards: no raw row is
shuffled by a name that many rows share.

All functions work by campaign when the events have ``utm_campaign`` and by
channel otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.dates import DateLike
from tidemark.functions.numeric import percent, ratio, rounded, zero_if_null
from tidemark.operators.mapping.names import DAYS, Names, event_names, event_users, has_campaigns, source_columns, spelled_names, spend_names
from tidemark.operators.mapping.rules import canonicalize


def key_columns(by_campaign: bool) -> list[str]:
    """Columns that identify a canonical key."""
    return ["channel_key", "campaign_key"] if by_campaign else ["channel_key"]


def spend_keys(spelled: DataFrame, rules: DataFrame, by_campaign: bool = True) -> DataFrame:
    """The sums of ``spend_names`` per canonical key; ``channel``, ``campaign`` and ``campaign_id`` show its first spelling."""
    keyed = canonicalize(spelled, rules, "channel", "campaign" if by_campaign else None)
    rollup = keyed.groupBy(*key_columns(by_campaign)).agg(
        F.min("channel").alias("channel"),
        F.min("campaign" if by_campaign else "channel").alias("campaign"),
        (F.min("campaign_id") if by_campaign else F.lit(None).cast("string")).alias("campaign_id"),
        *[F.sum(name).alias(name) for name in ("spend_30d", "clicks_30d", "platform_conversions_30d")],
    )
    return rollup if by_campaign else rollup.withColumn("campaign_key", F.col("channel_key"))


def spend_rollup(
    spend: DataFrame, rules: DataFrame, as_of: DateLike, by_campaign: bool = True, days: int = DAYS, known: DataFrame | None = None
) -> DataFrame:
    """Recent spend, clicks and conversions per key; keys without recent rows stay, with 0.

    ``known`` names all that was ever spent on (see ``names.read_spend_names``);
    with it only the recent days of ``spend`` are scanned.
    """
    return spend_keys(spend_names(spend, as_of, by_campaign, days, known), rules, by_campaign)


def event_keys(users: DataFrame, rules: DataFrame, by_campaign: bool) -> DataFrame:
    """Distinct sign-ups and purchasers and the revenue of the revenue event per key, from ``event_users``."""
    keys = key_columns(by_campaign)
    of_users = canonicalize(users, rules, *source_columns(by_campaign)).groupBy(*keys, "user_id").agg(
        F.max("signed_up").alias("signed_up"), F.max("purchased").alias("purchased"), F.sum("revenue").alias("revenue")
    )
    return of_users.groupBy(*keys).agg(
        F.sum("signed_up").alias("signups_30d"),
        F.sum("purchased").alias("purchasers_30d"),
        F.sum("revenue").alias("revenue_30d"),
    )


def event_rollup(
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    by_campaign: bool | None = None,
    days: int = DAYS,
) -> DataFrame:
    """Distinct sign-ups and purchasers and the revenue of the revenue event per key."""
    by_campaign = has_campaigns(events) if by_campaign is None else by_campaign
    users = event_users(events if by_campaign else events.drop("utm_campaign"), as_of, revenue_event, days)
    return event_keys(users, rules, by_campaign)


def revenue_keys(spelled: DataFrame, rules: DataFrame, by_campaign: bool) -> DataFrame:
    """Revenue per key of all recent events (0 for keys without the revenue event), from ``event_names``."""
    keyed = canonicalize(spelled, rules, *source_columns(by_campaign))
    return keyed.groupBy(*key_columns(by_campaign)).agg(F.sum("revenue").alias("revenue_30d"))


def event_revenue(
    events: DataFrame, rules: DataFrame, as_of: DateLike, revenue_event: str = "purchase", by_campaign: bool = True,
    days: int = DAYS,
) -> DataFrame:
    """Revenue per key of all recent events (0 for keys without the revenue event)."""
    spelled = event_names(events if by_campaign else events.drop("utm_campaign"), as_of, revenue_event, days)
    return revenue_keys(spelled, rules, by_campaign)


def attribution_bridge(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    min_spend: float = 50,
    limit: int | None = None,
) -> DataFrame:
    """Spend keys with the sign-ups, purchasers and revenue that follow from them, best first; all, or the first ``limit``."""
    # Other events only add keys without counts, which the left join treats like missing ones.
    counted = events.filter(F.col("event_type").isin("signup", revenue_event))
    return bridge_of(spelled_names(spend, counted, as_of, revenue_event), rules, min_spend, limit)


def bridge_of(names: Names, rules: DataFrame, min_spend: float = 50, limit: int | None = None) -> DataFrame:
    """``attribution_bridge`` from tables of spelled names."""
    by_campaign = names.by_campaign
    spent = spend_keys(names.spend, rules, by_campaign).filter(F.col("spend_30d") >= max(float(min_spend), 0.0))
    earned = event_keys(names.users, rules, by_campaign)
    revenue, purchasers = zero_if_null(F.col("revenue_30d")), zero_if_null(F.col("purchasers_30d"))
    ranked = (
        spent.join(earned, key_columns(by_campaign), "left")
        .select(
            "channel",
            "campaign_id",
            "campaign",
            rounded(F.col("spend_30d"), 2).alias("spend_30d"),
            "clicks_30d",
            rounded(F.col("platform_conversions_30d"), 2).alias("platform_conversions_30d"),
            zero_if_null(F.col("signups_30d")).alias("signups_30d"),
            purchasers.alias("purchasers_30d"),
            rounded(revenue, 2).alias("attributed_revenue_30d"),
            ratio(revenue, F.col("spend_30d"), 2).alias("attributed_roas"),
            ratio(F.col("spend_30d"), purchasers, 2).alias("cost_per_purchaser"),
        )
        .orderBy(F.desc("attributed_revenue_30d"), F.desc("spend_30d"), F.asc("channel"), F.asc("campaign"))
    )
    return ranked if limit is None else ranked.limit(int(limit))


def attribution_bridge_coverage(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    all_event_types: bool = False,
) -> DataFrame:
    """One row: attributed and total revenue, distinct purchasers and coverage in percent.

    ``all_event_types`` counts the revenue of every event type in the total.
    """
    return bridge_coverage_of(spelled_names(spend, events, as_of, revenue_event), rules, all_event_types)


def bridge_coverage_of(names: Names, rules: DataFrame, all_event_types: bool = False) -> DataFrame:
    """``attribution_bridge_coverage`` from tables of spelled names; one pass over the events by name and user."""
    keys = key_columns(names.by_campaign)
    spent = spend_keys(names.spend, rules, names.by_campaign).select(*keys, F.lit(True).alias("has_spend"))
    keyed = canonicalize(names.users, rules, *source_columns(names.by_campaign)).join(spent, keys, "left")
    of_users = keyed.groupBy("user_id").agg(
        F.max("purchased").alias("purchased"),
        F.sum("all_revenue" if all_event_types else "revenue").alias("revenue"),
        F.sum(F.when(F.col("has_spend"), F.col("revenue"))).alias("attributed"),
    )
    nothing = F.lit(0)
    totals = of_users.agg(
        F.coalesce(F.sum("attributed"), nothing).alias("attributed"),
        F.coalesce(F.sum("revenue"), nothing).alias("total"),
        F.coalesce(F.sum("purchased"), nothing).alias("purchasers"),
    )
    return totals.select(
        rounded(F.col("attributed"), 2).alias("attributed_revenue_30d"),
        rounded(F.col("total"), 2).alias("total_revenue_30d"),
        F.col("purchasers").alias("total_purchasers_30d"),
        percent(F.col("attributed"), F.col("total")).alias("coverage_pct"),
    )
