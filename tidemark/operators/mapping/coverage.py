"""How much of spend and revenue the current rules bring together, and what they miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike
from tidemark.functions.numeric import count_if, percent, rounded
from tidemark.functions.text import normalize_key
from tidemark.operators.mapping.names import Names, source_columns, spelled_names
from tidemark.operators.mapping.rollups import key_columns, revenue_keys, spend_keys
from tidemark.operators.mapping.rules import CAMPAIGN, CHANNEL, canonicalize


def mapping_coverage(
    spend: DataFrame, events: DataFrame, rules: DataFrame, as_of: DateLike, revenue_event: str = "purchase"
) -> DataFrame:
    """One row: total and matched spend, keys and revenue of the last 30 days, with percentages.

    A full join of the two key tables holds the totals as well, so neither
    table is scanned a second time for them.
    """
    return coverage_of(spelled_names(spend, events, as_of, revenue_event), rules)


def coverage_of(names: Names, rules: DataFrame) -> DataFrame:
    """``mapping_coverage`` from tables of spelled names."""
    keys = key_columns(names.by_campaign)
    spent = spend_keys(names.spend, rules, names.by_campaign).select(*keys, "spend_30d", F.lit(True).alias("has_spend"))
    earned = revenue_keys(names.events, rules, names.by_campaign).withColumn("has_events", F.lit(True))
    has_spend, matched = F.col("has_spend").isNotNull(), F.col("has_spend") & F.col("has_events")

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))

    sums = spent.join(earned, keys, "full").agg(
        total(F.col("spend_30d")).alias("spend"),
        total(F.when(matched, F.col("spend_30d"))).alias("matched_spend"),
        count_if(has_spend).alias("total_keys"),
        count_if(matched).alias("matched_keys"),
        total(F.when(has_spend, F.col("revenue_30d"))).alias("attributed"),
        total(F.col("revenue_30d")).alias("revenue"),
    )
    return sums.select(
        rounded(F.col("spend"), 2).alias("total_spend_30d"),
        rounded(F.col("matched_spend"), 2).alias("matched_spend_30d"),
        "total_keys",
        "matched_keys",
        rounded(F.col("attributed"), 2).alias("attributed_revenue_30d"),
        rounded(F.col("revenue"), 2).alias("total_revenue_30d"),
        percent(F.col("matched_spend"), F.col("spend")).alias("spend_coverage_pct"),
        percent(F.col("attributed"), F.col("revenue")).alias("revenue_coverage_pct"),
    )


def _top(frame: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return frame if limit is None else frame.orderBy(*order).limit(int(limit))


def unmatched_event_keys(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    limit: int | None = None,
) -> DataFrame:
    """Spelled event names with revenue whose key has no spend; the ``limit`` largest, or all."""
    # Only the revenue event can lift a name above zero revenue.
    names = spelled_names(spend, events.filter(F.col("event_type") == revenue_event), as_of, revenue_event)
    return unmatched_events_of(names, rules, limit)


def unmatched_events_of(names: Names, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """``unmatched_event_keys`` from tables of spelled names."""
    sources, keys = source_columns(names.by_campaign), key_columns(names.by_campaign)
    spelled = (
        names.users.groupBy(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in sources], "user_id")
        .agg(F.sum("revenue").alias("revenue"), F.max("purchased").alias("purchased"))
        .groupBy(*sources)
        .agg(F.sum("purchased").cast("long").alias("purchasers_30d"), F.sum("revenue").alias("revenue"))
        .filter(F.col("revenue") > 0)
    )
    known = spend_keys(names.spend, rules, names.by_campaign).select(*keys)
    missing = canonicalize(spelled, rules, *sources).join(known, keys, "left_anti")
    result = missing.select(*sources, *keys, "purchasers_30d", rounded(F.col("revenue"), 2).alias("revenue_30d"))
    return _top(result, limit, F.desc("revenue_30d"), F.desc("purchasers_30d"), *[F.asc(name) for name in sources])


def unmatched_spend_keys(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    limit: int | None = None,
) -> DataFrame:
    """Spend keys without any recent event; the ``limit`` largest, or all."""
    return unmatched_spend_of(spelled_names(spend, events, as_of, revenue_event), rules, limit)


def unmatched_spend_of(names: Names, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """``unmatched_spend_keys`` from tables of spelled names."""
    keys = key_columns(names.by_campaign)
    seen = revenue_keys(names.events, rules, names.by_campaign).select(*keys)
    missing = spend_keys(names.spend, rules, names.by_campaign).join(seen, keys, "left_anti")
    result = missing.select("channel", "campaign", rounded(F.col("spend_30d"), 2).alias("spend_30d"))
    return _top(result, limit, F.desc("spend_30d"), F.asc("channel"), F.asc("campaign"))


def _counted(spelled: DataFrame, channel_col: str, campaign_col: str | None) -> DataFrame:
    """Recent rows per normalized name with their first spellings, from rows that are counted per spelling."""
    campaign = F.col(campaign_col) if campaign_col else F.lit(None).cast("string")
    return (
        spelled.filter("rows > 0")
        .groupBy(normalize_key(F.col(channel_col)).alias("channel_name"), normalize_key(campaign).alias("campaign_name"))
        .agg(F.sum("rows").alias("rows"), F.min(channel_col).alias("channel_sample"), F.min(campaign).alias("campaign_sample"))
    )


def _hits(names: DataFrame, distinct_rules: DataFrame, prefix: str) -> DataFrame:
    """Rows and a sample spelling per rule, from names that are already counted; each name stands for both scopes."""
    sides = [
        F.struct(F.lit(scope).alias("scope"), F.col(f"{scope}_name").alias("alias_name"), F.col(f"{scope}_sample").alias("sample"))
        for scope in (CHANNEL, CAMPAIGN)
    ]
    seen = names.select("rows", F.col("channel_name").alias("own_channel"), F.inline(F.array(*sides)))
    in_scope = (F.col("scope") == CHANNEL) | (F.col("rule_channel") == "") | (F.col("rule_channel") == F.col("own_channel"))
    matched = distinct_rules.join(seen, ["scope", "alias_name"]).filter(in_scope)
    return matched.groupBy("rule_key").agg(
        F.sum("rows").alias(f"{prefix}_rows"), F.min("sample").alias(f"{prefix}_sample")
    )


def applied_alias_rules(
    spend: DataFrame, events: DataFrame, rules: DataFrame, as_of: DateLike, limit: int | None = None
) -> DataFrame:
    """Rules that matched recent rows, with hit counts and a spelling from each side.

    Rules that only restate their canonical value are left out. Each table is
    scanned once, for all rules together; its rows are counted per spelling first.
    """
    return applied_rules_of(spelled_names(spend, events, as_of), rules, limit)


def applied_rules_of(names: Names, rules: DataFrame, limit: int | None = None) -> DataFrame:
    """``applied_alias_rules`` from tables of spelled names."""
    with_campaign = names.by_campaign
    alias, canonical = normalize_key(F.col("alias")), normalize_key(F.col("canonical_value"))
    order = F.struct("batch", "position")
    usable = rules.filter(alias != canonical)
    if not with_campaign:
        usable = usable.filter(F.col("scope") == CHANNEL)
    distinct_rules = (
        usable.groupBy("scope", "canonical_value", "channel", alias.alias("alias_name"))
        .agg(F.min_by("alias", order).alias("alias"))
        .withColumn("rule_channel", normalize_key(F.col("channel")))
        .withColumn("rule_key", F.struct("scope", "canonical_value", "channel", "alias_name"))
    )
    spent = _hits(_counted(names.spend, "channel", "campaign" if with_campaign else None), distinct_rules, "spend")
    seen = _hits(_counted(names.events, "utm_source", "utm_campaign" if with_campaign else None), distinct_rules, "event")
    hits = spent.join(seen, "rule_key", "full").select(
        "rule_key",
        F.coalesce("spend_rows", F.lit(0)).alias("spend_rows"),
        F.coalesce("event_rows", F.lit(0)).alias("event_rows"),
        F.coalesce("spend_sample", F.lit("")).alias("spend_sample"),
        F.coalesce("event_sample", F.lit("")).alias("event_sample"),
    )
    result = distinct_rules.join(hits, "rule_key").select(
        "scope", "alias", "canonical_value", "channel", "spend_rows", "event_rows", "spend_sample", "event_sample"
    )
    return _top(
        result, limit, F.desc(F.col("spend_rows") + F.col("event_rows")), F.asc("scope"), F.asc("alias"), F.asc("channel")
    )


def mapping_diagnostics(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Coverage, unmatched names of both sides and the rules in use.

    The tables of spelled names are written once (see ``Names.kept``), so each raw
    table is scanned once for all four.
    """
    names = spelled_names(spend, events, as_of, revenue_event).kept()
    return {
        "coverage": coverage_of(names, rules),
        "unmatched_events": unmatched_events_of(names, rules, limit),
        "unmatched_spend": unmatched_spend_of(names, rules, limit),
        "applied_rules": applied_rules_of(names, rules, limit),
    }
