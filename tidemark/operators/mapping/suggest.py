"""Suggested alias rules for event names that match no spend, and their risks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.dates import DateLike
from tidemark.functions.numeric import rounded
from tidemark.functions.text import normalize_key, normalize_text, token_overlap, tokens
from tidemark.operators.mapping.coverage import coverage_of
from tidemark.operators.mapping.names import Names, spelled_names
from tidemark.operators.mapping.rules import CAMPAIGN, CHANNEL, RULE_COLUMNS, with_self_aliases
from tidemark.operators.mapping.similar import similar_names
from tidemark.session import snapshot

# Confidence of a channel that is already known, and the least
# similarity at which a channel or a campaign is suggested.
KNOWN_CHANNEL = 0.95
CHANNEL_THRESHOLD = 0.78
CAMPAIGN_THRESHOLD = 0.72

_CHANNEL_REASON = "Source name is close to a paid channel."
_CAMPAIGN_REASON = "Campaign name is close to a paid campaign of the channel."


def _spend_order() -> Column:
    """Largest spend first; names break ties."""
    return F.struct(-F.col("spend_30d"), F.col("channel"), F.col("campaign"))


def _ranking() -> list[Column]:
    """Order in which suggestions are shown and selected."""
    return [
        F.desc("confidence"),
        F.desc("estimated_revenue_30d"),
        F.desc("estimated_spend_30d"),
        F.asc("scope"),
        F.asc("alias"),
        F.asc("channel"),
        F.asc("canonical_value"),
    ]


def _channel_candidates(unmatched: DataFrame, catalog: DataFrame) -> DataFrame:
    """``unmatched`` with ``candidate`` (a spend channel or null), its score and whether it is known."""
    known = (
        catalog.filter(F.col("channel_key") != "")
        .groupBy("channel_key")
        .agg(F.min_by("channel", _spend_order()).alias("known_channel"))
    )
    channels = catalog.groupBy("channel").agg(F.min(_spend_order()).alias("spend_order"))
    scored = similar_names(unmatched.select("utm_source"), channels.select("channel"), CHANNEL_THRESHOLD)
    target = F.struct((-F.col("score")).alias("cost"), F.col("spend_order"), F.col("channel"), F.col("score"))
    best = (
        scored.join(channels, scored["right_name"] == channels["channel"])
        .groupBy(F.col("left_name").alias("utm_source"))
        .agg(F.min(target).alias("best"))
        .select(
            "utm_source", F.col("best.channel").alias("similar_channel"), F.col("best.score").alias("similar_score")
        )
    )
    return (
        unmatched.join(known, "channel_key", "left")
        .join(best, "utm_source", "left")
        .withColumn("is_known", F.col("known_channel").isNotNull())
        .withColumn("candidate", F.coalesce("known_channel", "similar_channel"))
    )


def _campaign_candidates(keys: DataFrame, names: DataFrame, catalog: DataFrame) -> DataFrame:
    """``keys`` with the best spend campaign of each ``(utm_campaign, hint)``; ``names`` holds their campaigns.

    Campaigns of the hinted channel are considered first; all campaigns only
    when the hint names no channel with spend.
    """
    row = F.struct("channel", "campaign", "spend_30d")
    hinted = (
        catalog.select("*", F.explode(F.array_distinct(F.array("channel", "channel_key"))).alias("hint"))
        .groupBy("hint", "campaign")
        .agg(F.min(_spend_order()).alias("spend_order"), F.min_by(row, _spend_order()).alias("target"))
    )
    overall = catalog.groupBy("campaign").agg(
        F.min(_spend_order()).alias("spend_order"), F.min_by(row, _spend_order()).alias("target")
    )
    pairs = similar_names(names, catalog.select("campaign"), CAMPAIGN_THRESHOLD).select(
        F.col("left_name").alias("utm_campaign"), F.col("right_name").alias("campaign"), "score"
    )
    best = F.min(F.struct((-F.col("score")).alias("cost"), F.col("spend_order"), F.col("target"), F.col("score")))
    local = (
        keys.select("utm_campaign", "hint")
        .distinct()
        .join(pairs, "utm_campaign")
        .join(hinted, ["hint", "campaign"])
        .groupBy("utm_campaign", "hint")
        .agg(best.alias("local"))
    )
    anywhere = pairs.join(overall, "campaign").groupBy("utm_campaign").agg(best.alias("anywhere"))
    hints = hinted.select("hint").distinct().withColumn("hint_has_spend", F.lit(True))
    return (
        keys.join(local, ["utm_campaign", "hint"], "left")
        .join(anywhere, "utm_campaign", "left")
        .join(hints, "hint", "left")
        .withColumn("match", F.when(F.col("hint_has_spend"), F.col("local")).otherwise(F.col("anywhere")))
        .filter(F.col("match").isNotNull())
    )


def suggest_mappings(
    unmatched: DataFrame, catalog: DataFrame, rules: DataFrame, limit: int | None = None
) -> DataFrame:
    """Rules that would match the unmatched event names, most confident first.

    ``unmatched`` comes from ``unmatched_event_keys`` and ``catalog`` from
    ``spend_rollup``. Both are used several times; pass snapshots of them so
    that the raw tables are scanned once. A suggestion that an existing rule
    already makes is left out. All unmatched names are scored; ``limit`` only
    cuts the final list.
    """
    with_campaign = "utm_campaign" in unmatched.columns
    keyed = _channel_candidates(unmatched, catalog)
    suggestions = keyed.filter(~F.col("is_known") & F.col("candidate").isNotNull()).select(
        F.lit(CHANNEL).alias("scope"),
        F.col("candidate").alias("canonical_value"),
        F.col("utm_source").alias("alias"),
        F.lit("").alias("channel"),
        rounded(F.col("similar_score"), 2).alias("confidence"),
        F.lit(_CHANNEL_REASON).alias("reason"),
        F.col("revenue_30d").alias("estimated_revenue_30d"),
        F.lit(0.0).alias("estimated_spend_30d"),
        "purchasers_30d",
    )
    if with_campaign:
        hinted = keyed.filter(F.col("utm_campaign") != "").withColumn("hint", F.coalesce("candidate", "channel_key"))
        campaigns = _campaign_candidates(hinted, unmatched.select("utm_campaign"), catalog).select(
            F.lit(CAMPAIGN).alias("scope"),
            F.col("match.target.campaign").alias("canonical_value"),
            F.col("utm_campaign").alias("alias"),
            F.col("match.target.channel").alias("channel"),
            rounded(F.col("match.score"), 2).alias("confidence"),
            F.lit(_CAMPAIGN_REASON).alias("reason"),
            F.col("revenue_30d").alias("estimated_revenue_30d"),
            rounded(F.col("match.target.spend_30d"), 2).alias("estimated_spend_30d"),
            "purchasers_30d",
        )
        suggestions = suggestions.unionByName(campaigns)
    # Of several names that lead to the same rule, the one with most revenue stands for it.
    identity = ["scope", "canonical_value", "channel", "alias_key"]
    order = F.struct(-F.col("estimated_revenue_30d"), -F.col("purchasers_30d"), F.col("alias"))
    kept = [c for c in suggestions.columns if c not in ("scope", "canonical_value", "channel", "purchasers_30d")]
    distinct = (
        suggestions.withColumn("alias_key", normalize_key(F.col("alias")))
        .groupBy(*identity)
        .agg(F.min_by(F.struct(*kept), order).alias("first"))
    )
    existing = rules.select(
        "scope", "canonical_value", "channel", normalize_key(F.col("alias")).alias("alias_key")
    ).distinct()
    result = distinct.join(existing, identity, "left_anti").select(
        "scope",
        "canonical_value",
        F.col("first.alias").alias("alias"),
        "channel",
        *[F.col(f"first.{name}").alias(name) for name in kept if name != "alias"],
    )
    return result if limit is None else result.orderBy(*_ranking()).limit(int(limit))


def select_suggestions(
    suggestions: DataFrame, aliases: Sequence[str] = (), min_confidence: float = 0.8, limit: int | None = None
) -> DataFrame:
    """The suggestions to act on: confident enough, among ``aliases`` when given; all, or the first ``limit``."""
    chosen = suggestions.filter(F.col("confidence") >= max(float(min_confidence), 0.0))
    wanted = sorted({normalize_text(alias) for alias in aliases if alias.strip()})
    if wanted:
        chosen = chosen.filter(normalize_key(F.col("alias")).isin(wanted))
    return chosen if limit is None else chosen.orderBy(*_ranking()).limit(int(limit))


def _conflicts(suggestions: DataFrame, rules: DataFrame) -> DataFrame:
    """``suggestions`` with ``conflict``: the alias is taken by a rule that says something else.

    Per alias only the smallest and largest target matter: any target that
    differs from the suggested one differs from one of these two.
    """
    target = F.struct(F.col("canonical_value").alias("value"), normalize_key(F.col("channel")).alias("channel"))
    by_alias = rules.groupBy("scope", normalize_key(F.col("alias")).alias("alias_key")).agg(
        F.min(target).alias("least"), F.max(target).alias("most")
    )
    by_value = rules.groupBy("scope", normalize_key(F.col("canonical_value")).alias("alias_key")).agg(
        F.min("canonical_value").alias("least_value"), F.max("canonical_value").alias("most_value")
    )
    own, value = target, F.col("canonical_value")
    taken = (F.col("least") != own) | (F.col("most") != own)
    shadowed = (F.col("least_value") != value) | (F.col("most_value") != value)
    no = F.lit(False)
    return (
        suggestions.withColumn("alias_key", normalize_key(F.col("alias")))
        .join(by_alias, ["scope", "alias_key"], "left")
        .join(by_value, ["scope", "alias_key"], "left")
        .withColumn("conflict", F.coalesce(taken, no) | F.coalesce(shadowed, no))
        .select(*suggestions.columns, "conflict")
    )


def assess_mapping_risk(suggestions: DataFrame, rules: DataFrame, coverage: DataFrame) -> DataFrame:
    """Suggestions with ``risk_score``, ``risk_level`` and the ``flags`` behind it.

    ``coverage`` is the one row of ``mapping_coverage`` under the current rules.
    """
    totals = coverage.select(F.struct("total_spend_30d", "total_revenue_30d")).scalar()
    is_campaign = F.col("scope") == CAMPAIGN
    overlap = token_overlap(tokens(F.col("alias")), tokens(F.col("canonical_value")))
    spend, revenue = F.col("estimated_spend_30d"), F.col("estimated_revenue_30d")
    all_spend, all_revenue = F.col("totals.total_spend_30d"), F.col("totals.total_revenue_30d")
    # Risk flags with their weights and limits.
    checks = [
        ("low_confidence_match", 2, F.col("confidence") < 0.85),
        ("weak_token_overlap", 1, is_campaign & (overlap < 0.5)),
        ("missing_channel_scope", 2, is_campaign & (F.col("channel") == "")),
        ("existing_alias_conflict", 3, F.col("conflict")),
        ("no_spend_support", 1, is_campaign & (spend <= 0)),
        ("high_revenue_impact", 1, (all_revenue != 0) & (revenue >= F.greatest(F.lit(500.0), all_revenue * 0.25))),
        ("high_spend_impact", 1, (all_spend != 0) & (spend >= F.greatest(F.lit(250.0), all_spend * 0.25))),
    ]
    score = sum((F.when(hit, weight).otherwise(0) for _, weight, hit in checks), F.lit(0))
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, _, hit in checks]))
    return (
        _conflicts(suggestions, rules)
        .withColumn("totals", totals)
        .withColumn("risk_score", score)
        .withColumn("flags", F.array_join(flags, ", "))
        .withColumn(
            "risk_level", F.when(F.col("risk_score") >= 4, "high").when(F.col("risk_score") >= 2, "medium").otherwise("low")
        )
        .drop("totals", "conflict")
    )


def in_order(selected: DataFrame) -> DataFrame:
    """``selected`` with a ``position`` that ascends with the ranking (with gaps, so that no task sees all rows)."""
    return selected.orderBy(*_ranking()).withColumn("position", F.monotonically_increasing_id())


def with_suggestions(rules: DataFrame, selected: DataFrame) -> DataFrame:
    """``rules`` (complete, ordered) followed by the selected suggestions, nothing written."""
    extra = in_order(selected).select(F.lit("~preview").alias("batch"), "position", *RULE_COLUMNS)
    return rules.unionByName(with_self_aliases(extra))


def preview_mappings(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    selected: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
) -> DataFrame:
    """Coverage now and with the selected suggestions: ``metric, current, preview, delta``.

    Spend and events are summed by name and written once, so each raw table is
    scanned once; both rule sets are applied to the sums.
    """
    return preview_of(spelled_names(spend, events, as_of, revenue_event).kept(users=False), rules, selected)


def preview_of(names: Names, rules: DataFrame, selected: DataFrame) -> DataFrame:
    """``preview_mappings`` from tables of spelled names.

    The previewed rules are written as well: as a table they have a size, by which
    Spark decides how to join them.
    """
    now = coverage_of(names, rules)
    then = coverage_of(names, snapshot(with_suggestions(rules, selected)))
    # Metric labels.
    metrics = {
        "matched_spend_30d": "Mapped spend (30d)",
        "spend_coverage_pct": "Spend coverage",
        "attributed_revenue_30d": "Attributed revenue (30d)",
        "revenue_coverage_pct": "Revenue coverage",
        "matched_keys": "Matched keys",
        "total_keys": "Total keys",
    }
    rows = [
        F.struct(
            F.lit(label).alias("metric"),
            F.col(f"now.{name}").cast("double").alias("current"),
            F.col(name).cast("double").alias("preview"),
            rounded(F.col(name).cast("double") - F.col(f"now.{name}").cast("double"), 2).alias("delta"),
        )
        for name, label in metrics.items()
    ]
    return then.withColumn("now", now.select(F.struct(*metrics)).scalar()).select(F.inline(F.array(*rows)))


def mapping_review_pack(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    suggestions: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    aliases: Sequence[str] = (),
    min_confidence: float = 0.8,
    limit: int | None = None,
) -> dict[str, DataFrame]:
    """Coverage preview, risks and the mix of risk levels of the selected suggestions; each raw table is scanned once."""
    names = spelled_names(spend, events, as_of, revenue_event).kept(users=False)
    selected = snapshot(select_suggestions(suggestions, aliases, min_confidence, limit))
    risks = assess_mapping_risk(selected, rules, coverage_of(names, rules))
    return {
        "coverage_preview": preview_of(names, rules, selected),
        "risk_review": risks,
        "risk_mix": risks.groupBy("risk_level").agg(F.count(F.lit(1)).alias("suggestions")),
        "selected": selected,
    }
