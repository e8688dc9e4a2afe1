"""Spend tables as one, and campaign performance on top of them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tidemark.functions.dates import DateLike, before, since, since_both
from tidemark.functions.numeric import change_pct, percent, ratio, rounded, sum_if

SPEND_COLUMNS = ("channel", "campaign_id", "campaign", "date", "spend", "clicks", "impressions")


def spend_union(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Several spend tables under one another, each row tagged with its table."""
    if not tables:
        raise ValueError("at least one spend table is needed")
    parts = [
        table.select(
            F.lit(name).alias("source_table"),
            *SPEND_COLUMNS,
            F.coalesce(F.col("conversions"), F.lit(0)).alias("conversions"),
        )
        for name, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def campaign_performance(spend: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Every campaign with spend in the current or previous period, with CPC, CTR, CPA and spend change."""
    current, previous = since(F.col("date"), as_of, days), before(F.col("date"), as_of, days)
    # Rows outside both periods add nothing but zeros, so the scan need not read them.
    rollup = (
        spend.filter(since_both(F.col("date"), as_of, days))
        .groupBy("channel", "campaign_id", "campaign")
        .agg(
            *[sum_if(current, F.col(n)).alias(f"current_{n}") for n in ("spend", "clicks", "impressions", "conversions")],
            *[sum_if(previous, F.col(n)).alias(f"previous_{n}") for n in ("spend", "conversions")],
        )
        .filter((F.col("current_spend") > 0) | (F.col("previous_spend") > 0))
    )
    return rollup.select(
        "channel",
        "campaign_id",
        "campaign",
        rounded(F.col("current_spend"), 2).alias("current_spend"),
        "current_clicks",
        "current_impressions",
        rounded(F.col("current_conversions"), 2).alias("current_conversions"),
        rounded(F.col("previous_spend"), 2).alias("previous_spend"),
        rounded(F.col("previous_conversions"), 2).alias("previous_conversions"),
        ratio(F.col("current_spend"), F.col("current_clicks"), 2).alias("current_cpc"),
        percent(F.col("current_clicks"), F.col("current_impressions"), 2).alias("current_ctr"),
        ratio(F.col("current_spend"), F.col("current_conversions"), 2).alias("current_cpa"),
        change_pct(F.col("current_spend"), F.col("previous_spend")).alias("spend_change_pct"),
    )


def _top(frame: DataFrame, limit: int | None, *order) -> DataFrame:
    """Campaigns in order, all or the first ``limit``; ties go by name so that the choice is repeatable."""
    ranked = frame.orderBy(*order, F.asc_nulls_last("channel"), F.asc_nulls_last("campaign"), F.asc_nulls_last("campaign_id"))
    return ranked if limit is None else ranked.limit(int(limit))


def top_campaigns(performance: DataFrame, limit: int | None = None) -> DataFrame:
    """Campaigns by current spend, then conversions."""
    return _top(performance, limit, F.desc("current_spend"), F.desc("current_conversions"))


def campaign_efficiency_leaders(performance: DataFrame, min_spend: float = 50, limit: int | None = None) -> DataFrame:
    """Converting campaigns with enough spend by cost per conversion."""
    eligible = performance.filter((F.col("current_spend") >= min_spend) & (F.col("current_conversions") > 0))
    return _top(eligible, limit, F.asc_nulls_last("current_cpa"), F.desc("current_conversions"))


def campaign_watchlist(performance: DataFrame, min_spend: float = 50, limit: int | None = None) -> DataFrame:
    """Campaigns that spend without converting, or spend over 20 percent more without converting more."""
    no_result = F.col("current_conversions") == 0
    no_gain = (F.col("spend_change_pct") > 20) & (F.col("current_conversions") <= F.col("previous_conversions"))
    risky = performance.filter((F.col("current_spend") >= min_spend) & (no_result | F.coalesce(no_gain, F.lit(False))))
    return _top(risky, limit, F.desc("current_spend"), F.desc("current_conversions"))
