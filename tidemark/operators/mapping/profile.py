"""The state of a mapping review as a set of small tables that outlive the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.dates import DateLike
from tidemark.operators.mapping.coverage import applied_rules_of, coverage_of, unmatched_events_of, unmatched_spend_of
from tidemark.operators.mapping.names import spelled_names
from tidemark.operators.mapping.rollups import spend_keys
from tidemark.operators.mapping.suggest import suggest_mappings
from tidemark.session import scratch_dir, snapshot

PARTS = ("coverage", "unmatched_events", "unmatched_spend", "applied_rules", "spend_keys", "suggestions")


def build_profile(
    spend: DataFrame,
    events: DataFrame,
    rules: DataFrame,
    as_of: DateLike,
    revenue_event: str = "purchase",
    limit: int | None = None,
    path: str | None = None,
) -> dict[str, DataFrame]:
    """Write coverage, unmatched keys, rules in use and suggestions below ``path`` and return them.

    Each raw table is scanned once for this, and no more: all parts start from
    written tables of spelled names, and review, preview and apply from the
    written parts, in this session or another one.
    """
    path = path or scratch_dir(spend.sparkSession)
    names = spelled_names(spend, events, as_of, revenue_event).kept()

    def keep(name: str, frame: DataFrame) -> DataFrame:
        return snapshot(frame, f"{path}/{name}")

    profile = {
        "coverage": keep("coverage", coverage_of(names, rules)),
        "unmatched_events": keep("unmatched_events", unmatched_events_of(names, rules)),
        "unmatched_spend": keep("unmatched_spend", unmatched_spend_of(names, rules)),
        "applied_rules": keep("applied_rules", applied_rules_of(names, rules)),
        "spend_keys": keep("spend_keys", spend_keys(names.spend, rules, names.by_campaign)),
    }
    found = suggest_mappings(profile["unmatched_events"], profile["spend_keys"], rules, limit)
    profile["suggestions"] = keep("suggestions", found)
    return profile


def read_profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts that :func:`build_profile` wrote."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in PARTS}
