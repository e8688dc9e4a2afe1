"""Alias rules: where they come from and how names are resolved with them.

A rule maps one spelling of a channel or campaign to a canonical value. Rules
are ordered and the first match wins. A campaign rule may be limited to one
channel. A name without a rule falls back to its normalized form.

Resolution is a left join per kind of rule on the normalized name. Each lookup
is unique in its key, so no row is multiplied, and whether it is broadcast or
shuffled is left to Spark, which knows how large the rule set is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.text import normalize_key

CHANNEL, CAMPAIGN = "channel", "campaign"

# Channel spellings every rule set starts with.
BUILTIN_CHANNELS: dict[str, tuple[str, ...]] = {
    "meta_ads": ("meta", "facebook", "facebookads", "facebook_ads", "instagram", "instagramads", "fb"),
    "google_ads": ("google", "googleads", "google_ads", "adwords", "googlecpc"),
    "stripe": ("stripebilling",),
}

RULE_COLUMNS = ("scope", "canonical_value", "alias", "channel")
RULE_SCHEMA = "scope string, canonical_value string, alias string, channel string"
# Rules are ordered by the batch that added them and their position in it.
ORDERED_SCHEMA = f"batch string, position long, {RULE_SCHEMA}"


def user_rules(spark: SparkSession, rows: list[tuple[str, str, str, str]], batch: str = "1") -> DataFrame:
    """Rules given as ``(scope, canonical_value, alias, channel)`` parameters."""
    return spark.createDataFrame([(batch, i, *row) for i, row in enumerate(rows)], ORDERED_SCHEMA)


def read_rules_csv(spark: SparkSession, path: str, batch: str = "1") -> DataFrame:
    """Rules from a CSV file; incomplete rows and unknown scopes are skipped, file order is kept.

    In a folder the files count by name. A file may be read in several parts and
    in any order, so the rows are sorted by file and place before they are numbered.
    """
    raw = spark.read.csv(path, header=True, schema=RULE_SCHEMA)
    place = raw.select(
        *RULE_COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    ordered = place.orderBy("file", "block", "row")
    return clean_rules(ordered.select(F.lit(batch).alias("batch"), F.monotonically_increasing_id().alias("position"), *RULE_COLUMNS))


def clean_rules(rules: DataFrame) -> DataFrame:
    """Trimmed rules without those that lack a scope, canonical value or alias."""
    text = {name: F.trim(F.coalesce(F.col(name), F.lit(""))) for name in RULE_COLUMNS}
    text["scope"] = F.lower(text["scope"])
    cleaned = rules.select("batch", "position", *[value.alias(name) for name, value in text.items()])
    return cleaned.filter(F.col("scope").isin(CHANNEL, CAMPAIGN) & (F.col("canonical_value") != "") & (F.col("alias") != ""))


def all_rules(spark: SparkSession, rules: DataFrame | None = None) -> DataFrame:
    """Built-in rules followed by ``rules``; a canonical value also resolves to itself."""
    builtin = []
    for canonical, aliases in BUILTIN_CHANNELS.items():
        builtin += [("", len(builtin) + i, CHANNEL, canonical, alias, "") for i, alias in enumerate((canonical, *aliases))]
    base = spark.createDataFrame(builtin, ORDERED_SCHEMA)
    if rules is None:
        return base
    return base.unionByName(with_self_aliases(clean_rules(rules)))


def with_self_aliases(rules: DataFrame) -> DataFrame:
    """Each rule, directly followed by one that maps its canonical value to itself."""
    spellings = F.posexplode(F.array("alias", "canonical_value")).alias("step", "alias")
    return rules.select("batch", "position", "scope", "canonical_value", "channel", spellings).select(
        "batch", (F.col("position") * 2 + F.col("step")).alias("position"), *RULE_COLUMNS
    )


def rule_identity() -> list[Column]:
    """Columns under which two rules are the same rule."""
    return [
        F.col("scope").alias("id_scope"),
        normalize_key(F.col("canonical_value")).alias("id_canonical"),
        normalize_key(F.col("alias")).alias("id_alias"),
        normalize_key(F.col("channel")).alias("id_channel"),
    ]


def _lookup(rules: DataFrame, prefix: str, *keys: Column) -> DataFrame:
    """First rule per key: ``<prefix>_value`` and its ``<prefix>_order``."""
    order = F.struct("batch", "position")
    return rules.groupBy(*keys).agg(
        F.min_by("canonical_value", order).alias(f"{prefix}_value"), F.min(order).alias(f"{prefix}_order")
    )


def canonicalize(
    df: DataFrame, rules: DataFrame, channel_col: str, campaign_col: str | None = None
) -> DataFrame:
    """``df`` with ``channel_key`` and, for a campaign column, ``campaign_key``.

    A rule's canonical value is taken as written; only the fallback is
    normalized. A campaign rule's channel is compared with the row's own
    channel name, before channel rules apply.
    """
    alias, scope_channel = normalize_key(F.col("alias")), normalize_key(F.col("channel"))
    of_channels = rules.filter(F.col("scope") == CHANNEL)
    by_channel = _lookup(of_channels, "_c", alias.alias("_channel_name"))
    named = df.withColumn("_channel_name", normalize_key(F.col(channel_col)))
    result = named.join(by_channel, "_channel_name", "left").withColumn(
        "channel_key", F.coalesce("_c_value", "_channel_name")
    )
    added = ["channel_key"]
    if campaign_col is not None:
        of_campaigns = rules.filter(F.col("scope") == CAMPAIGN)
        scoped = _lookup(
            of_campaigns.filter(scope_channel != ""),
            "_s",
            scope_channel.alias("_channel_name"),
            alias.alias("_campaign_name"),
        )
        general = _lookup(of_campaigns.filter(scope_channel == ""), "_g", alias.alias("_campaign_name"))
        scoped_first = F.col("_g_order").isNull() | (F.col("_s_order") < F.col("_g_order"))
        result = (
            result.withColumn("_campaign_name", normalize_key(F.col(campaign_col)))
            .join(scoped, ["_channel_name", "_campaign_name"], "left")
            .join(general, "_campaign_name", "left")
            .withColumn(
                "campaign_key",
                F.when(F.col("_s_order").isNotNull() & scoped_first, F.col("_s_value"))
                .otherwise(F.coalesce("_g_value", "_campaign_name")),
            )
        )
        added.append("campaign_key")
    return result.select(*df.columns, *added)
