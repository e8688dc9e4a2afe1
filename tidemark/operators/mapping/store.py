"""Approved rules as an append-only history table.

Every change is a row: ``apply`` or ``rollback`` of one rule. The active rules
are those whose latest row is an ``apply``. Nothing is ever rewritten, so a
failed write leaves the earlier rules as they were, and the history is the
audit log at the same time.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.functions.text import normalize_key, normalize_text
from tidemark.operators.mapping.rules import RULE_COLUMNS, RULE_SCHEMA, rule_identity
from tidemark.operators.mapping.suggest import assess_mapping_risk, in_order, select_suggestions
from tidemark.session import snapshot

APPLY, ROLLBACK = "apply", "rollback"
HISTORY_SCHEMA = f"changed_at string, action string, position long, {RULE_SCHEMA}"
_IDENTITY = ["id_scope", "id_canonical", "id_alias", "id_channel"]


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All recorded changes; empty when nothing was recorded yet."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def _instant() -> Column:
    """The moment of a change, whatever offset its text is written with."""
    return F.try_to_timestamp("changed_at")


def active_rules(history: DataFrame) -> DataFrame:
    """Rules in force, ordered by when they were applied: ``batch`` is the moment in UTC, as text that sorts by time."""
    batch = F.date_format(F.to_utc_timestamp(_instant(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    latest = history.groupBy(*rule_identity()).agg(
        F.max_by(
            F.struct("action", batch.alias("batch"), "position", *RULE_COLUMNS), F.struct(_instant(), "position")
        ).alias("last")
    )
    return latest.filter(F.col("last.action") == APPLY).select(
        F.col("last.batch").alias("batch"),
        F.col("last.position").alias("position"),
        *[F.col(f"last.{name}").alias(name) for name in RULE_COLUMNS],
    )


def plan_apply(
    suggestions: DataFrame,
    active: DataFrame,
    rules: DataFrame,
    coverage: DataFrame,
    aliases: Sequence[str] = (),
    min_confidence: float = 0.8,
    limit: int | None = None,
    force: bool = False,
) -> DataFrame:
    """What an apply would do with each selected suggestion, in ``status``.

    ``applied`` and ``skipped`` (already active, or twice in the selection);
    one high risk among them makes all of them ``blocked`` unless ``force``.
    ``rules`` are the complete current rules, against which conflicts count.
    """
    selected = in_order(select_suggestions(suggestions, aliases, min_confidence, limit))
    assessed = assess_mapping_risk(selected, rules, coverage)
    known = active.select(*rule_identity()).distinct().withColumn("is_active", F.lit(True))
    any_high = assessed.agg(F.coalesce(F.bool_or(F.col("risk_level") == "high"), F.lit(False)).alias("any_high")).scalar()
    repeat = F.row_number().over(Window.partitionBy(*_IDENTITY).orderBy("position"))
    checked = (
        assessed.select("*", *rule_identity())
        .join(known, _IDENTITY, "left")
        .withColumn("any_high", F.lit(False) if force else any_high)
        .withColumn("repeat", repeat)
    )
    status = (
        F.when(F.col("any_high"), "blocked")
        .when(F.col("is_active").isNotNull() | (F.col("repeat") > 1), "skipped")
        .otherwise("applied")
    )
    return checked.withColumn("status", status).select(
        "position", *RULE_COLUMNS, "confidence", "risk_level", "flags", "status"
    )


def plan_rollback(active: DataFrame, aliases: Sequence[str], scope: str = "", channel: str = "") -> DataFrame:
    """Active rules to remove by alias, optionally of one scope or channel.

    ``status`` is ``removed``, or ``not_found`` for an alias without such a rule.
    """
    spark = active.sparkSession
    wanted = spark.createDataFrame(
        [(alias.strip(), normalize_text(alias)) for alias in aliases if alias.strip()], "asked string, alias_key string"
    )
    hit = active.withColumn("alias_key", normalize_key(F.col("alias")))
    if scope.strip():
        hit = hit.filter(F.col("scope") == scope.strip().lower())
    if normalize_text(channel):
        hit = hit.filter(normalize_key(F.col("channel")) == normalize_text(channel))
    removed = hit.join(wanted, "alias_key", "left_semi").select(*RULE_COLUMNS, F.lit("removed").alias("status"))
    missing = wanted.join(hit, "alias_key", "left_anti").select(
        F.lit(scope.strip().lower()).alias("scope"),
        F.lit("").alias("canonical_value"),
        F.col("asked").alias("alias"),
        F.lit(channel).alias("channel"),
        F.lit("not_found").alias("status"),
    )
    return removed.unionByName(missing)


def history_rows(planned: DataFrame, changed_at: str) -> DataFrame:
    """History rows of the rules that a plan applies or removes."""
    position = F.col("position") if "position" in planned.columns else F.monotonically_increasing_id()
    return planned.filter(F.col("status").isin("applied", "removed")).select(
        F.lit(changed_at).alias("changed_at"),
        F.when(F.col("status") == "applied", APPLY).otherwise(ROLLBACK).alias("action"),
        position.alias("position"),
        *RULE_COLUMNS,
    )


def record(planned: DataFrame, path: str, changed_at: str | None = None) -> None:
    """Append the changes of a plan (a written table) to the history; a plan without changes writes nothing.

    ``changed_at`` is ISO text; without an offset it is UTC. Two batches of one moment are refused.
    """
    changed_at = changed_at or datetime.now(timezone.utc).isoformat()
    moment = datetime.fromisoformat(changed_at)
    moment = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
    rows = history_rows(planned, moment.isoformat())
    if rows.isEmpty():
        return
    spark = planned.sparkSession
    same = read_history(spark, path).filter(_instant() == F.lit(moment))
    if same.limit(1).count():
        raise ValueError(f"changes of {changed_at} are recorded already; the order of two batches has to be known")
    rows.write.mode("append").parquet(path)


def review_mappings(
    history: DataFrame, history_limit: int | None = None, rules_limit: int | None = None
) -> dict[str, DataFrame]:
    """Active rules in order and the changes, newest first; all of them, or the first of each."""
    rules = active_rules(history).orderBy("batch", "position")
    changes = history.orderBy(_instant().desc(), F.desc("position"))
    return {
        "rules": rules if rules_limit is None else rules.limit(int(rules_limit)),
        "history": changes if history_limit is None else changes.limit(int(history_limit)),
    }


def apply_mappings(
    suggestions: DataFrame,
    path: str,
    rules: DataFrame,
    coverage: DataFrame,
    aliases: Sequence[str] = (),
    min_confidence: float = 0.8,
    limit: int | None = None,
    force: bool = False,
    changed_at: str | None = None,
) -> DataFrame:
    """Plan an apply against the history at ``path``, record it and return the plan."""
    active = active_rules(read_history(suggestions.sparkSession, path))
    planned = snapshot(plan_apply(suggestions, active, rules, coverage, aliases, min_confidence, limit, force))
    record(planned, path, changed_at)
    return planned


def rollback_mappings(
    spark: SparkSession,
    path: str,
    aliases: Sequence[str],
    scope: str = "",
    channel: str = "",
    changed_at: str | None = None,
) -> DataFrame:
    """Plan a rollback against the history at ``path``, record it and return the plan."""
    planned = snapshot(plan_rollback(active_rules(read_history(spark, path)), aliases, scope, channel))
    record(planned, path, changed_at)
    return planned
