"""Queries on alias rules: resolution, coverage, suggestions, review and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.export import report_types
from tidemark.functions.numeric import rounded
from tidemark.functions.text import name_similarity, normalize_key
from tidemark.operators.mapping import coverage, names, rollups, rules, store, suggest
from tidemark.plans import canonical as tables
from tidemark.plans.canonical import AS_OF, CAMPAIGN_SPELLINGS, sql_ratio, sql_round, with_tables
from tidemark.session import scratch_dir, snapshot

# The rules that the queries start from: (scope, canonical value, alias, channel).
USER_RULES = [
    ("channel", "furniture", "furnitur", ""),
    ("campaign", "low_priority", "low", ""),
    ("campaign", "low_priority", "5-LOW", ""),
    ("campaign", "Urgent", "1_urgent", "machinery"),
    ("campaign", "Urgent", "1-URGENT", "machinery"),
    ("campaign", "top", "2 HIGH", "building"),
    ("campaign", "second", "2-HIGH", ""),
]
CHANGED_AT = "2024-01-31T00:00:00+00:00"
# Later, though its text sorts earlier.
ROLLED_BACK_AT = "2024-01-30T23:30:00-05:00"


def _rules(spark: SparkSession) -> DataFrame:
    return rules.all_rules(spark, rules.user_rules(spark, USER_RULES))


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.marketing_spend(spark, sf_dir)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.user_events(spark, sf_dir)


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _spend(spark, sf_dir), _events(spark, sf_dir)


# -- Spark -------------------------------------------------------------------


def _normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = _events(spark, sf_dir).select("utm_source", "utm_campaign")
    return report_types(
        spelled.groupBy("utm_source", "utm_campaign").agg(
            F.first(normalize_key(F.col("utm_source"))).alias("channel_name"),
            F.first(normalize_key(F.col("utm_campaign"))).alias("campaign_name"),
            F.count(F.lit(1)).alias("events"),
        )
    )


def _canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = rules.canonicalize(_events(spark, sf_dir), _rules(spark), "utm_source", "utm_campaign")
    return report_types(keyed.groupBy("utm_source", "utm_campaign", "channel_key", "campaign_key").agg(F.count(F.lit(1)).alias("events")))


def _similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's priority against a spelling picked by its key."""
    spelling = F.element_at(F.array(*[F.lit(s) for s in CAMPAIGN_SPELLINGS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    pairs = tables.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("campaign"), spelling.alias("spelling"))
    counted = pairs.agg(F.count(F.lit(1)).alias("orders"))
    return report_types(counted.withColumn("score", rounded(name_similarity(F.col("campaign"), F.col("spelling")), 4)))


def _spend_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(rollups.spend_rollup(_spend(spark, sf_dir), _rules(spark), AS_OF))


def _spend_rollup_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup from the names that two loads left behind, with a scan of the recent days alone."""
    spend, path = _spend(spark, sf_dir), scratch_dir(spark)
    first = F.col("date") < F.date_sub(F.lit(AS_OF).cast("date"), 20)
    for load in (first, ~first):
        names.add_spend_names(spend.filter(load), path)
    return report_types(rollups.spend_rollup(spend, _rules(spark), AS_OF, known=names.read_spend_names(spark, path)))


def _event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(rollups.event_rollup(_events(spark, sf_dir), _rules(spark), AS_OF))


def _bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(rollups.attribution_bridge(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _bridge_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.channel_events(spark, sf_dir)
    return report_types(rollups.attribution_bridge(_spend(spark, sf_dir), events, _rules(spark), AS_OF)).drop("campaign_id")


def _bridge_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(rollups.attribution_bridge_coverage(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(coverage.mapping_coverage(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _coverage_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.channel_events(spark, sf_dir)
    return report_types(coverage.mapping_coverage(_spend(spark, sf_dir), events, rules.all_rules(spark), AS_OF))


def _unmatched_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(coverage.unmatched_event_keys(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _unmatched_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(coverage.unmatched_spend_keys(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(coverage.applied_alias_rules(*_both(spark, sf_dir), _rules(spark), AS_OF))


def _diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four parts under one another: section, item, value."""
    parts = coverage.mapping_diagnostics(*_both(spark, sf_dir), _rules(spark), AS_OF)

    def rows(section: str, name: str, item, value: str) -> DataFrame:
        return parts[name].select(F.lit(section).alias("section"), item.alias("item"), F.col(value).cast("double").alias("value"))

    return report_types(
        parts["coverage"]
        .select(F.lit("coverage").alias("section"), F.lit("matched_spend_30d").alias("item"), F.col("matched_spend_30d").alias("value"))
        .unionByName(rows("events", "unmatched_events", F.concat_ws("/", "utm_source", "utm_campaign"), "revenue_30d"))
        .unionByName(rows("spend", "unmatched_spend", F.concat_ws("/", "channel", "campaign"), "spend_30d"))
        .unionByName(rows("rules", "applied_rules", F.concat_ws("/", "scope", "alias", "channel"), "event_rows"))
    )


def _suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions from nothing but the built-in rules, on snapshots of the two key tables."""
    spelled = names.spelled_names(*_both(spark, sf_dir), AS_OF).kept()
    current = rules.all_rules(spark)
    unmatched = snapshot(coverage.unmatched_events_of(spelled, current))
    catalog = snapshot(rollups.spend_keys(spelled.spend, current))
    return suggest.suggest_mappings(unmatched, catalog, current)


def _suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(_suggestions(spark, sf_dir)).drop("reason")


def _now(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.mapping_coverage(*_both(spark, sf_dir), rules.all_rules(spark), AS_OF)


def _risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risks against rules that already use one of the suggested aliases."""
    assessed = suggest.assess_mapping_risk(snapshot(_suggestions(spark, sf_dir)), _rules(spark), _now(spark, sf_dir))
    return report_types(assessed).drop("reason")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    selected = suggest.select_suggestions(snapshot(_suggestions(spark, sf_dir)), min_confidence=0.72)
    return report_types(suggest.preview_mappings(*_both(spark, sf_dir), rules.all_rules(spark), snapshot(selected), AS_OF))


def _review_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selected suggestions and the mix of their risks."""
    pack = suggest.mapping_review_pack(*_both(spark, sf_dir), rules.all_rules(spark), snapshot(_suggestions(spark, sf_dir)), AS_OF, min_confidence=0.72)
    mix = pack["risk_mix"].select(F.lit("mix").alias("section"), F.col("risk_level").alias("item"), F.col("suggestions").cast("double").alias("value"))
    risk = pack["risk_review"].select(
        F.lit("risk").alias("section"), F.concat_ws("/", "scope", "alias", "channel", "risk_level").alias("item"), F.col("risk_score").cast("double").alias("value")
    )
    preview = pack["coverage_preview"].select(F.lit("preview").alias("section"), F.col("metric").alias("item"), F.col("preview").alias("value"))
    return report_types(mix.unionByName(risk).unionByName(preview))


def _apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applied twice: the second run finds every rule in place."""
    path, now = scratch_dir(spark), snapshot(_now(spark, sf_dir))
    suggestions = snapshot(_suggestions(spark, sf_dir))
    runs = [
        store.apply_mappings(suggestions, path, rules.all_rules(spark), now, min_confidence=0.72, force=i == 2, changed_at=CHANGED_AT)
        .withColumn("run", F.lit(i))
        for i in (1, 2)
    ]
    return report_types(runs[0].unionByName(runs[1])).drop("position")


def _changed_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A rollback of two aliases after an apply: its plan and the history afterwards."""
    path, now = scratch_dir(spark), snapshot(_now(spark, sf_dir))
    suggestions = snapshot(_suggestions(spark, sf_dir))
    store.apply_mappings(suggestions, path, rules.all_rules(spark), now, min_confidence=0.72, changed_at=CHANGED_AT)
    plan = store.rollback_mappings(spark, path, ["Furnitur", "not specified 4", "unheard-of"], changed_at=ROLLED_BACK_AT)
    return plan, store.read_history(spark, path)


def _rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(_changed_history(spark, sf_dir)[0])


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = store.review_mappings(_changed_history(spark, sf_dir)[1])
    active = parts["rules"].select(F.lit("active").alias("section"), "scope", "alias", "canonical_value", "channel")
    history = parts["history"].select(F.col("action").alias("section"), "scope", "alias", "canonical_value", "channel")
    return report_types(active.unionByName(history))


# -- SQL ---------------------------------------------------------------------


def _norm(column: str) -> str:
    return f"lower(regexp_replace(coalesce({column}, ''), '[ _/.-]', '', 'g'))"


def _tokens(column: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({column}, '')), '[ _/.-]+'), lambda w: w <> ''))"


def _similarity_sql(a: str, b: str) -> str:
    x, y, tx, ty = _norm(a), _norm(b), _tokens(a), _tokens(b)
    shared, union = f"len(list_intersect({tx}, {ty}))", f"len(list_distinct(list_concat({tx}, {ty})))"
    return f"""CASE WHEN {x} = '' OR {y} = '' THEN 0.0::DOUBLE WHEN {x} = {y} THEN 1.0::DOUBLE ELSE greatest(
        CASE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN least(length({x}), length({y}))::DOUBLE / greatest(length({x}), length({y})) ELSE 0 END,
        CASE WHEN len({tx}) > 0 AND len({ty}) > 0 THEN {shared}::DOUBLE / {union} ELSE 0 END) END"""


def _rule_values(user: list[tuple[str, str, str, str]]) -> str:
    """All rules as a table: built-in ones, then each given rule followed by its canonical value."""
    rows = [("channel", c, a, "") for c, aliases in rules.BUILTIN_CHANNELS.items() for a in (c, *aliases)]
    for scope, canonical, alias, channel in user:
        rows += [(scope, canonical, alias, channel), (scope, canonical, canonical, channel)]
    values = ", ".join(str((i, *row)) for i, row in enumerate(rows))
    return f"""SELECT *, {_norm('alias')} AS alias_name, {_norm('channel')} AS channel_name
               FROM (VALUES {values}) v(ord, scope, canonical_value, alias, channel)"""


def _channel_key(column: str, table: str = "rules") -> str:
    return f"coalesce((SELECT min_by(r.canonical_value, r.ord) FROM {table} r WHERE r.scope = 'channel' AND r.alias_name = {_norm(column)}), {_norm(column)})"


def _campaign_key(column: str, channel: str, table: str = "rules") -> str:
    return f"""coalesce((SELECT min_by(r.canonical_value, r.ord) FROM {table} r WHERE r.scope = 'campaign' AND r.alias_name = {_norm(column)}
        AND (r.channel = '' OR r.channel_name = {_norm(channel)})), {_norm(column)})"""


def _keyed(suffix: str = "", table: str = "rules") -> dict[str, str]:
    """Spend and events by key under a table of rules."""
    recent_spend = f"CASE WHEN date >= DATE '{AS_OF}' - 30 THEN {{}} ELSE 0 END"
    return {
        f"spend_names{suffix}": f"""SELECT channel AS n1, campaign AS n2, {_channel_key('t.channel', table)} AS channel_key, {_campaign_key('t.campaign', 't.channel', table)} AS campaign_key
            FROM (SELECT DISTINCT channel, campaign FROM marketing_spend) t""",
        f"event_names{suffix}": f"""SELECT utm_source AS n1, utm_campaign AS n2, {_channel_key('utm_source', table)} AS channel_key, {_campaign_key('utm_campaign', 'utm_source', table)} AS campaign_key
            FROM (SELECT DISTINCT utm_source, utm_campaign FROM user_events)""",
        f"keyed_events{suffix}": f"""SELECT e.*, n.channel_key, n.campaign_key FROM user_events e JOIN event_names{suffix} n ON e.utm_source = n.n1 AND e.utm_campaign = n.n2
            WHERE e.event_date >= DATE '{AS_OF}' - 30""",
        f"spend_rollup{suffix}": f"""SELECT n.channel_key, n.campaign_key, min(channel) AS channel, min(campaign) AS campaign, min(campaign_id) AS campaign_id,
            sum({recent_spend.format('spend')}) AS spend_30d, CAST(sum({recent_spend.format('clicks')}) AS BIGINT) AS clicks_30d,
            CAST(sum({recent_spend.format('conversions')}) AS BIGINT) AS platform_conversions_30d
            FROM marketing_spend s JOIN spend_names{suffix} n ON s.channel = n.n1 AND s.campaign = n.n2 GROUP BY 1, 2""",
        f"event_rollup{suffix}": f"""SELECT channel_key, campaign_key, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS signups_30d,
            count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchasers_30d,
            sum(CASE WHEN event_type = 'purchase' THEN revenue ELSE 0 END) AS revenue_30d FROM keyed_events{suffix} GROUP BY 1, 2""",
        f"joined{suffix}": f"""SELECT s.*, e.channel_key AS matched_key, e.signups_30d, e.purchasers_30d, e.revenue_30d
            FROM spend_rollup{suffix} s LEFT JOIN event_rollup{suffix} e ON s.channel_key = e.channel_key AND s.campaign_key = e.campaign_key""",
    }


_NAMES = "user_events marketing_spend"
_RULES = _rule_values(USER_RULES)
_BUILTIN = _rule_values([])
_TOTAL = f"(SELECT sum(revenue) FROM user_events WHERE event_date >= DATE '{AS_OF}' - 30 AND event_type = 'purchase')"


def _coverage_sql(suffix: str = "") -> str:
    return f"""SELECT {sql_round('sum(spend_30d)', 2)} AS total_spend_30d, {sql_round('coalesce(sum(CASE WHEN matched_key IS NOT NULL THEN spend_30d END), 0)', 2)} AS matched_spend_30d,
        count(*) AS total_keys, count(matched_key) AS matched_keys, {sql_round('coalesce(sum(revenue_30d), 0)', 2)} AS attributed_revenue_30d, {sql_round(_TOTAL, 2)} AS total_revenue_30d,
        {sql_ratio('coalesce(sum(CASE WHEN matched_key IS NOT NULL THEN spend_30d END), 0) * 100.0', 'sum(spend_30d)', 1)} AS spend_coverage_pct,
        {sql_ratio('coalesce(sum(revenue_30d), 0) * 100.0', _TOTAL, 1)} AS revenue_coverage_pct FROM joined{suffix}"""


def _query(sql: str, rule_values: str = _RULES, **more: str) -> str:
    return with_tables(_NAMES, sql, rules=rule_values, **_keyed(), **more)


_BRIDGE = f"""SELECT channel, campaign_id, campaign, {sql_round('spend_30d', 2)} AS spend_30d, clicks_30d, CAST(platform_conversions_30d AS DOUBLE) AS platform_conversions_30d,
    coalesce(signups_30d, 0) AS signups_30d, coalesce(purchasers_30d, 0) AS purchasers_30d, {sql_round('coalesce(revenue_30d, 0)', 2)} AS attributed_revenue_30d,
    {sql_ratio('coalesce(revenue_30d, 0)', 'spend_30d', 2)} AS attributed_roas, {sql_ratio('spend_30d', 'coalesce(purchasers_30d, 0)', 2)} AS cost_per_purchaser
    FROM joined WHERE spend_30d >= 50 ORDER BY attributed_revenue_30d DESC, spend_30d DESC, channel, campaign"""
_UNMATCHED = f"""SELECT utm_source, utm_campaign, e.channel_key, e.campaign_key, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchasers_30d,
    {sql_round("sum(CASE WHEN event_type = 'purchase' THEN revenue ELSE 0 END)", 2)} AS revenue_30d FROM keyed_events e
    LEFT JOIN (SELECT DISTINCT channel_key, campaign_key FROM spend_rollup) s ON e.channel_key = s.channel_key AND e.campaign_key = s.campaign_key
    WHERE s.channel_key IS NULL GROUP BY 1, 2, 3, 4 HAVING sum(CASE WHEN event_type = 'purchase' THEN revenue ELSE 0 END) > 0"""
_UNMATCHED_SPEND = f"SELECT channel, campaign, {sql_round('spend_30d', 2)} AS spend_30d FROM joined WHERE matched_key IS NULL"
_HITS = f"""SELECT r.scope, r.alias, r.canonical_value, r.channel, coalesce(s.n, 0) AS spend_rows, coalesce(e.n, 0) AS event_rows,
        coalesce(s.sample, '') AS spend_sample, coalesce(e.sample, '') AS event_sample
    FROM (SELECT scope, canonical_value, channel, channel_name, alias_name, min_by(alias, ord) AS alias FROM rules
          WHERE alias_name <> {_norm('canonical_value')} GROUP BY 1, 2, 3, 4, 5) r,
    LATERAL (SELECT count(*) AS n, min(CASE r.scope WHEN 'channel' THEN channel ELSE campaign END) AS sample FROM marketing_spend m WHERE m.date >= DATE '{AS_OF}' - 30
             AND ((r.scope = 'channel' AND {_norm('m.channel')} = r.alias_name)
               OR (r.scope = 'campaign' AND {_norm('m.campaign')} = r.alias_name AND r.channel_name IN ('', {_norm('m.channel')})))) s,
    LATERAL (SELECT count(*) AS n, min(CASE r.scope WHEN 'channel' THEN utm_source ELSE utm_campaign END) AS sample FROM user_events u WHERE u.event_date >= DATE '{AS_OF}' - 30
             AND ((r.scope = 'channel' AND {_norm('u.utm_source')} = r.alias_name)
               OR (r.scope = 'campaign' AND {_norm('u.utm_campaign')} = r.alias_name AND r.channel_name IN ('', {_norm('u.utm_source')})))) e
    WHERE s.n + e.n > 0"""

# The suggestions by comparing every unmatched name with every spend key.
_SUGGEST = {
    "unmatched": _UNMATCHED,
    "known": """SELECT u.utm_source, u.utm_campaign, (SELECT c.channel FROM spend_rollup c WHERE c.channel_key = u.channel_key
                ORDER BY c.spend_30d DESC, c.channel, c.campaign LIMIT 1) AS known_channel FROM unmatched u""",
    "channel_scores": f"""SELECT utm_source, channel, score FROM (SELECT u.utm_source, c.channel, {_similarity_sql('u.utm_source', 'c.channel')} AS score, c.spend_30d, c.campaign
                FROM (SELECT DISTINCT utm_source FROM unmatched) u, spend_rollup c)
                QUALIFY row_number() OVER (PARTITION BY utm_source ORDER BY score DESC, spend_30d DESC, channel, campaign) = 1""",
    "candidates": """SELECT u.*, k.known_channel, CASE WHEN k.known_channel IS NULL AND s.score >= 0.78 THEN s.channel END AS similar_channel, s.score
                FROM unmatched u JOIN known k USING (utm_source, utm_campaign) JOIN channel_scores s USING (utm_source)""",
    "hinted": "SELECT *, coalesce(known_channel, similar_channel, channel_key) AS hint FROM candidates WHERE utm_campaign <> ''",
    "campaign_pairs": f"""SELECT h.utm_source, h.utm_campaign, h.revenue_30d, h.purchasers_30d, c.channel, c.campaign, c.spend_30d, {_similarity_sql('h.utm_campaign', 'c.campaign')} AS score
                FROM hinted h, spend_rollup c WHERE c.channel = h.hint OR c.channel_key = h.hint
                  OR NOT EXISTS (SELECT 1 FROM spend_rollup x WHERE x.channel = h.hint OR x.channel_key = h.hint)""",
    "campaign_best": """SELECT * FROM campaign_pairs QUALIFY row_number() OVER (PARTITION BY utm_source, utm_campaign ORDER BY score DESC, spend_30d DESC, channel, campaign) = 1""",
    "proposed": f"""SELECT 'channel' AS scope, similar_channel AS canonical_value, utm_source AS alias, '' AS channel, {sql_round('score', 2)} AS confidence,
                revenue_30d AS estimated_revenue_30d, CAST(0 AS DOUBLE) AS estimated_spend_30d, purchasers_30d FROM candidates WHERE similar_channel IS NOT NULL
                UNION ALL SELECT 'campaign', campaign, utm_campaign, channel, {sql_round('score', 2)}, revenue_30d, {sql_round('spend_30d', 2)}, purchasers_30d
                FROM campaign_best WHERE score >= 0.72""",
    "suggestions": f"""SELECT scope, canonical_value, alias, channel, confidence, estimated_revenue_30d, estimated_spend_30d FROM proposed p
                WHERE NOT EXISTS (SELECT 1 FROM rules r WHERE r.scope = p.scope AND r.canonical_value = p.canonical_value AND r.channel = p.channel AND r.alias_name = {_norm('p.alias')})
                QUALIFY row_number() OVER (PARTITION BY scope, canonical_value, channel, {_norm('alias')} ORDER BY estimated_revenue_30d DESC, purchasers_30d DESC, alias) = 1""",
}
_RANKING = "confidence DESC, estimated_revenue_30d DESC, estimated_spend_30d DESC, scope, alias, channel, canonical_value"
_SELECTED = {"selected": f"SELECT *, row_number() OVER (ORDER BY {_RANKING}) AS position FROM suggestions WHERE confidence >= 0.72"}


def _risk_ctes(source: str, rule_table: str) -> dict[str, str]:
    overlap = f"len(list_intersect({_tokens('s.alias')}, {_tokens('s.canonical_value')}))::DOUBLE / len(list_distinct(list_concat({_tokens('s.alias')}, {_tokens('s.canonical_value')})))"
    conflict = f"""EXISTS (SELECT 1 FROM {rule_table} r WHERE r.scope = s.scope AND ((r.alias_name = {_norm('s.alias')} AND (r.canonical_value <> s.canonical_value OR r.channel_name <> {_norm('s.channel')}))
        OR ({_norm('r.canonical_value')} = {_norm('s.alias')} AND r.canonical_value <> s.canonical_value)))"""
    weights = {"low_confidence_match": 2, "weak_token_overlap": 1, "missing_channel_scope": 2, "existing_alias_conflict": 3, "no_spend_support": 1, "high_revenue_impact": 1, "high_spend_impact": 1}
    score = " + ".join(f"CASE WHEN {name} THEN {weight} ELSE 0 END" for name, weight in weights.items())
    flags = ", ".join(f"CASE WHEN {name} THEN '{name}' END" for name in weights)
    return {
        "cov": _coverage_sql(),
        "flagged": f"""SELECT s.*, s.confidence < 0.85 AS low_confidence_match, s.scope = 'campaign' AND {overlap} < 0.5 AS weak_token_overlap, s.scope = 'campaign' AND s.channel = '' AS missing_channel_scope,
            {conflict} AS existing_alias_conflict, s.scope = 'campaign' AND s.estimated_spend_30d <= 0 AS no_spend_support,
            c.total_revenue_30d <> 0 AND s.estimated_revenue_30d >= greatest(500, c.total_revenue_30d * 0.25) AS high_revenue_impact,
            c.total_spend_30d <> 0 AND s.estimated_spend_30d >= greatest(250, c.total_spend_30d * 0.25) AS high_spend_impact FROM {source} s, cov c""",
        "risks": f"""SELECT *, CASE WHEN risk_score >= 4 THEN 'high' WHEN risk_score >= 2 THEN 'medium' ELSE 'low' END AS risk_level
            FROM (SELECT *, CAST({score} AS BIGINT) AS risk_score, concat_ws(', ', {flags}) AS flags FROM flagged)""",
    }


_RULE_COLUMNS = "scope, canonical_value, alias, channel"
_PREVIEW_RULES = f"""SELECT ord, scope, canonical_value, alias, channel, alias_name, channel_name FROM rules
    UNION ALL SELECT 1000 + position * 2 + step, scope, canonical_value, name, channel, {_norm('name')}, {_norm('channel')}
    FROM (SELECT position, 0 AS step, scope, canonical_value, alias AS name, channel FROM selected UNION ALL SELECT position, 1, scope, canonical_value, canonical_value, channel FROM selected)"""


def _preview_rows() -> str:
    metrics = {
        "matched_spend_30d": "Mapped spend (30d)", "spend_coverage_pct": "Spend coverage", "attributed_revenue_30d": "Attributed revenue (30d)",
        "revenue_coverage_pct": "Revenue coverage", "matched_keys": "Matched keys", "total_keys": "Total keys",
    }
    return " UNION ALL ".join(
        f"""SELECT '{label}' AS metric, CAST(a.{name} AS DOUBLE) AS current, CAST(b.{name} AS DOUBLE) AS preview,
            {sql_round(f'CAST(b.{name} AS DOUBLE) - CAST(a.{name} AS DOUBLE)', 2)} AS delta FROM cov a, cov_preview b"""
        for name, label in metrics.items()
    )


_PREVIEW_CTES = {"preview_rules": _PREVIEW_RULES, **_keyed("_p", "preview_rules"), "cov_preview": _coverage_sql("_p")}
_APPLIED = f"""SELECT {_RULE_COLUMNS}, confidence, risk_level, flags, CASE WHEN max(CASE risk_level WHEN 'high' THEN 1 ELSE 0 END) OVER () = 1 THEN 'blocked'
    WHEN row_number() OVER (PARTITION BY scope, {_norm('canonical_value')}, {_norm('alias')}, {_norm('channel')} ORDER BY position) > 1 THEN 'skipped' ELSE 'applied' END AS status FROM risks"""
_ROLLED_BACK = f"{_norm('alias')} IN ('furnitur', 'notspecified4')"
_CHANGE_CTES = {**_SUGGEST, **_SELECTED, **_risk_ctes("selected", "rules"), "applied": _APPLIED}

QUERIES = {
    "normalize_key": (
        _normalize,
        with_tables(
            "user_events",
            f"SELECT utm_source, utm_campaign, {_norm('utm_source')} AS channel_name, {_norm('utm_campaign')} AS campaign_name, count(*) AS events FROM user_events GROUP BY 1, 2",
        ),
    ),
    "canonicalize": (
        _canonicalize,
        with_tables(
            "user_events",
            f"""SELECT utm_source, utm_campaign, {_channel_key('utm_source')} AS channel_key, {_campaign_key('utm_campaign', 'utm_source')} AS campaign_key, events
                FROM (SELECT utm_source, utm_campaign, count(*) AS events FROM user_events GROUP BY 1, 2)""",
            rules=_RULES,
        ),
    ),
    "name_similarity": (
        _similarity,
        f"""SELECT campaign, spelling, orders, {sql_round(_similarity_sql('campaign', 'spelling'), 4)} AS score FROM
            (SELECT o_orderpriority AS campaign, {list(CAMPAIGN_SPELLINGS)}[o_orderkey % 5 + 1] AS spelling, count(*) AS orders FROM orders GROUP BY 1, 2)""",
    ),
    "spend_rollup": (_spend_rollup, _query("SELECT * REPLACE (CAST(spend_30d AS DOUBLE) AS spend_30d) FROM spend_rollup")),
    "spend_rollup_known": (_spend_rollup_known, _query("SELECT * REPLACE (CAST(spend_30d AS DOUBLE) AS spend_30d) FROM spend_rollup")),
    "event_rollup": (_event_rollup, _query("SELECT * REPLACE (CAST(revenue_30d AS DOUBLE) AS revenue_30d) FROM event_rollup")),
    "attribution_bridge": (_bridge, _query(_BRIDGE.format())),
    "attribution_bridge_by_channel": (
        _bridge_by_channel,
        with_tables(
            _NAMES,
            _BRIDGE.format().replace("campaign_id, ", "", 1),
            rules=_RULES,
            s=f"""SELECT {_channel_key('m.channel')} AS k, min(channel) AS channel, min(channel) AS campaign, sum(spend) AS spend_30d, CAST(sum(clicks) AS BIGINT) AS clicks_30d,
                  CAST(sum(conversions) AS BIGINT) AS platform_conversions_30d FROM marketing_spend m WHERE date >= DATE '{AS_OF}' - 30 GROUP BY 1""",
            e=f"""SELECT {_channel_key('utm_source')} AS k, count(DISTINCT CASE WHEN event_type = 'signup' THEN user_id END) AS signups_30d,
                  count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS purchasers_30d, sum(revenue) AS revenue_30d
                  FROM user_events WHERE event_date >= DATE '{AS_OF}' - 30 GROUP BY 1""",
            joined="SELECT s.*, e.signups_30d, e.purchasers_30d, e.revenue_30d FROM s LEFT JOIN e USING (k)",
        ),
    ),
    "attribution_bridge_coverage": (
        _bridge_coverage,
        _query(
            f"""SELECT {sql_round('(SELECT coalesce(sum(revenue_30d), 0) FROM joined)', 2)} AS attributed_revenue_30d, {sql_round('sum(revenue)', 2)} AS total_revenue_30d,
                count(DISTINCT user_id) AS total_purchasers_30d, {sql_ratio('(SELECT coalesce(sum(revenue_30d), 0) FROM joined) * 100.0', 'sum(revenue)', 1)} AS coverage_pct
                FROM user_events WHERE event_type = 'purchase' AND event_date >= DATE '{AS_OF}' - 30"""
        ),
    ),
    "mapping_coverage": (_coverage, _query(_coverage_sql())),
    "mapping_coverage_by_channel": (
        _coverage_by_channel,
        with_tables(
            _NAMES,
            _coverage_sql(),
            rules=_BUILTIN,
            joined=f"""SELECT s.spend_30d, e.k AS matched_key, e.revenue_30d FROM
                (SELECT {_channel_key('m.channel')} AS k, sum(CASE WHEN date >= DATE '{AS_OF}' - 30 THEN spend ELSE 0 END) AS spend_30d FROM marketing_spend m GROUP BY 1) s
                LEFT JOIN (SELECT {_channel_key('utm_source')} AS k, sum(revenue) AS revenue_30d FROM user_events WHERE event_date >= DATE '{AS_OF}' - 30 GROUP BY 1) e USING (k)""",
        ),
    ),
    "unmatched_event_keys": (_unmatched_events, _query(_UNMATCHED)),
    "unmatched_spend_keys": (_unmatched_spend, _query(_UNMATCHED_SPEND)),
    "applied_alias_rules": (_applied, with_tables(_NAMES, _HITS, rules=_RULES)),
    "mapping_diagnostics": (
        _diagnostics,
        _query(
            """SELECT 'coverage' AS section, 'matched_spend_30d' AS item, matched_spend_30d AS value FROM cov
               UNION ALL SELECT 'events', utm_source || '/' || utm_campaign, revenue_30d FROM un
               UNION ALL SELECT 'spend', channel || '/' || campaign, spend_30d FROM us
               UNION ALL SELECT 'rules', scope || '/' || alias || '/' || channel, CAST(event_rows AS DOUBLE) FROM hits""",
            cov=_coverage_sql(),
            un=_UNMATCHED,
            us=_UNMATCHED_SPEND,
            hits=_HITS,
        ),
    ),
    "suggest_mappings": (_suggest, _query("SELECT * FROM suggestions", _BUILTIN, **_SUGGEST)),
    "assess_mapping_risk": (
        _risk,
        _query(
            f"SELECT {_RULE_COLUMNS}, confidence, estimated_revenue_30d, estimated_spend_30d, risk_score, risk_level, flags FROM risks",
            _BUILTIN,
            **_SUGGEST,
            all_rules_=_RULES,
            **_risk_ctes("suggestions", "all_rules_"),
        ),
    ),
    "preview_mappings": (_preview, _query(_preview_rows(), _BUILTIN, **_SUGGEST, **_SELECTED, cov=_coverage_sql(), **_PREVIEW_CTES)),
    "mapping_review_pack": (
        _review_pack,
        _query(
            f"""SELECT 'mix' AS section, risk_level AS item, CAST(count(*) AS DOUBLE) AS value FROM risks GROUP BY 2
                UNION ALL SELECT 'risk', scope || '/' || alias || '/' || channel || '/' || risk_level, CAST(risk_score AS DOUBLE) FROM risks
                UNION ALL SELECT 'preview', metric, preview FROM ({_preview_rows()})""",
            _BUILTIN,
            **_CHANGE_CTES,
            **_PREVIEW_CTES,
        ),
    ),
    "apply_mappings": (
        _apply,
        _query(
            """SELECT *, CAST(1 AS BIGINT) AS run FROM applied
               UNION ALL SELECT * REPLACE (CASE status WHEN 'blocked' THEN 'applied' ELSE 'skipped' END AS status), CAST(2 AS BIGINT) FROM applied""",
            _BUILTIN,
            **_CHANGE_CTES,
        ),
    ),
    "rollback_mappings": (
        _rollback,
        _query(
            f"""SELECT {_RULE_COLUMNS}, 'removed' AS status FROM applied WHERE status = 'applied' AND {_ROLLED_BACK}
                UNION ALL SELECT '', '', asked, '', 'not_found' FROM (VALUES ('Furnitur'), ('not specified 4'), ('unheard-of')) v(asked)
                WHERE {_norm('asked')} NOT IN (SELECT {_norm('alias')} FROM applied WHERE status = 'applied')""",
            _BUILTIN,
            **_CHANGE_CTES,
        ),
    ),
    "review_mappings": (
        _review,
        _query(
            f"""SELECT 'active' AS section, {_RULE_COLUMNS} FROM applied WHERE status = 'applied' AND NOT ({_ROLLED_BACK})
                UNION ALL SELECT 'apply', {_RULE_COLUMNS} FROM applied WHERE status = 'applied'
                UNION ALL SELECT 'rollback', {_RULE_COLUMNS} FROM applied WHERE status = 'applied' AND {_ROLLED_BACK}""",
            _BUILTIN,
            **_CHANGE_CTES,
        ),
    ),
}
