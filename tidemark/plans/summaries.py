"""Queries on summaries, paid media and campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.export import report_types
from tidemark.operators import campaigns, reports
from tidemark.plans import canonical as tables
from tidemark.plans.behaviour import _CAC
from tidemark.plans.canonical import AS_OF, sql_ratio, sql_round, with_tables
from tidemark.plans.revenue import anomaly_ctes


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.marketing_spend(spark, sf_dir), tables.user_events(spark, sf_dir)


def _totals_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spend and events for totals over all channels."""
    return tables.plain_spend(spark, sf_dir), tables.plain_events(spark, sf_dir)


def _spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.spend_union(tables.spend_tables(spark, sf_dir))


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.growth_summary(*_totals_inputs(spark, sf_dir), AS_OF)


def _now(column: str, days: int) -> str:
    return f"{column} >= DATE '{AS_OF}' - {days}"


def _then(column: str, days: int) -> str:
    return f"{column} >= DATE '{AS_OF}' - {2 * days} AND {column} < DATE '{AS_OF}' - {days}"


def _metric(order: int, label: str, source: str, column: str, days: int, value: str) -> str:
    """A metric row from one query per period."""
    return f"""SELECT CAST({order} AS BIGINT) AS metric_order, '{label}' AS metric, c AS current_value, p AS previous_value,
        {sql_ratio('(c - p) * 100.0', 'p', 1)} AS change_pct
        FROM (SELECT CAST(coalesce({value}, 0) AS DOUBLE) AS c FROM {source} WHERE {_now(column, days)}),
             (SELECT CAST(coalesce({value}, 0) AS DOUBLE) AS p FROM {source} WHERE {_then(column, days)})"""


_SUMMARY = " UNION ALL ".join(
    [
        _metric(1, "Revenue", "user_events", "event_date", 7, "sum(revenue)"),
        _metric(2, "Spend", "marketing_spend", "date", 7, "sum(spend)"),
        _metric(3, "Conversions", "marketing_spend", "date", 7, "sum(conversions)"),
        _metric(4, "Active Users", "user_events", "event_date", 7, "count(DISTINCT user_id)"),
    ]
)
_NAMES = "user_events marketing_spend"


def _platform(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.spend_tables(spark, sf_dir)[name]


def _platform_sql(name: str, metrics: dict[str, str]) -> str:
    source = f"(SELECT * FROM spend_data WHERE source_table = '{name}')"
    rows = [_metric(i + 1, label, source, "date", 30, f"sum({column})") for i, (column, label) in enumerate(metrics.items())]
    return with_tables("spend_data", " UNION ALL ".join(rows))


def _paid_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(reports.paid_growth_review(_spend(spark, sf_dir), tables.invoices(spark, sf_dir), AS_OF))


def _paid_sql() -> str:
    parts = []
    for name in ("spend", "clicks", "impressions", "conversions"):
        for label, where in (("current", _now("date", 30)), ("previous", _then("date", 30))):
            parts.append(f"(SELECT CAST(coalesce(sum({name}), 0) AS {'DOUBLE' if name == 'spend' else 'BIGINT'}) AS {label}_{name} FROM spend_data WHERE {where})")
    for label, where in (("current", _now("created", 30)), ("previous", _then("created", 30))):
        parts.append(f"(SELECT CAST(coalesce(sum(amount_paid), 0) AS DOUBLE) AS {label}_revenue FROM invoices WHERE status = 'paid' AND {where})")
    return with_tables(
        "spend_data invoices",
        f"SELECT *, {sql_ratio('current_revenue', 'current_spend', 2)} AS mer_current, {sql_ratio('previous_revenue', 'previous_spend', 2)} AS mer_previous FROM "
        + ", ".join(parts),
    )


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.campaign_performance(_spend(spark, sf_dir), AS_OF)


def _period_sum(condition: str, value: str) -> str:
    return f"sum(CASE WHEN {condition} THEN {value} ELSE 0 END)"


_NOW30, _THEN30 = _now("date", 30), _then("date", 30)
_ROLLUP = f"""SELECT channel, campaign_id, campaign, {_period_sum(_NOW30, 'spend')} AS cs, {_period_sum(_NOW30, 'clicks')} AS cc, {_period_sum(_NOW30, 'impressions')} AS ci,
    {_period_sum(_NOW30, 'conversions')} AS cv, {_period_sum(_THEN30, 'spend')} AS ps, {_period_sum(_THEN30, 'conversions')} AS pv FROM spend_data GROUP BY 1, 2, 3"""
_PERFORMANCE = f"""SELECT channel, campaign_id, campaign, {sql_round('cs', 2)} AS current_spend, CAST(cc AS BIGINT) AS current_clicks, CAST(ci AS BIGINT) AS current_impressions,
    CAST(cv AS DOUBLE) AS current_conversions, {sql_round('ps', 2)} AS previous_spend, CAST(pv AS DOUBLE) AS previous_conversions,
    {sql_ratio('cs', 'cc', 2)} AS current_cpc, {sql_ratio('cc * 100.0', 'ci', 2)} AS current_ctr, {sql_ratio('cs', 'cv', 2)} AS current_cpa,
    {sql_ratio('(cs - ps) * 100.0', 'ps', 1)} AS spend_change_pct FROM rollup_ WHERE cs > 0 OR ps > 0"""


def _performance_sql(rest: str, source: str = "spend_data") -> str:
    rollup = _ROLLUP.replace("spend_data", source)
    return with_tables(source, f"SELECT * FROM performance {rest}", rollup_=rollup, performance=_PERFORMANCE)


def _account_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = campaigns.spend_union({"account_spend": tables.account_spend(spark, sf_dir)})
    return campaigns.campaign_performance(spend, AS_OF)


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as contacts, by the range of their balance."""
    balance = F.col("c_acctbal")
    stage = F.when(balance < 0, "lead").when(balance < 5000, "opportunity").otherwise("customer")
    return tables.read(spark, sf_dir, "customer").select(stage.alias("lifecycle_stage"))


def _share_sql(names: str, column: str, source: str, count_name: str) -> str:
    return with_tables(
        names,
        f"SELECT {column}, count(*) AS {count_name}, {sql_round('count(*) * 100.0 / sum(count(*)) OVER ()', 1)} AS share_pct FROM {source} GROUP BY 1",
    )


def _amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.user_events(spark, sf_dir).select("event_type", F.col("utm_campaign").alias("device_type"), F.col("utm_source").alias("country"))
    parts = reports.amplitude_events_summary(events, top_countries=3)
    none = F.lit(None).cast("double")
    return report_types(
        parts["by_type"]
        .select(F.lit("type").alias("section"), F.col("event_type").alias("item"), "events", "share_pct")
        .unionByName(parts["by_device"].select(F.lit("device").alias("section"), F.col("device_type").alias("item"), "events", none.alias("share_pct")))
        .unionByName(parts["top_countries"].select(F.lit("country").alias("section"), F.col("country").alias("item"), "events", none.alias("share_pct")))
    )


_LISTS = """string_agg({text}, ', ' ORDER BY metric_order) FILTER (WHERE change_pct {op} 0)"""


def _listed(text: str, op: str) -> str:
    return f"coalesce({_LISTS.format(text=text, op=op)}, '')"


_CHANGE = "format('{:+.1f}', change_pct)"
_WHOLE = "format('{:,}', CAST(round(current_value, 0) AS BIGINT))"
QUERIES = {
    "growth_summary": (lambda spark, d: report_types(_summary(spark, d)), with_tables(_NAMES, _SUMMARY)),
    "weekly_growth_review": (
        lambda spark, d: report_types(reports.weekly_growth_review(*_inputs(spark, d), AS_OF)),
        with_tables(
            _NAMES,
            f"""SELECT {_listed('metric', '>')} AS positive_movement, {_listed('metric', '<')} AS negative_movement,
                       (SELECT count(*) FROM anomalies) AS anomalies, (SELECT channel FROM cac WHERE cac IS NOT NULL ORDER BY cac, channel LIMIT 1) AS lowest_cac_channel
                FROM summary""",
            summary=_SUMMARY,
            cac=_CAC,
            **anomaly_ctes("marketing_spend", "spend", "date", 30),
        ),
    ),
    "executive_summary": (
        lambda spark, d: report_types(reports.executive_summary(_summary(spark, d))),
        with_tables(
            _NAMES,
            f"""SELECT coalesce(nullif({_listed(f"metric || ' ' || {_CHANGE} || '%'", '>')}, ''), 'No major wins detected.') AS wins,
                       coalesce(nullif({_listed(f"metric || ' ' || {_CHANGE} || '%'", '<')}, ''), 'No major risks detected.') AS risks FROM summary""",
            summary=_SUMMARY,
        ),
    ),
    "narrative_growth_review": (
        lambda spark, d: report_types(reports.narrative_growth_review(_summary(spark, d))),
        with_tables(
            _NAMES,
            f"""SELECT CASE WHEN max(change_pct > 0) OVER () AND max(change_pct <= 0) OVER () THEN 'mixed' WHEN max(change_pct > 0) OVER () THEN 'positive'
                            ELSE 'pressure' END AS tone, row_number() OVER (ORDER BY CASE WHEN change_pct IS NULL THEN 3 WHEN change_pct > 0 THEN 1 ELSE 2 END, metric_order) - 1 AS position,
                       CASE WHEN change_pct IS NULL THEN metric || ' is ' || {_WHOLE} || ' (no prior period for comparison)'
                            WHEN change_pct > 0 THEN metric || ' grew ' || {_CHANGE} || '% to ' || {_WHOLE}
                            ELSE metric || ' declined ' || {_CHANGE} || '% to ' || {_WHOLE} END AS finding FROM summary""",
            summary=_SUMMARY,
        ),
    ),
    "weekly_report": (
        lambda spark, d: report_types(reports.weekly_report(*_totals_inputs(spark, d), AS_OF)),
        with_tables(
            _NAMES,
            _SUMMARY
            + "".join(
                f""" UNION ALL SELECT CAST({i} AS BIGINT), '{label}', CAST(count(DISTINCT user_id) AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
                     FROM user_events WHERE event_type = '{kind}' AND {_now('event_date', 7)}"""
                for i, label, kind in ((5, "Signups", "signup"), (6, "Purchasers", "purchase"))
            ),
        ),
    ),
    "paid_growth_review": (_paid_review, _paid_sql()),
    "paid_channel_mix": (
        lambda spark, d: report_types(reports.paid_channel_mix(_spend(spark, d), AS_OF)),
        with_tables(
            "spend_data",
            f"""SELECT channel, {sql_round('sum(spend)', 2)} AS spend_30d, CAST(sum(clicks) AS BIGINT) AS clicks_30d, CAST(sum(impressions) AS BIGINT) AS impressions_30d,
                       CAST(sum(conversions) AS DOUBLE) AS conversions_30d FROM spend_data WHERE {_NOW30} GROUP BY 1""",
        ),
    ),
    "spend_union": (
        lambda spark, d: report_types(_spend(spark, d)),
        with_tables(
            "spend_data",
            """SELECT source_table, channel, campaign_id, campaign, strftime(date, '%Y-%m-%d') AS date, CAST(spend AS DOUBLE) AS spend, clicks, impressions, conversions
               FROM spend_data""",
        ),
    ),
    "campaign_performance": (lambda spark, d: report_types(_performance(spark, d)), _performance_sql("")),
    "top_campaigns": (
        lambda spark, d: report_types(campaigns.top_campaigns(_performance(spark, d), limit=5)),
        _performance_sql("ORDER BY current_spend DESC, current_conversions DESC, channel, campaign LIMIT 5"),
    ),
    "campaign_efficiency_leaders": (
        lambda spark, d: report_types(campaigns.campaign_efficiency_leaders(_account_performance(spark, d), limit=5)),
        _performance_sql(
            """WHERE current_spend >= 50 AND current_conversions > 0
               ORDER BY current_cpa, current_conversions DESC, channel, campaign LIMIT 5""",
            "account_spend",
        ),
    ),
    "campaign_watchlist": (
        lambda spark, d: report_types(campaigns.campaign_watchlist(_account_performance(spark, d), limit=10)),
        _performance_sql(
            """WHERE current_spend >= 50 AND (current_conversions = 0 OR (spend_change_pct > 20 AND current_conversions <= previous_conversions))
               ORDER BY current_spend DESC, current_conversions DESC, channel, campaign LIMIT 10""",
            "account_spend",
        ),
    ),
    "meta_ads_summary": (
        lambda spark, d: report_types(reports.meta_ads_summary(_platform(spark, d, "meta_marketing_spend"), AS_OF)),
        _platform_sql("meta_marketing_spend", {"spend": "Spend", "clicks": "Clicks", "impressions": "Impressions"}),
    ),
    "google_ads_summary": (
        lambda spark, d: report_types(reports.google_ads_summary(_platform(spark, d, "google_marketing_spend"), AS_OF)),
        _platform_sql("google_marketing_spend", {"spend": "Spend", "clicks": "Clicks", "impressions": "Impressions", "conversions": "Conversions"}),
    ),
    "stripe_revenue_summary": (
        lambda spark, d: report_types(reports.stripe_revenue_summary(tables.invoices(spark, d), AS_OF)),
        with_tables(
            "invoices",
            _metric(1, "Revenue", "(SELECT * FROM invoices WHERE status = 'paid')", "created", 30, "sum(amount_paid)")
            + " UNION ALL "
            + _metric(2, "Paid invoices", "(SELECT * FROM invoices WHERE status = 'paid')", "created", 30, "count(*)"),
        ),
    ),
    "hubspot_contacts_summary": (
        lambda spark, d: report_types(reports.hubspot_contacts_summary(_contacts(spark, d))),
        _share_sql(
            "",
            "lifecycle_stage",
            "(SELECT CASE WHEN c_acctbal < 0 THEN 'lead' WHEN c_acctbal < 5000 THEN 'opportunity' ELSE 'customer' END AS lifecycle_stage FROM customer)",
            "contacts",
        ),
    ),
    "mixpanel_events_summary": (
        lambda spark, d: report_types(reports.mixpanel_events_summary(tables.plain_events(spark, d).withColumnRenamed("event_type", "event"))),
        _share_sql("user_events", "event", "(SELECT event_type AS event FROM user_events)", "events"),
    ),
    "amplitude_events_summary": (
        _amplitude,
        with_tables(
            "user_events",
            f"""SELECT 'type' AS section, event_type AS item, count(*) AS events, {sql_round('count(*) * 100.0 / sum(count(*)) OVER ()', 1)} AS share_pct FROM user_events GROUP BY 2
                UNION ALL SELECT 'device', utm_campaign, count(*), CAST(NULL AS DOUBLE) FROM user_events GROUP BY 2
                UNION ALL (SELECT 'country', utm_source, count(*), CAST(NULL AS DOUBLE) FROM user_events GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)""",
        ),
    ),
}
