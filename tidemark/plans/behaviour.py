"""Queries on user behaviour: funnels, acquisition, retention, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.export import report_types
from tidemark.functions.thresholds import CAC, classify_metric
from tidemark.operators import acquisition, adhoc, churn, funnel, retention
from tidemark.plans import canonical as tables
from tidemark.plans.canonical import AS_OF, sql_ratio, sql_round, with_tables

STEPS = ("view", "click", "purchase")
DAY = "2024-01-10"
PERIOD_A, PERIOD_B = ("2024-01-01", "2024-01-02"), ("2024-01-15", "2024-01-15")


def _funnel_ctes(prefix: str, steps: tuple[str, ...], first: str | None, last: str | None) -> dict[str, str]:
    """The funnel step by step, each step restricted to users of the step before."""
    days = (f" AND e.event_date >= DATE '{first}'" if first else "") + (f" AND e.event_date <= DATE '{last}'" if last else "")
    ctes, rows = {}, []
    for i, step in enumerate(steps):
        join = f" JOIN {prefix}{i - 1} p ON e.user_id = p.user_id" if i else ""
        ctes[f"{prefix}{i}"] = f"SELECT DISTINCT e.user_id FROM user_events e{join} WHERE e.event_type = '{step}'{days}"
        rows.append(f"SELECT '{step}' AS step, CAST({i + 1} AS BIGINT) AS step_order, count(*) AS users FROM {prefix}{i}")
    ctes[prefix] = " UNION ALL ".join(rows)
    return ctes


_ANALYZED = f"""
    SELECT step, step_order, users,
           coalesce({sql_ratio('users * 100.0', 'first_value(users) OVER (ORDER BY step_order)', 1)}, 0.0) AS conversion_pct,
           CASE WHEN step_order > 1 THEN coalesce({sql_ratio('(before - users) * 100.0', 'before', 1)}, 0.0) END AS drop_off_pct,
           CASE WHEN step_order > 1 THEN CASE WHEN before > 0 THEN (before - users) * 1.0 / before ELSE 0 END END AS lost
    FROM (SELECT *, lag(users) OVER (ORDER BY step_order) AS before FROM funnel)"""


def _funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(funnel.funnel_conversion(tables.plain_events(spark, sf_dir), STEPS, DAY, DAY))


def _analyze_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(funnel.analyze_funnel(tables.plain_events(spark, sf_dir), STEPS, DAY, DAY)).drop("description")


def _funnel_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(funnel.funnel_ab_comparison(tables.plain_events(spark, sf_dir), STEPS, PERIOD_A, PERIOD_B))


def _funnel_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = funnel.funnel_diagnosis(tables.plain_events(spark, sf_dir), STEPS, AS_OF, DAY, DAY, inactive_days=1)
    steps = parts["funnel"].select(F.lit("funnel").alias("section"), F.col("step").alias("item"), "users", F.col("conversion_pct").alias("pct"))
    segments = parts["churn"].select(F.lit("churn").alias("section"), F.col("segment").alias("item"), "users", "pct")
    return report_types(steps.unionByName(segments))


def _funnel_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every preset over all events."""
    events = tables.plain_events(spark, sf_dir)
    result = None
    for name in funnel.PRESETS:
        part = funnel.funnel_conversion(events, name).withColumn("preset", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return report_types(result)


def _preset_sql() -> str:
    ctes, rows = {}, []
    for name, steps in funnel.PRESETS.items():
        ctes.update(_funnel_ctes(f"f_{name}", steps, None, None))
        rows.append(f"SELECT *, '{name}' AS preset FROM f_{name}")
    return with_tables("user_events", " UNION ALL ".join(rows), **ctes)


def _spend_and_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tables.marketing_spend(spark, sf_dir), tables.user_events(spark, sf_dir)


_CAC = f"""
    SELECT s.channel, CAST(s.total_spend AS DOUBLE) AS total_spend, coalesce(u.n, 0) AS users_acquired,
           {sql_ratio('s.total_spend', 'coalesce(u.n, 0)', 2)} AS cac
    FROM (SELECT channel, sum(spend) AS total_spend FROM marketing_spend GROUP BY 1) s
    LEFT JOIN (SELECT utm_source, count(DISTINCT user_id) AS n FROM user_events WHERE event_type = 'signup' GROUP BY 1) u
      ON s.channel = u.utm_source"""
_LTV = f"""
    SELECT channel, count(DISTINCT user_id) AS users, {sql_round('sum(CAST(revenue AS DOUBLE)) / count(revenue)', 2)} AS avg_ltv,
           {sql_round('sum(revenue)', 2)} AS total_revenue, {sql_round('avg(days)', 0)} AS avg_lifetime_days
    FROM (SELECT user_id, utm_source AS channel, sum(revenue) AS revenue,
                 date_diff('day', min(event_date), max(event_date)) AS days
          FROM user_events GROUP BY 1, 2) GROUP BY 1"""
_CAC_LTV = f"""
    SELECT c.*, l.avg_ltv, {sql_ratio('l.avg_ltv', 'c.cac', 2)} AS roas FROM cac c LEFT JOIN ltv l ON c.channel = l.channel"""


def _cac_ltv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return acquisition.compute_cac_ltv(*_spend_and_events(spark, sf_dir))


def _benchmark_case() -> str:
    whens = "".join(
        f" WHEN contains(clean, '{name}') OR contains('{name}', clean) THEN {{{name}}}" for name in CAC
    )
    return whens


def _benchmark_sql() -> str:
    def pick(values: dict[str, str]) -> str:
        return "CASE" + _benchmark_case().format(**values) + " END"

    return with_tables(
        "user_events marketing_spend",
        """SELECT channel, cac, benchmark, good, ok,
                  CASE WHEN benchmark IS NULL OR cac IS NULL THEN NULL WHEN cac <= good THEN 'Good' WHEN cac <= ok THEN 'Average'
                       ELSE 'Poor' END AS verdict FROM matched""",
        cac=_CAC,
        named="""SELECT *, replace(replace(lower(channel), ' ', '_'), '-', '_') AS clean FROM
                 (SELECT CASE channel WHEN 'automobile' THEN 'Google-Ads' WHEN 'building' THEN 'meta' WHEN 'machinery' THEN 'linkedin_b2b'
                         ELSE channel END AS channel, cac FROM cac)""",
        matched=f"""SELECT channel, cac, {pick({n: f"'{n}'" for n in CAC})} AS benchmark,
                    CAST({pick({n: str(v[0]) for n, v in CAC.items()})} AS DOUBLE) AS good,
                    CAST({pick({n: str(v[1]) for n, v in CAC.items()})} AS DOUBLE) AS ok FROM named""",
    )


def _benchmark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    cac = acquisition.cac_by_channel(*_spend_and_events(spark, sf_dir))
    channel = F.col("channel")
    named = cac.select(
        F.when(channel == "automobile", "Google-Ads")
        .when(channel == "building", "meta")
        .when(channel == "machinery", "linkedin_b2b")
        .otherwise(channel)
        .alias("channel"),
        "cac",
    )
    return report_types(adhoc.benchmark_join(named, "channel", "cac"))


def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    ltv = acquisition.ltv_by_channel(tables.user_events(spark, sf_dir))
    good, ok = F.lit(650.0), F.lit(600.0)
    return report_types(
        ltv.select(
            "channel",
            "avg_ltv",
            classify_metric(F.col("avg_ltv"), good, ok).alias("higher_is_better"),
            classify_metric(F.col("avg_ltv"), ok, good, higher_is_better=False).alias("lower_is_better"),
        )
    )


def _retention_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(retention.cohort_retention(tables.order_history(spark, sf_dir), "month"))


def _retention_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = tables.plain_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return report_types(retention.cohort_retention(purchases, "week"))


def _retention_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    cohorts = retention.cohort_retention(tables.order_history(spark, sf_dir), "month")
    return report_types(retention.retention_benchmark_verdict(cohorts, "month"))


def _retention_ctes(source: str, period: str) -> dict[str, str]:
    return {
        "cohorts": f"SELECT user_id, CAST(date_trunc('{period}', min(event_date)) AS DATE) AS cohort FROM {source} GROUP BY 1",
        "activity": f"""SELECT c.user_id, c.cohort,
              date_diff('{period}', c.cohort, CAST(date_trunc('{period}', e.event_date) AS DATE)) AS period_number
              FROM {source} e JOIN cohorts c USING (user_id)""",
        "sizes": "SELECT cohort, count(DISTINCT user_id) AS cohort_size FROM cohorts GROUP BY 1",
        "retention": f"""SELECT strftime(a.cohort, '%Y-%m-%d') AS cohort, s.cohort_size, a.period_number,
              count(DISTINCT a.user_id) AS active_users,
              {sql_round('100.0 * count(DISTINCT a.user_id) / s.cohort_size', 1)} AS retention_pct
              FROM activity a JOIN sizes s ON a.cohort = s.cohort GROUP BY a.cohort, s.cohort_size, a.period_number""",
    }


def lifecycle_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in which an error of at least 100 stands for a cancellation."""
    events = tables.read(spark, sf_dir, "events")
    cancelled = (F.col("event_type") == "error") & (F.col("value") >= 100)
    return events.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(cancelled, "cancel").otherwise(F.col("event_type")).alias("event_type"),
        F.to_date("ts").alias("event_date"),
    )


_LIFECYCLE = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(ts AS DATE) AS event_date,
    CASE WHEN event_type = 'error' AND value >= 100 THEN 'cancel' ELSE event_type END AS event_type FROM events"""
_PCT = sql_round("100.0 * count(*) / sum(count(*)) OVER ()", 1)


def _churn_inactivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    purchases = tables.plain_events(spark, sf_dir).filter(F.col("event_type") == "purchase")
    return report_types(churn.churn_inactivity(purchases, AS_OF, 6))


def _inactivity_sql(source: str, days: int) -> str:
    return f"""
    SELECT CASE WHEN d <= {max(days // 3, 1)} THEN 'Active' WHEN d <= {days} THEN 'At Risk' ELSE 'Churned' END AS segment,
           count(*) AS users, {_PCT} AS pct, {sql_round('avg(n)', 0)} AS avg_events, {sql_round('avg(d)', 0)} AS avg_days_inactive
    FROM (SELECT user_id, count(*) AS n, date_diff('day', max(event_date), DATE '{AS_OF}') AS d FROM {source} GROUP BY 1)
    GROUP BY 1"""


_PURCHASES = "(SELECT * FROM user_events WHERE event_type = 'purchase')"


def _churn_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(churn.churn_subscription(lifecycle_events(spark, sf_dir), "2024-02-15", "cancel"))


def _churn_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(churn.churn_event_based(lifecycle_events(spark, sf_dir), "cancel"))


def _analyze_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(churn.analyze_churn(tables.plain_events(spark, sf_dir), AS_OF, 1))


QUERIES = {
    "funnel_conversion": (
        _funnel,
        with_tables("user_events", "SELECT * FROM funnel", **_funnel_ctes("funnel", STEPS, DAY, DAY)),
    ),
    "analyze_funnel": (
        _analyze_funnel,
        with_tables(
            "user_events",
            """SELECT step, step_order, users, conversion_pct, drop_off_pct,
                      coalesce(step_order = (SELECT min_by(step_order, (-lost, step_order)) FROM analyzed WHERE step_order > 1), false)
                        AS is_worst_drop FROM analyzed""",
            **_funnel_ctes("funnel", STEPS, DAY, DAY),
            analyzed=_ANALYZED,
        ),
    ),
    "funnel_ab_comparison": (
        _funnel_ab,
        with_tables(
            "user_events",
            f"""SELECT step, step_order, users_a, users_b, {sql_round('ca', 1)} AS conversion_a_pct, {sql_round('cb', 1)} AS conversion_b_pct,
                       {sql_round('cb - ca', 1)} AS delta_pp,
                       CASE WHEN {sql_round('cb - ca', 1)} > 2 THEN 'improved' WHEN {sql_round('cb - ca', 1)} < -2 THEN 'regressed'
                            ELSE 'stable' END AS verdict
                FROM (SELECT a.step, a.step_order, a.users AS users_a, b.users AS users_b,
                             CASE WHEN fa > 0 THEN a.users * 100.0 / fa ELSE 0 END AS ca, CASE WHEN fb > 0 THEN b.users * 100.0 / fb ELSE 0 END AS cb
                      FROM fa_ a JOIN fb_ b USING (step_order), (SELECT users AS fa FROM fa_ WHERE step_order = 1),
                           (SELECT users AS fb FROM fb_ WHERE step_order = 1))""",
            **_funnel_ctes("fa_", STEPS, *PERIOD_A),
            **_funnel_ctes("fb_", STEPS, *PERIOD_B),
        ),
    ),
    "funnel_diagnosis": (
        _funnel_diagnosis,
        with_tables(
            "user_events",
            """SELECT 'funnel' AS section, step AS item, users, conversion_pct AS pct FROM analyzed
               UNION ALL SELECT 'churn', segment, users, pct FROM segments""",
            **_funnel_ctes("funnel", STEPS, DAY, DAY),
            analyzed=_ANALYZED,
            segments=_inactivity_sql("user_events", 1),
        ),
    ),
    "funnel_presets": (_funnel_presets, _preset_sql()),
    "cac_by_channel": (
        lambda spark, d: report_types(acquisition.cac_by_channel(*_spend_and_events(spark, d))),
        with_tables("user_events marketing_spend", _CAC),
    ),
    "ltv_by_channel": (
        lambda spark, d: report_types(acquisition.ltv_by_channel(tables.user_events(spark, d))),
        with_tables("user_events", _LTV),
    ),
    "compute_cac_ltv": (
        lambda spark, d: report_types(_cac_ltv(spark, d)),
        with_tables("user_events marketing_spend", _CAC_LTV, cac=_CAC, ltv=_LTV),
    ),
    "best_channels": (
        lambda spark, d: report_types(acquisition.best_channels(_cac_ltv(spark, d))),
        with_tables(
            "user_events marketing_spend",
            """SELECT a.channel AS best_cac_channel, a.cac AS best_cac, b.channel AS best_roas_channel, b.roas AS best_roas
               FROM (SELECT * FROM both_ WHERE cac IS NOT NULL ORDER BY cac, channel LIMIT 1) a,
                    (SELECT * FROM both_ WHERE roas IS NOT NULL ORDER BY roas DESC, channel LIMIT 1) b""",
            cac=_CAC,
            ltv=_LTV,
            both_=_CAC_LTV,
        ),
    ),
    "channel_efficiency_review": (
        lambda spark, d: report_types(acquisition.channel_efficiency_review(*_spend_and_events(spark, d))).drop("cac_verdict"),
        with_tables(
            "user_events marketing_spend",
            """SELECT *, CASE WHEN roas >= 3.0 THEN 'Invest' WHEN roas >= 1.5 THEN 'Watch' WHEN roas IS NOT NULL THEN 'Cut' END AS signal
               FROM both_""",
            cac=_CAC,
            ltv=_LTV,
            both_=_CAC_LTV,
        ),
    ),
    "benchmark_join": (_benchmark_join, _benchmark_sql()),
    "classify_metric": (
        _classify,
        with_tables(
            "user_events",
            """SELECT channel, avg_ltv,
                      CASE WHEN avg_ltv >= 650 THEN 'Good' WHEN avg_ltv >= 600 THEN 'Average' ELSE 'Poor' END AS higher_is_better,
                      CASE WHEN avg_ltv <= 600 THEN 'Good' WHEN avg_ltv <= 650 THEN 'Average' ELSE 'Poor' END AS lower_is_better
               FROM ltv""",
            ltv=_LTV,
        ),
    ),
    "cohort_retention": (
        _retention_month,
        with_tables("order_history", "SELECT * FROM retention", **_retention_ctes("order_history", "month")),
    ),
    "cohort_retention_week": (
        _retention_week,
        with_tables("user_events", "SELECT * FROM retention", **_retention_ctes(_PURCHASES, "week")),
    ),
    "retention_benchmark_verdict": (
        _retention_verdict,
        with_tables(
            "order_history",
            f"""SELECT 'month' AS period, {sql_round('a', 1)} AS avg_retention_pct, CAST(45 AS DOUBLE) AS benchmark_pct, a > 45 AS above_benchmark,
                       CASE WHEN a >= 45 THEN 'Good' WHEN a >= 30 THEN 'Average' ELSE 'Poor' END AS verdict
                FROM (SELECT avg(retention_pct) AS a FROM retention WHERE period_number = 1)""",
            **_retention_ctes("order_history", "month"),
        ),
    ),
    "churn_inactivity": (_churn_inactivity, with_tables("user_events", _inactivity_sql(_PURCHASES, 6))),
    "churn_subscription": (
        _churn_subscription,
        with_tables(
            "",
            f"""SELECT CASE WHEN c.at IS NULL THEN 'Active' WHEN date_diff('day', c.at, DATE '2024-02-15') <= 30 THEN 'Recently Cancelled'
                            ELSE 'Churned' END AS segment, count(*) AS users, {_PCT} AS pct
                FROM (SELECT DISTINCT user_id FROM lifecycle) u
                LEFT JOIN (SELECT user_id, max(event_date) AS at FROM lifecycle WHERE event_type = 'cancel' GROUP BY 1) c USING (user_id)
                GROUP BY 1""",
            lifecycle=_LIFECYCLE,
        ),
    ),
    "churn_event_based": (
        _churn_event,
        with_tables(
            "",
            f"""SELECT CASE WHEN c.user_id IS NULL THEN 'Active' ELSE 'Churned' END AS segment, count(*) AS users, {_PCT} AS pct,
                       {sql_round("avg(date_diff('day', u.a, u.b))", 0)} AS avg_lifetime_days
                FROM (SELECT user_id, min(event_date) AS a, max(event_date) AS b FROM lifecycle GROUP BY 1) u
                LEFT JOIN (SELECT DISTINCT user_id FROM lifecycle WHERE event_type = 'cancel') c ON u.user_id = c.user_id GROUP BY 1""",
            lifecycle=_LIFECYCLE,
        ),
    ),
    "analyze_churn": (
        _analyze_churn,
        with_tables(
            "user_events",
            """SELECT *, CASE segment WHEN 'Churned' THEN format('{:,} users ({:.1f}%) churned', users, pct)
                                      WHEN 'At Risk' THEN format('{:,} users ({:.1f}%) at risk', users, pct) ELSE '' END AS headline
               FROM segments""",
            segments=_inactivity_sql("user_events", 1),
        ),
    ),
}
