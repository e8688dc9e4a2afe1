"""Queries on revenue attribution, anomalies, drift and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.export import report_types
from tidemark.operators import anomaly, channels, forecast
from tidemark.plans import canonical as tables
from tidemark.plans.canonical import AS_OF, sql_ratio, sql_round, with_tables

HORIZON = 14


def _channel_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend, events = tables.marketing_spend(spark, sf_dir), tables.user_events(spark, sf_dir)
    return report_types(channels.channel_attribution(spend, events))


def _shapley(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(channels.shapley_attribution(tables.touches(spark, sf_dir)))


def _shapley_two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys from the events, revenue from the users' orders."""
    orders = tables.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("revenue")
    )
    return report_types(channels.shapley_attribution(tables.touches(spark, sf_dir), orders))


def _touch_sql(direction: str) -> str:
    return with_tables(
        "touches",
        f"""SELECT channel, count(*) AS converters, {sql_round('sum(revenue)', 2)} AS attributed_revenue
            FROM (SELECT user_id, revenue, (SELECT t.channel FROM touches t WHERE t.user_id = u.user_id
                                            ORDER BY t.ts {direction}, t.event_id {direction} LIMIT 1) AS channel
                  FROM (SELECT user_id, sum(revenue) AS revenue FROM touches GROUP BY 1 HAVING sum(revenue) > 0) u)
            GROUP BY 1""",
    )


def _shapley_sql(revenue: str) -> str:
    return with_tables(
        "touches",
        f"""SELECT channel, {sql_round('value', 2)} AS attributed_revenue, {sql_round('value * 100.0 / (SELECT sum(value) FROM totals)', 1)} AS pct
            FROM totals""",
        revenues=revenue,
        freq="SELECT user_id, channel, count(*) AS n FROM touches GROUP BY 1, 2",
        shares=f"""SELECT f.channel, CASE WHEN count(*) OVER w > 1
                     THEN {sql_round('CAST(r.revenue AS DOUBLE) * f.n / sum(f.n) OVER w', 4)} ELSE CAST(r.revenue AS DOUBLE) END AS value
                   FROM freq f JOIN revenues r USING (user_id) WHERE r.revenue > 0 WINDOW w AS (PARTITION BY f.user_id)""",
        totals="SELECT channel, sum(value) AS value FROM shares GROUP BY 1",
    )


_Z = sql_round("(CAST(daily_value AS DOUBLE) - mean_val) / std_val", 2)


def anomaly_ctes(source: str, metric: str, date_col: str, days: int) -> dict[str, str]:
    """Anomalies step by step, in ``anomalies``."""
    return {
        "daily": f"""SELECT {date_col} AS date, sum({metric}) AS daily_value FROM {source}
                     WHERE {date_col} >= DATE '{AS_OF}' - {days} GROUP BY 1""",
        "stats": "SELECT sum(CAST(daily_value AS DOUBLE)) / count(*) AS mean_val, stddev_samp(CAST(daily_value AS DOUBLE)) AS std_val FROM daily",
        "scored": f"SELECT *, CASE WHEN std_val > 0 THEN {_Z} ELSE 0 END AS z_score FROM daily, stats",
        "anomalies": f"""SELECT strftime(date, '%Y-%m-%d') AS date, CAST(daily_value AS DOUBLE) AS daily_value,
              {sql_round('mean_val', 2)} AS avg_value, z_score,
              CASE WHEN z_score > 2 THEN 'Spike' WHEN z_score < -2 THEN 'Drop' WHEN z_score > 1.5 THEN 'Elevated' ELSE 'Below Normal' END AS status
              FROM scored WHERE abs(z_score) > 1.5""",
    }


def _events_with_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "events").select(
        F.to_date("ts").alias("event_date"), F.col("value").cast("decimal(18,2)").alias("value")
    )


_VALUES = "SELECT CAST(ts AS DATE) AS event_date, CAST(value AS DECIMAL(18,2)) AS value FROM events"


def _anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(anomaly.detect_anomalies(_events_with_value(spark, sf_dir), "value", AS_OF, "event_date"))


def _spend_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(anomaly.detect_anomalies(tables.plain_spend(spark, sf_dir), "spend", AS_OF, lookback_days=60))


def _explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = anomaly.detect_anomalies(_events_with_value(spark, sf_dir), "value", AS_OF, "event_date")
    return report_types(anomaly.anomaly_explanation(found)).drop("hypothesis")


def _drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(anomaly.detect_data_drift(_events_with_value(spark, sf_dir), "value", AS_OF, "event_date"))


def _drift_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events_with_value(spark, sf_dir)
    return report_types(anomaly.drift_alert(events, "value", AS_OF, "event_date", threshold_pct=0.5))


def _drift_ctes(days: int) -> dict[str, str]:
    def period(name: str, where: str) -> str:
        return f"""SELECT '{name}' AS period, {sql_round('sum(CAST(value AS DOUBLE)) / count(value)', 4)} AS avg_val,
                   {sql_round('sum(value)', 4)} AS total_val, count(*) AS n_rows FROM vals WHERE {where}"""

    now, then = f"event_date >= DATE '{AS_OF}' - {days}", f"event_date >= DATE '{AS_OF}' - {2 * days} AND event_date < DATE '{AS_OF}' - {days}"
    return {
        "vals": _VALUES,
        "cur": period("current", now),
        "prev": period("previous", then),
        "change": """SELECT (c.avg_val - p.avg_val) / p.avg_val * 100 AS a, (c.total_val - p.total_val) / p.total_val * 100 AS t,
                     c.avg_val AS ca, p.avg_val AS pa FROM cur c, prev p""",
    }


def _forecast(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = tables.plain_events(spark, sf_dir)
        return report_types(forecast.forecast_metric(events, "revenue", AS_OF, "event_date", HORIZON, method))

    return run


def _forecast_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = tables.marketing_spend(spark, sf_dir)
    return report_types(forecast.forecast_linear(forecast.daily_totals(spend, "spend", AS_OF, keys=["channel"]), HORIZON, ["channel"]))


def _smoothing_by_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = tables.marketing_spend(spark, sf_dir)
    daily = forecast.daily_totals(spend, "spend", AS_OF, keys=["channel"])
    return report_types(forecast.forecast_exponential(daily, HORIZON, ["channel"]))


def _trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.plain_events(spark, sf_dir)
    outlook = forecast.forecast_metric(events, "revenue", AS_OF, "event_date", HORIZON)
    return report_types(forecast.with_trend(outlook))


def _kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend, events = tables.plain_spend(spark, sf_dir), tables.plain_events(spark, sf_dir)
    return report_types(forecast.forecast_growth_kpis(spend, events, AS_OF, 30))


def linear_ctes(series: str, horizon: int) -> dict[str, str]:
    """A line through each series of ``(key, date, value)``, in ``linear``."""
    return {
        "series": series,
        "indexed": "SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY date) - 1 AS x FROM series",
        "means": "SELECT key, count(*) AS n, avg(x) AS mx, sum(value) / count(*) AS my FROM indexed GROUP BY 1",
        "slopes": """SELECT key, any_value(m.n) AS n, any_value(m.mx) AS mx, any_value(m.my) AS my, sum((x - mx) * (value - my)) / sum((x - mx) * (x - mx)) AS slope
                     FROM indexed i JOIN means m USING (key) GROUP BY key""",
        "lines": """SELECT key, any_value(n) AS n, any_value(slope) AS slope, any_value(my - slope * mx) AS start,
                    sqrt(sum(pow(value - (my - slope * mx) - slope * x, 2)) / greatest(any_value(n) - 2, 1)) AS spread
                    FROM indexed i JOIN slopes s USING (key) GROUP BY key""",
        "linear": f"""SELECT key, CAST(h AS BIGINT) AS day_offset, {sql_round('p', 2)} AS value, {sql_round('greatest(p - spread, 0)', 2)} AS lower, {sql_round('p + spread', 2)} AS upper
                      FROM (SELECT key, spread, h, greatest(start + slope * (n + h - 1), 0) AS p FROM lines, range(1, {horizon + 1}) t(h))""",
    }


def _smoothing_ctes(series: str, horizon: int) -> dict[str, str]:
    """Smoothed levels day by day through a recursive CTE, in ``smooth``."""
    return {
        "series": series,
        "indexed": "SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY date) AS i FROM series",
        "levels": """SELECT key, i, value, value AS level FROM indexed WHERE i = 1
                     UNION ALL SELECT x.key, x.i, x.value, 0.3 * x.value + 0.7 * l.level FROM levels l JOIN indexed x ON x.key = l.key AND x.i = l.i + 1""",
        "last_level": """SELECT key, max_by(level, i) AS level, coalesce(sum(CASE WHEN i > 1 THEN abs(level - value) END) / nullif(count(*) - 1, 0), 0) AS spread
                         FROM levels GROUP BY 1""",
        "smooth": f"""SELECT key, CAST(h AS BIGINT) AS day_offset, {sql_round('level', 2)} AS value, {sql_round('greatest(level - spread, 0)', 2)} AS lower,
                      {sql_round('level + spread', 2)} AS upper FROM last_level, range(1, {horizon + 1}) t(h)""",
    }


_REVENUE_SERIES = f"""SELECT 'all' AS key, event_date AS date, CAST(sum(revenue) AS DOUBLE) AS value FROM user_events
    WHERE event_date >= DATE '{AS_OF}' - 90 GROUP BY 2"""
_SPEND_SERIES = f"""SELECT channel AS key, date, CAST(sum(spend) AS DOUBLE) AS value FROM marketing_spend
    WHERE date >= DATE '{AS_OF}' - 90 GROUP BY 1, 2"""
_KPI_SERIES = f"""SELECT 'Daily Spend' AS key, date, CAST(sum(spend) AS DOUBLE) AS value FROM marketing_spend WHERE date >= DATE '{AS_OF}' - 90 GROUP BY 2
    UNION ALL SELECT 'Daily Active Users', event_date, CAST(count(DISTINCT user_id) AS DOUBLE) FROM user_events WHERE event_date >= DATE '{AS_OF}' - 90 GROUP BY 2"""
_POINTS = "day_offset, value, lower, upper"


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "channel_attribution": (
        _channel_attribution,
        with_tables(
            "user_events marketing_spend",
            f"""SELECT channel, CAST(spend AS DOUBLE) AS spend, conversions, CAST(revenue AS DOUBLE) AS revenue, {sql_ratio('revenue', 'spend', 2)} AS roas,
                       coalesce({sql_ratio('revenue * 100.0', '(SELECT sum(revenue) FROM joined)', 1)}, 0.0) AS revenue_share_pct FROM joined""",
            s="SELECT channel, sum(spend) AS spend FROM marketing_spend GROUP BY 1",
            r="""SELECT utm_source AS channel, count(DISTINCT user_id) AS conversions, sum(revenue) AS revenue
                 FROM user_events WHERE event_type = 'purchase' GROUP BY 1""",
            joined="""SELECT coalesce(s.channel, r.channel) AS channel, coalesce(spend, 0) AS spend, coalesce(conversions, 0) AS conversions,
                      coalesce(revenue, 0) AS revenue FROM s FULL JOIN r ON s.channel = r.channel""",
        ),
    ),
    "shapley_attribution": (_shapley, _shapley_sql("SELECT user_id, sum(revenue) AS revenue FROM touches GROUP BY 1")),
    "shapley_with_order_revenue": (
        _shapley_two_tables,
        _shapley_sql("SELECT CAST(o_custkey AS VARCHAR) AS user_id, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1"),
    ),
    "first_touch": (
        lambda spark, d: report_types(channels.first_touch(tables.touches(spark, d), ("ts", "event_id"))),
        _touch_sql("ASC"),
    ),
    "last_touch": (
        lambda spark, d: report_types(channels.last_touch(tables.touches(spark, d), ("ts", "event_id"))),
        _touch_sql("DESC"),
    ),
    "detect_anomalies": (
        _anomalies,
        with_tables("", "SELECT * FROM anomalies", vals=_VALUES, **anomaly_ctes("vals", "value", "event_date", 30)),
    ),
    "detect_spend_anomalies": (
        _spend_anomalies,
        with_tables("marketing_spend", "SELECT * FROM anomalies", **anomaly_ctes("marketing_spend", "spend", "date", 60)),
    ),
    "anomaly_explanation": (
        _explanation,
        with_tables(
            "",
            """SELECT status, count(*) AS days, min(date) AS first_date, max(date) AS last_date FROM anomalies
               WHERE status IN ('Spike', 'Drop') GROUP BY 1""",
            vals=_VALUES,
            **anomaly_ctes("vals", "value", "event_date", 30),
        ),
    ),
    "detect_data_drift": (
        _drift,
        with_tables(
            "",
            f"""SELECT p.*, {sql_round('a', 1)} AS avg_change_pct, {sql_round('t', 1)} AS total_change_pct, abs(t) > 20 AS needs_review
                FROM (SELECT * FROM cur UNION ALL SELECT * FROM prev) p, change""",
            **_drift_ctes(7),
        ),
    ),
    "drift_alert": (
        _drift_alert,
        with_tables(
            "",
            f"""SELECT 'value' AS metric, '{AS_OF}' AS as_of, CAST(7 AS BIGINT) AS lookback_days, ca AS current_avg, pa AS previous_avg,
                       {sql_round('a', 2)} AS change_pct, CASE WHEN a > 0 THEN 'up' ELSE 'down' END AS direction FROM change WHERE abs(a) >= 0.5""",
            **_drift_ctes(7),
        ),
    ),
    "forecast_linear": (
        _forecast_by_channel,
        with_tables("marketing_spend", f"SELECT key AS channel, {_POINTS} FROM linear", **linear_ctes(_SPEND_SERIES, HORIZON)),
    ),
    "forecast_exponential": (
        _smoothing_by_channel,
        _recursive(
            with_tables("marketing_spend", f"SELECT key AS channel, {_POINTS} FROM smooth", **_smoothing_ctes(_SPEND_SERIES, HORIZON))
        ),
    ),
    "forecast_metric": (
        _forecast("linear"),
        with_tables("user_events", f"SELECT {_POINTS} FROM linear", **linear_ctes(_REVENUE_SERIES, HORIZON)),
    ),
    "forecast_metric_exponential": (
        _forecast("exponential"),
        _recursive(with_tables("user_events", f"SELECT {_POINTS} FROM smooth", **_smoothing_ctes(_REVENUE_SERIES, HORIZON))),
    ),
    "forecast_trend": (
        _trend,
        with_tables(
            "user_events",
            """SELECT a AS first_value, b AS last_value, CASE WHEN b > a * 1.02 THEN 'Up' WHEN b < a * 0.98 THEN 'Down' ELSE 'Flat' END AS trend
               FROM (SELECT min_by(value, day_offset) AS a, max_by(value, day_offset) AS b FROM linear)""",
            **linear_ctes(_REVENUE_SERIES, HORIZON),
        ),
    ),
    "forecast_growth_kpis": (
        _kpis,
        with_tables(
            "user_events marketing_spend",
            f"""SELECT key AS kpi, {sql_round('w.total / 7', 2)} AS current_avg, b AS forecast,
                       CASE WHEN b > a * 1.02 THEN 'Up' WHEN b < a * 0.98 THEN 'Down' ELSE 'Flat' END AS trend,
                       CASE WHEN key = 'Daily Active Users' THEN (SELECT {sql_round('avg(value)', 2)} FROM series WHERE key = 'Daily Active Users' AND date >= DATE '{AS_OF}' - 7) END AS avg_daily_users
                FROM (SELECT key, min_by(value, day_offset) AS a, max_by(value, day_offset) AS b FROM linear GROUP BY 1) JOIN week w USING (key)""",
            **linear_ctes(_KPI_SERIES, 30),
            week=f"""SELECT 'Daily Spend' AS key, CAST(sum(spend) AS DOUBLE) AS total FROM marketing_spend WHERE date >= DATE '{AS_OF}' - 7
                     UNION ALL SELECT 'Daily Active Users', CAST(count(DISTINCT user_id) AS DOUBLE) FROM user_events WHERE event_date >= DATE '{AS_OF}' - 7""",
        ),
    ),
}
