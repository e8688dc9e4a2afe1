"""Period-over-period summaries and the reviews composed from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike, before, since, since_both
from tidemark.functions.numeric import change_pct, count_if, ratio, rounded, sum_if
from tidemark.operators.acquisition import best_channels, compute_cac_ltv
from tidemark.operators.anomaly import detect_anomalies


# Texts of the summaries.
NO_WINS, NO_RISKS = "No major wins detected.", "No major risks detected."
GREW, DECLINED, NO_PRIOR = " grew %+.1f%% to ", " declined %+.1f%% to ", " (no prior period for comparison)"


def _periods(date_col: str, as_of: DateLike, days: int) -> tuple[Column, Column]:
    """Conditions of the current and the previous period."""
    return since(F.col(date_col), as_of, days), before(F.col(date_col), as_of, days)


def _sums(metrics: dict[str, Column], current: Column, previous: Column) -> list[Column]:
    """Both periods' sums of each metric, as columns of one aggregation."""
    columns = []
    for name, value in metrics.items():
        columns.append(sum_if(current, value).alias(f"current_{name}"))
        columns.append(sum_if(previous, value).alias(f"previous_{name}"))
    return columns


def _metric_rows(totals: DataFrame, metrics: dict[str, str], orders: Sequence[int] | None = None) -> DataFrame:
    """``metric_order, metric, current_value, previous_value, change_pct`` from a one-row frame."""
    rows = [
        F.struct(
            F.lit(order).alias("metric_order"),
            F.lit(label).alias("metric"),
            F.col(f"current_{name}").cast("double").alias("current_value"),
            F.col(f"previous_{name}").cast("double").alias("previous_value"),
            change_pct(F.col(f"current_{name}"), F.col(f"previous_{name}")).alias("change_pct"),
        )
        for order, (name, label) in zip(orders or range(1, len(metrics) + 1), metrics.items())
    ]
    return totals.select(F.inline(F.array(*rows)))


def growth_summary(spend: DataFrame, events: DataFrame, as_of: DateLike, days: int = 7) -> DataFrame:
    """Revenue, Spend, Conversions and Active Users of the last ``days`` days and those before.

    One scan per table. Users are reduced to one row each, which yields the
    distinct users of both periods from one shuffle.
    """
    current, previous = _periods("date", as_of, days)
    spend_totals = spend.filter(since_both(F.col("date"), as_of, days)).agg(
        *_sums({"spend": F.col("spend"), "conversions": F.col("conversions")}, current, previous)
    )
    current, previous = _periods("event_date", as_of, days)
    users = (
        events.filter(since_both(F.col("event_date"), as_of, days))
        .groupBy("user_id")
        .agg(
            F.max(F.when(current, 1).otherwise(0)).alias("now"),
            F.max(F.when(previous, 1).otherwise(0)).alias("then"),
            *_sums({"revenue": F.col("revenue")}, current, previous),
        )
    )
    known = F.col("user_id").isNotNull()
    event_totals = users.agg(
        F.coalesce(F.sum("current_revenue"), F.lit(0)).alias("current_revenue"),
        F.coalesce(F.sum("previous_revenue"), F.lit(0)).alias("previous_revenue"),
        count_if(known & (F.col("now") == 1)).alias("current_users"),
        count_if(known & (F.col("then") == 1)).alias("previous_users"),
    )
    of_events = _metric_rows(event_totals, {"revenue": "Revenue", "users": "Active Users"}, (1, 4))
    return of_events.unionByName(
        _metric_rows(spend_totals, {"spend": "Spend", "conversions": "Conversions"}, (2, 3))
    )


def _listed(condition: Column, text: Column) -> Column:
    """Aggregate over a handful of metric rows: the texts that apply, in metric order."""
    items = F.array_sort(F.collect_list(F.when(condition, F.struct(F.col("metric_order"), text.alias("text")))))
    return F.array_join(F.transform(items, lambda item: item["text"]), ", ")


def weekly_growth_review(spend: DataFrame, events: DataFrame, as_of: DateLike) -> DataFrame:
    """Metrics that rose and fell, spend anomalies of 30 days and the lowest-CAC channel."""
    summary = growth_summary(spend, events, as_of)
    anomalies = detect_anomalies(spend, "spend", as_of).agg(F.count(F.lit(1)).alias("n"))
    best = best_channels(compute_cac_ltv(spend, events)).select("best_cac_channel")
    return summary.agg(
        _listed(F.col("change_pct") > 0, F.col("metric")).alias("positive_movement"),
        _listed(F.col("change_pct") < 0, F.col("metric")).alias("negative_movement"),
    ).select("*", anomalies.scalar().alias("anomalies"), best.scalar().alias("lowest_cac_channel"))


def executive_summary(summary: DataFrame) -> DataFrame:
    """Wins and risks of a growth summary, each metric with its change."""
    text = F.format_string("%s %+.1f%%", F.col("metric"), F.col("change_pct"))
    wins, risks = _listed(F.col("change_pct") > 0, text), _listed(F.col("change_pct") < 0, text)
    return summary.agg(wins.alias("wins"), risks.alias("risks")).select(
        F.coalesce(F.nullif("wins", F.lit("")), F.lit(NO_WINS)).alias("wins"),
        F.coalesce(F.nullif("risks", F.lit("")), F.lit(NO_RISKS)).alias("risks"),
    )


def narrative_growth_review(summary: DataFrame) -> DataFrame:
    """One sentence per metric, rises first, then falls, then metrics without a prior value.

    ``tone`` is mixed when metrics both rose and fell, positive when some rose
    and none fell, else pressure.
    """
    change, value = F.col("change_pct"), F.format_number("current_value", 0)
    sentence = (
        F.when(change.isNull(), F.concat("metric", F.lit(" is "), value, F.lit(NO_PRIOR)))
        .when(change > 0, F.concat("metric", F.format_string(GREW, change), value))
        .otherwise(F.concat("metric", F.format_string(DECLINED, change), value))
    )
    group = F.when(change.isNull(), 3).when(change > 0, 1).otherwise(2)
    lines = F.array_sort(F.collect_list(F.struct(group.alias("g"), F.col("metric_order"), sentence.alias("text"))))
    rose, fell = F.max(F.coalesce(change > 0, F.lit(False))), F.max(F.coalesce(change <= 0, F.lit(False)))
    return summary.agg(lines.alias("lines"), rose.alias("rose"), fell.alias("fell")).select(
        F.when(F.col("rose") & F.col("fell"), "mixed").when(F.col("rose"), "positive").otherwise("pressure").alias("tone"),
        F.posexplode(F.transform("lines", lambda line: line["text"])).alias("position", "finding"),
    )


def weekly_report(spend: DataFrame, events: DataFrame, as_of: DateLike) -> DataFrame:
    """The growth summary and the distinct sign-ups and purchasers of the last 7 days."""
    users = (
        events.filter(since(F.col("event_date"), as_of, 7) & F.col("event_type").isin("signup", "purchase"))
        .groupBy("user_id")
        .agg(
            F.max(F.when(F.col("event_type") == "signup", 1).otherwise(0)).alias("signed_up"),
            F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("purchased"),
        )
        .filter(F.col("user_id").isNotNull())
    )
    activity = users.agg(
        count_if(F.col("signed_up") == 1).alias("signups"), count_if(F.col("purchased") == 1).alias("purchasers")
    )
    rows = [
        F.struct(
            F.lit(order).alias("metric_order"),
            F.lit(label).alias("metric"),
            F.col(name).cast("double").alias("current_value"),
            F.lit(None).cast("double").alias("previous_value"),
            F.lit(None).cast("double").alias("change_pct"),
        )
        for order, name, label in ((5, "signups", "Signups"), (6, "purchasers", "Purchasers"))
    ]
    return growth_summary(spend, events, as_of).unionByName(activity.select(F.inline(F.array(*rows))))


def paid_growth_review(spend: DataFrame, invoices: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Paid spend, clicks, impressions and conversions against paid invoice revenue, with blended MER."""
    current, previous = _periods("date", as_of, days)
    names = ("spend", "clicks", "impressions", "conversions")
    paid = spend.filter(since_both(F.col("date"), as_of, days)).agg(*_sums({n: F.col(n) for n in names}, current, previous))
    revenue = stripe_revenue_totals(invoices, as_of, days).select(
        F.struct(F.col("current_revenue").alias("now"), F.col("previous_revenue").alias("then"))
    )
    totals = paid.withColumn("revenue", revenue.scalar()).select(
        *paid.columns, F.col("revenue.now").alias("current_revenue"), F.col("revenue.then").alias("previous_revenue")
    )
    return totals.withColumn("mer_current", ratio(F.col("current_revenue"), F.col("current_spend"), 2)).withColumn(
        "mer_previous", ratio(F.col("previous_revenue"), F.col("previous_spend"), 2)
    )


def paid_channel_mix(spend: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Spend, clicks, impressions and conversions per channel over the last ``days`` days."""
    return (
        spend.filter(since(F.col("date"), as_of, days))
        .groupBy("channel")
        .agg(
            rounded(F.sum("spend"), 2).alias("spend_30d"),
            F.sum("clicks").alias("clicks_30d"),
            F.sum("impressions").alias("impressions_30d"),
            F.sum("conversions").cast("double").alias("conversions_30d"),
        )
    )


def _ads_summary(spend: DataFrame, as_of: DateLike, days: int, metrics: dict[str, str]) -> DataFrame:
    current, previous = _periods("date", as_of, days)
    totals = spend.filter(since_both(F.col("date"), as_of, days)).agg(*_sums({n: F.col(n) for n in metrics}, current, previous))
    return _metric_rows(totals, metrics)


def meta_ads_summary(spend: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Spend, clicks and impressions, current against previous period."""
    return _ads_summary(spend, as_of, days, {"spend": "Spend", "clicks": "Clicks", "impressions": "Impressions"})


def google_ads_summary(spend: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Spend, clicks, impressions and conversions, current against previous period."""
    metrics = {"spend": "Spend", "clicks": "Clicks", "impressions": "Impressions", "conversions": "Conversions"}
    return _ads_summary(spend, as_of, days, metrics)


def stripe_revenue_totals(invoices: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """One row: revenue and number of paid invoices of both periods."""
    current, previous = _periods("created", as_of, days)
    paid = invoices.filter((F.col("status") == "paid") & since_both(F.col("created"), as_of, days))
    return paid.agg(
        *_sums({"revenue": F.col("amount_paid")}, current, previous),
        count_if(current).alias("current_invoices"),
        count_if(previous).alias("previous_invoices"),
    )


def stripe_revenue_summary(invoices: DataFrame, as_of: DateLike, days: int = 30) -> DataFrame:
    """Revenue and paid invoices with their change."""
    return _metric_rows(
        stripe_revenue_totals(invoices, as_of, days), {"revenue": "Revenue", "invoices": "Paid invoices"}
    )


def _counts_with_share(table: DataFrame, column: str, count_name: str) -> DataFrame:
    counts = table.groupBy(column).agg(F.count(F.lit(1)).alias(count_name))
    total = counts.agg(F.sum(count_name).alias("total"))
    return counts.withColumn("total", total.scalar()).select(
        column, count_name, F.coalesce(rounded(F.col(count_name) * 100.0 / F.col("total"), 1), F.lit(0.0)).alias("share_pct")
    )


def hubspot_contacts_summary(contacts: DataFrame) -> DataFrame:
    """Contacts and share per lifecycle stage."""
    return _counts_with_share(contacts, "lifecycle_stage", "contacts")


def mixpanel_events_summary(events: DataFrame) -> DataFrame:
    """Events and share per event name."""
    return _counts_with_share(events, "event", "events")


def amplitude_events_summary(events: DataFrame, top_countries: int | None = None) -> dict[str, DataFrame]:
    """Events by type with share, by device, and by country with most events first (all, or the ``top_countries``)."""
    countries = (
        events.groupBy("country").agg(F.count(F.lit(1)).alias("events")).orderBy(F.desc("events"), F.asc_nulls_last("country"))
    )
    return {
        "by_type": _counts_with_share(events, "event_type", "events"),
        "by_device": events.groupBy("device_type").agg(F.count(F.lit(1)).alias("events")),
        "top_countries": countries if top_countries is None else countries.limit(int(top_countries)),
    }
