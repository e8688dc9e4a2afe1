"""Summaries, paid media and campaigns with amounts worked out by hand."""

from __future__ import annotations

import pytest

from tests.conftest import day
from tidemark.operators import campaigns, reports

AS_OF = "2026-03-12"


@pytest.fixture
def paid(spend_rows):
    meta = spend_rows(
        ("2026-03-05", "meta_ads", "cmp_1", "Prospecting", 150.0, 10000, 320, 12.0),
        ("2026-02-05", "meta_ads", "cmp_2", "Retargeting", 100.0, 7000, 210, 8.0),
    )
    google = spend_rows(
        ("2026-03-06", "google_ads", "111", "Brand Search", 185.0, 12000, 640, 28.5),
        ("2026-02-10", "google_ads", "222", "Nonbrand Search", 214.5, 18000, 710, 31.0),
    )
    return campaigns.spend_union({"meta_marketing_spend": meta, "google_marketing_spend": google})


def invoices(spark):
    rows = [("in_1", "paid", 900.0, day("2026-03-02")), ("in_2", "paid", 600.0, day("2026-02-08")), ("in_3", "open", 50.0, day("2026-03-02"))]
    return spark.createDataFrame(rows, "invoice_id string, status string, amount_paid double, created date")


def test_paid_growth_review(spark, paid):
    row = reports.paid_growth_review(paid, invoices(spark), AS_OF).first()
    assert (row.current_spend, row.previous_spend) == (549.5, 100.0)
    assert (row.current_revenue, row.previous_revenue) == (900.0, 600.0)
    assert (row.mer_current, row.mer_previous) == (1.64, 6.0)
    assert (row.current_clicks, row.current_conversions) == (1670, 71.5)
    mix = {r.channel: (r.spend_30d, r.conversions_30d) for r in reports.paid_channel_mix(paid, AS_OF).collect()}
    assert mix == {"meta_ads": (150.0, 12.0), "google_ads": (399.5, 59.5)}
    assert {r.source_table for r in paid.collect()} == {"meta_marketing_spend", "google_marketing_spend"}


def test_platform_summaries(spark, paid):
    meta = {r.metric: (r.current_value, r.previous_value) for r in reports.meta_ads_summary(paid.filter("channel = 'meta_ads'"), AS_OF).collect()}
    assert meta == {"Spend": (150.0, 100.0), "Clicks": (320.0, 210.0), "Impressions": (10000.0, 7000.0)}
    google = {r.metric: r.current_value for r in reports.google_ads_summary(paid.filter("channel = 'google_ads'"), AS_OF).collect()}
    assert google == {"Spend": 399.5, "Clicks": 1350.0, "Impressions": 30000.0, "Conversions": 59.5}
    stripe = {r.metric: (r.current_value, r.previous_value, r.change_pct) for r in reports.stripe_revenue_summary(invoices(spark), AS_OF).collect()}
    assert stripe == {"Revenue": (900.0, 600.0, 50.0), "Paid invoices": (1.0, 1.0, 0.0)}


def test_campaign_review(spend_rows):
    spend = spend_rows(
        ("2026-03-05", "meta_ads", "cmp_1", "Prospecting", 150.0, 10000, 320, 12.0),
        ("2026-03-04", "meta_ads", "cmp_2", "Retargeting", 90.0, 5000, 120, 0.0),
        ("2026-02-05", "meta_ads", "cmp_2", "Retargeting", 50.0, 3000, 95, 4.0),
        ("2026-03-06", "google_ads", "111", "Brand Search", 185.0, 12000, 640, 28.5),
        ("2026-03-03", "google_ads", "222", "Nonbrand Search", 110.0, 9500, 310, 6.0),
        ("2026-02-08", "google_ads", "222", "Nonbrand Search", 70.0, 5000, 200, 7.0),
        ("2025-01-01", "google_ads", "333", "Old", 70.0, 5000, 200, 7.0),
    )
    performance = campaigns.campaign_performance(spend, AS_OF)
    rows = {r.campaign: r for r in performance.collect()}
    assert rows.keys() == {"Prospecting", "Retargeting", "Brand Search", "Nonbrand Search"}
    assert (rows["Brand Search"].current_cpa, rows["Brand Search"].current_cpc, rows["Brand Search"].current_ctr) == (6.49, 0.29, 5.33)
    assert (rows["Nonbrand Search"].spend_change_pct, rows["Retargeting"].current_cpa) == (57.1, None)
    assert [r.campaign for r in campaigns.top_campaigns(performance, 3).collect()] == ["Brand Search", "Prospecting", "Nonbrand Search"]
    assert [r.campaign for r in campaigns.campaign_efficiency_leaders(performance, limit=3).collect()] == ["Brand Search", "Prospecting", "Nonbrand Search"]
    assert [r.campaign for r in campaigns.campaign_watchlist(performance, limit=3).collect()] == ["Nonbrand Search", "Retargeting"]
    assert campaigns.campaign_watchlist(performance, min_spend=500).count() == 0


@pytest.fixture
def weekly(spend_rows, event_rows):
    spend = spend_rows(
        ("2026-03-12", "a", "1", "c", 200.0, 1, 5, 10.0), ("2026-03-05", "a", "1", "c", 100.0, 1, 5, 0.0), ("2026-03-04", "a", "1", "c", 100.0, 1, 5, 20.0)
    )
    events = event_rows(
        ("u", "signup", "2026-03-10", "a", None, 0.0),
        ("u", "purchase", "2026-03-11", "a", None, 50.0),
        ("v", "purchase", "2026-03-01", "a", None, 80.0),
        ("w", "purchase", "2026-03-01", "a", None, 20.0),
        (None, "purchase", "2026-03-12", "a", None, 25.0),
    )
    return spend, events


def test_growth_summary_and_what_is_built_on_it(weekly):
    summary = reports.growth_summary(*weekly, AS_OF)
    rows = {r.metric: (r.current_value, r.previous_value, r.change_pct) for r in summary.collect()}
    assert rows == {
        "Revenue": (75.0, 100.0, -25.0),
        "Spend": (300.0, 100.0, 200.0),
        "Conversions": (10.0, 20.0, -50.0),
        "Active Users": (1.0, 2.0, -50.0),
    }
    brief = reports.executive_summary(summary).first()
    assert brief.wins == "Spend +200.0%" and brief.risks == "Revenue -25.0%, Conversions -50.0%, Active Users -50.0%"
    story = reports.narrative_growth_review(summary).orderBy("position").collect()
    assert story[0].tone == "mixed" and story[0].finding == "Spend grew +200.0% to 300" and len(story) == 4
    review = reports.weekly_growth_review(*weekly, AS_OF).first()
    assert (review.positive_movement, review.negative_movement) == ("Spend", "Revenue, Conversions, Active Users")
    assert (review.anomalies, review.lowest_cac_channel) == (0, "a")
    report = {r.metric: r.current_value for r in reports.weekly_report(*weekly, AS_OF).collect()}
    assert (report["Signups"], report["Purchasers"]) == (1.0, 1.0)


def test_summary_without_previous_period(spend_rows, event_rows):
    spend = spend_rows(("2026-03-12", "a", "1", "c", 200.0, 1, 5, 10.0))
    summary = reports.growth_summary(spend, event_rows(("u", "x", "2026-03-12", "a", None, 1.0)), AS_OF)
    assert all(r.change_pct is None for r in summary.collect())
    assert reports.executive_summary(summary).first().wins == "No major wins detected."
    story = reports.narrative_growth_review(summary).collect()
    assert {r.tone for r in story} == {"pressure"} and len(story) == 4


def test_counts_with_share(spark):
    contacts = spark.createDataFrame([("lead",), ("lead",), ("customer",)], "lifecycle_stage string")
    assert {r.lifecycle_stage: (r.contacts, r.share_pct) for r in reports.hubspot_contacts_summary(contacts).collect()} == {"lead": (2, 66.7), "customer": (1, 33.3)}
