"""Funnels, acquisition, retention and churn on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import acquisition, churn, funnel, retention


def events_of(event_rows, *rows):
    return event_rows(*[(u, e, d, s, None, r) for u, e, d, s, r in rows])


def test_funnel_ignores_order_and_needs_every_earlier_step(event_rows):
    events = events_of(
        event_rows,
        ("a", "purchase", "2024-01-01", "x", 1.0),
        ("a", "activation", "2024-01-02", "x", 0.0),
        ("a", "signup", "2024-01-03", "x", 0.0),
        ("b", "signup", "2024-01-01", "x", 0.0),
        ("b", "purchase", "2024-01-01", "x", 9.0),
        (None, "signup", "2024-01-01", "x", 0.0),
        (None, "signup", "2024-01-02", "x", 0.0),
        (None, "activation", "2024-01-02", "x", 0.0),
    )
    rows = funnel.funnel_conversion(events, "default").orderBy("step_order").collect()
    assert [(r.step, r.users) for r in rows] == [("signup", 3), ("activation", 1), ("purchase", 1)]
    bounded = funnel.funnel_conversion(events, ["signup", "purchase"], "2024-01-01", "2024-01-01").orderBy("step_order").collect()
    assert [r.users for r in bounded] == [2, 1]
    empty = funnel.funnel_conversion(events, "nothing,never").orderBy("step_order").collect()
    assert [r.users for r in empty] == [0, 0]


def test_analyze_funnel_marks_the_worst_drop(event_rows):
    rows = [(f"u{i}", "signup", "2024-01-01", "x", 0.0) for i in range(10)]
    rows += [(f"u{i}", "activation", "2024-01-01", "x", 0.0) for i in range(8)]
    rows += [(f"u{i}", "purchase", "2024-01-01", "x", 0.0) for i in range(2)]
    result = funnel.analyze_funnel(events_of(event_rows, *rows), "default").orderBy("step_order").collect()
    assert [r.conversion_pct for r in result] == [100.0, 80.0, 20.0]
    assert [r.drop_off_pct for r in result] == [None, 20.0, 75.0]
    assert [r.is_worst_drop for r in result] == [False, False, True]


def test_funnel_ab(event_rows):
    rows = [("a", "signup", "2024-01-01", "x", 0.0), ("b", "signup", "2024-01-01", "x", 0.0), ("a", "purchase", "2024-01-01", "x", 0.0)]
    rows += [("c", "signup", "2024-02-01", "x", 0.0), ("c", "purchase", "2024-02-02", "x", 0.0)]
    result = funnel.funnel_ab_comparison(
        events_of(event_rows, *rows), "signup,purchase", ("2024-01-01", "2024-01-31"), ("2024-02-01", "2024-02-29")
    ).orderBy("step_order").collect()
    assert [(r.conversion_a_pct, r.conversion_b_pct, r.verdict) for r in result] == [(100.0, 100.0, "stable"), (50.0, 100.0, "improved")]


def test_presets_and_descriptions():
    assert funnel.parse_steps(" a, ,b ") == ["a", "b"]
    assert funnel.parse_steps("SaaS") == ["signup", "activation", "trial_start", "purchase"]
    assert funnel.describe_step("Checkout ") == "User begins the checkout process"
    assert funnel.describe_step("my_step") == "My Step"


@pytest.fixture
def channel_tables(spend_rows, event_rows):
    spend = spend_rows(
        ("2024-01-01", "google_ads", "1", "c", 100.0, 1, 1, 0.0),
        ("2024-01-02", "google_ads", "1", "c", 50.0, 1, 1, 0.0),
        ("2024-01-01", "tv", "2", "d", 70.0, 1, 1, 0.0),
    )
    events = events_of(
        event_rows,
        ("a", "signup", "2024-01-01", "google_ads", 0.0),
        ("a", "signup", "2024-01-02", "google_ads", 0.0),
        ("b", "signup", "2024-01-02", "google_ads", 0.0),
        (None, "signup", "2024-01-02", "google_ads", 0.0),
        ("a", "purchase", "2024-01-11", "google_ads", 600.0),
        ("c", "signup", "2024-01-01", "email", 0.0),
    )
    return spend, events


def test_cac_and_ltv(channel_tables):
    spend, events = channel_tables
    cac = {r.channel: r for r in acquisition.cac_by_channel(spend, events).collect()}
    assert cac.keys() == {"google_ads", "tv"}
    assert (cac["google_ads"].users_acquired, cac["google_ads"].cac) == (2, 75.0)
    assert (cac["tv"].users_acquired, cac["tv"].cac) == (0, None)
    ltv = {r.channel: r for r in acquisition.ltv_by_channel(events).collect()}
    assert (ltv["google_ads"].users, ltv["google_ads"].avg_ltv, ltv["google_ads"].avg_lifetime_days) == (2, 200.0, 3.0)
    both = {r.channel: r for r in acquisition.compute_cac_ltv(spend, events).collect()}
    assert (both["google_ads"].cac, both["google_ads"].roas) == (75.0, 2.67)
    assert both["google_ads"].users_acquired == 2 and both["tv"].roas is None
    best = acquisition.best_channels(acquisition.compute_cac_ltv(spend, events)).first()
    assert (best.best_cac_channel, best.best_roas_channel) == ("google_ads", "google_ads")
    review = {r.channel: r for r in acquisition.channel_efficiency_review(spend, events).collect()}
    assert (review["google_ads"].signal, review["google_ads"].cac_verdict) == ("Watch", "Average")
    assert (review["tv"].signal, review["tv"].cac_verdict) == (None, None)


def test_retention(event_rows):
    events = events_of(
        event_rows,
        ("a", "x", "2024-01-15", "s", 0.0),
        ("a", "x", "2024-01-16", "s", 0.0),
        ("a", "x", "2024-03-01", "s", 0.0),
        ("b", "x", "2024-01-31", "s", 0.0),
        ("b", "x", "2024-02-01", "s", 0.0),
        ("c", "x", "2024-02-10", "s", 0.0),
        (None, "x", "2024-02-10", "s", 0.0),
    )
    cells = {(str(r.cohort), r.period_number): (r.cohort_size, r.active_users, r.retention_pct) for r in retention.cohort_retention(events).collect()}
    assert cells == {
        ("2024-01-01", 0): (2, 2, 100.0),
        ("2024-01-01", 1): (2, 1, 50.0),
        ("2024-01-01", 2): (2, 1, 50.0),
        ("2024-02-01", 0): (1, 1, 100.0),
    }
    verdict = retention.retention_benchmark_verdict(retention.cohort_retention(events)).first()
    assert (verdict.avg_retention_pct, verdict.above_benchmark, verdict.verdict) == (50.0, True, "Good")
    weeks = {(str(r.cohort), r.period_number) for r in retention.cohort_retention(events, "week").collect()}
    assert ("2024-01-15", 6) in weeks and ("2024-01-29", 0) in weeks
    with pytest.raises(ValueError):
        retention.cohort_retention(events, "day")


def test_churn_modes(event_rows):
    events = events_of(
        event_rows,
        ("a", "x", "2024-01-30", "s", 0.0),
        ("b", "x", "2024-01-15", "s", 0.0),
        ("b", "cancel", "2024-01-10", "s", 0.0),
        ("c", "x", "2023-10-01", "s", 0.0),
        ("c", "cancel", "2023-10-02", "s", 0.0),
        ("d", "x", "2023-10-01", "s", 0.0),
    )
    inactive = {r.segment: (r.users, r.pct) for r in churn.churn_inactivity(events, "2024-01-31").collect()}
    assert inactive == {"Active": (1, 25.0), "At Risk": (1, 25.0), "Churned": (2, 50.0)}
    cancelled = {r.segment: r.users for r in churn.churn_subscription(events, "2024-01-31").collect()}
    assert cancelled == {"Active": 2, "Recently Cancelled": 1, "Churned": 1}
    left = {r.segment: (r.users, r.avg_lifetime_days) for r in churn.churn_event_based(events, "cancel").collect()}
    assert left == {"Active": (2, 0.0), "Churned": (2, 3.0)}
    headlines = {r.segment: r.headline for r in churn.analyze_churn(events, "2024-01-31").collect()}
    assert headlines["Churned"] == "2 users (50.0%) churned"
    assert churn.churn_inactivity(events.filter("false"), "2024-01-31").count() == 0


def test_one_user_with_a_third_of_all_rows(spark):
    """A very active user changes neither the counts nor the number of rows per task after combining."""
    hot = spark.range(60_000).select(F.lit("hot").alias("user_id"), F.col("id"))
    rest = spark.range(120_000).select(F.concat(F.lit("u"), F.col("id") % 500).alias("user_id"), F.col("id"))
    kinds = F.element_at(F.array(F.lit("signup"), F.lit("activation"), F.lit("purchase")), (F.col("id") % 3 + 1).cast("int"))
    events = hot.unionByName(rest).select("user_id", kinds.alias("event_type"), F.lit("2024-01-01").cast("date").alias("event_date"))
    rows = funnel.funnel_conversion(events, "default").collect()
    expected = events.filter("event_type = 'signup'").select("user_id").distinct().count()
    assert max(r.users for r in rows) == expected
