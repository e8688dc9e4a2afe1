"""Normalization of raw payloads."""

from __future__ import annotations

import json
import re

import pytest

from tidemark.sources import payloads
from tidemark.streaming.landing import normalize_landing


def raw(spark, *objects):
    return spark.createDataFrame([(o if isinstance(o, str) else json.dumps(o),) for o in objects], "value string")


BILL = {
    "id": "bill-77", "customer": "k-31", "status": "paid", "currency": "chf", "amount_paid": 4350, "amount_due": 4400, "amount_remaining": 50,
    "created": 1600000000, "subscription": "plan-5", "customer_details": {"email": "kim@shop.test"}, "status_transitions": {"paid_at": 1600100000},
    "lines": {"data": [{"period": {"start": 1600000000, "end": 1602600000}}, {"period": {"start": 7, "end": 8}}]},
}


def test_billing(spark):
    given = [{"id": "k-31", "email": None, "created": 1600000000, "delinquent": True}, {"id": "k-32"}, "{broken", "[1]", "", "\t {\"id\": \"k-33\"}"]
    customer = payloads.normalize_stripe_customers(raw(spark, *given)).collect()
    assert [(r.customer_id, r.email, str(r.created), r.delinquent) for r in customer] == [("k-31", "", "2020-09-13", True), ("k-32", "", "None", False), ("k-33", "", "None", False)]
    assert [r.value for r in payloads.rejected(raw(spark, *given)).collect()] == ["{broken", "[1]", ""]
    row = payloads.normalize_stripe_invoices(raw(spark, BILL)).first()
    assert (row.invoice_id, row.customer_email, float(row.amount_paid), float(row.amount_remaining)) == ("bill-77", "kim@shop.test", 43.5, 0.5)
    assert [str(d) for d in (row.created, row.period_start, row.period_end)] == ["2020-09-13", "2020-09-13", "2020-10-13"]
    direct = payloads.normalize_stripe_invoices(raw(spark, {**BILL, "customer_email": "own@shop.test", "lines": {"data": []}})).first()
    assert (direct.customer_email, direct.period_start) == ("own@shop.test", None)
    events = payloads.stripe_invoices_to_events(
        raw(spark, BILL, {**BILL, "status": "draft"}, {"id": "bill-9", "status": "paid", "customer": "", "customer_email": "e@x.test", "created": 1600000000, "amount_paid": 2})
    ).collect()
    assert [(e.user_id, e.event_type, str(e.event_date), e.utm_source, float(e.revenue)) for e in events] == [
        ("k-31", "purchase", "2020-09-14", "stripe", 43.5), ("e@x.test", "purchase", "2020-09-13", "stripe", 0.02),
    ]
    plan = {
        "id": "plan-5", "customer": "k-31", "status": "trialing", "created": 1600000000, "current_period_end": 1602600000, "cancel_at_period_end": True,
        "items": {"data": [{"price": {"id": "gold", "currency": "chf", "unit_amount": 9905, "recurring": {"interval": "week"}}}]},
    }
    row = payloads.normalize_stripe_subscriptions(raw(spark, plan, {"id": "plan-6", "items": {"data": []}})).orderBy("subscription_id").collect()
    assert (row[0].price_id, float(row[0].unit_amount), row[0].interval, row[0].cancel_at_period_end) == ("gold", 99.05, "week", True)
    assert (row[1].price_id, float(row[1].unit_amount), row[1].interval, row[1].current_period_start) == ("", 0.0, "", None)


def test_ads(spark):
    campaign = {"id": "m-8", "name": "Autumn", "effective_status": ["PENDING", "LIVE"], "created_time": "2020-05-06T23:59:00+0200", "start_time": "2020-05-07", "daily_budget": "1234"}
    row = payloads.normalize_meta_campaigns(raw(spark, campaign)).first()
    assert (row.channel, row.effective_status, str(row.created_time), float(row.daily_budget), float(row.lifetime_budget)) == ("meta_ads", "PENDING,LIVE", "2020-05-06", 12.34, 0.0)
    plain = payloads.normalize_meta_campaigns(raw(spark, {**campaign, "effective_status": "LIVE"})).first()
    assert plain.effective_status == "LIVE"
    insight = {"campaign_id": "m-8", "campaign_name": "Autumn", "date_start": "2020-06-01", "impressions": "901", "clicks": "33.0", "spend": "17.05", "cpc": ""}
    row = payloads.normalize_meta_spend(raw(spark, insight)).first()
    assert (str(row.date), float(row.spend), row.impressions, row.clicks, row.conversions, row.reach, float(row.cpc)) == ("2020-06-01", 17.05, 901, 33, 0.0, 0, 0.0)
    result = {"campaign": {"id": "g-4", "name": "Shoes"}, "segments": {"date": "2020-06-01"}, "metrics": {"impressions": "70", "clicks": "9", "costMicros": "3500000", "conversions": 1.5}}
    other = {"campaign": {"id": "g-5"}, "segments": {}, "metrics": {}}
    rows = payloads.normalize_google_spend(raw(spark, [{"results": [result, other]}, {"nothing": 1}], {"results": [result]}, "broken", "[]")).orderBy("campaign_id").collect()
    assert [(r.campaign_id, float(r.spend), r.conversions) for r in rows] == [("g-4", 3.5, 1.5), ("g-4", 3.5, 1.5), ("g-5", 0.0, 0.0)]
    camp = payloads.normalize_google_campaigns(raw(spark, [{"results": [{"campaign": {"id": "g-4", "advertisingChannelType": "VIDEO", "startDate": "2020-05-01"}}]}])).first()
    assert (camp.campaign_type, str(camp.start_date), camp.end_date, camp.name) == ("VIDEO", "2020-05-01", None, "")
    pages = payloads.unpack_pages(raw(spark, {"data": [insight, insight], "paging": {}}, {"data": []}, "broken"))
    assert payloads.normalize_meta_spend(pages).count() == 2


def test_other_field_types_lose_no_record(spark):
    truth = [{"id": str(k), "delinquent": v} for k, v in enumerate(["true", 0, 1, "", [], None, False, "yes"])]
    assert [r.delinquent for r in payloads.normalize_stripe_customers(raw(spark, *truth)).orderBy("customer_id").collect()] == [True, False, True, False, False, False, False, True]
    odd = [{**BILL, "lines": []}, {**BILL, "customer_details": "pay@shop.test"}, {**BILL, "lines": "x"}, {**BILL, "status_transitions": []}]
    bills = payloads.normalize_stripe_invoices(raw(spark, *odd)).collect()
    assert [(r.customer_email, r.period_start is None) for r in bills] == [("kim@shop.test", True), ("pay@shop.test", False), ("kim@shop.test", True), ("kim@shop.test", False)]
    assert [float(r.revenue) for r in payloads.stripe_invoices_to_events(raw(spark, *odd)).collect()] == [43.5] * 4
    plan = payloads.normalize_stripe_subscriptions(raw(spark, {"id": "p", "items": {"data": [{"price": {"id": "gold", "recurring": "month"}}]}}, {"id": "q", "items": 3})).collect()
    assert [(r.subscription_id, r.price_id, r.interval) for r in plan] == [("p", "gold", ""), ("q", "", "")]
    funnels = [{"funnel_id": 1, "steps": [{"event": "open", "count": "4"}, "odd", {"name": "buy", "count": 2}]}]
    expected = [("1", "open", 4), ("1", "Step 1", 0), ("1", "buy", 2)]
    for shape in (funnels[0], funnels, {"results": funnels}):
        assert [(r.funnel_id, r.step_name, r["count"]) for r in payloads.normalize_mixpanel_funnels(raw(spark, shape)).orderBy("step_index").collect()] == expected
    assert payloads.normalize_hubspot_contacts(raw(spark, {"id": "1", "properties": []})).first().lead_source == "unknown"
    assert payloads.normalize_hubspot_deals(raw(spark, {"id": "1", "properties": []})).first().amount == 0.0
    assert payloads.normalize_amplitude_events(raw(spark, {"event_type": "e", "user_properties": [], "event_properties": {"utm_source": "s"}})).first().utm_source == "s"
    sizes = payloads.normalize_amplitude_cohorts(raw(spark, {"cohorts": [{"id": "1", "size": "5"}, {"id": "2", "size": 6}, {"id": "3", "size": None}, "odd"]}), "2024-01-01").collect()
    assert [(r.cohort_id, r["size"]) for r in sizes] == [("1", 5), ("2", 6), ("3", 0)]


@pytest.mark.parametrize("value", ["NaN", "1e30", "-1e400", "x", 1e19, None, True])
def test_one_bad_number_fails_nothing(spark, value):
    spend = payloads.normalize_meta_spend(raw(spark, {"spend": value, "impressions": value, "cpc": value})).first()
    assert (float(spend.spend), spend.impressions) == (0.0, 0)
    metrics = {"costMicros": value, "impressions": value, "clicks": value, "conversions": value}
    google = payloads.normalize_google_spend(raw(spark, [{"results": [{"metrics": metrics}]}])).first()
    assert google.clicks == 0 and google.spend is not None
    assert payloads.normalize_mixpanel_events(raw(spark, {"event": "e", "properties": {"time": value}})).first().time is None
    assert payloads.normalize_stripe_customers(raw(spark, {"id": "c", "created": value})).first().created is None


def test_whole_numbers_keep_all_digits_and_fractional_times_count(spark):
    row = payloads.normalize_meta_spend(raw(spark, {"impressions": "9007199254740993"})).first()
    assert row.impressions == 9007199254740993
    assert str(payloads.normalize_stripe_customers(raw(spark, {"id": "c", "created": 1600000000.5})).first().created) == "2020-09-13"
    assert payloads.normalize_stripe_customers(raw(spark, {"id": "c", "created": 99999999999999999})).first().created is None


def test_crm(spark):
    row = payloads.normalize_hubspot_contacts(raw(spark, {"id": "1", "properties": {"email": "a@x", "createdate": "2026-01-02T03:04:05Z", "lifecyclestage": None}})).first()
    assert (row.email, str(row.created_date), row.lifecycle_stage, row.lead_source, row.num_associated_deals) == ("a@x", "2026-01-02", "unknown", "unknown", 0)
    deals = payloads.normalize_hubspot_deals(raw(spark, {"id": "1", "properties": {"amount": "12.5"}}, {"id": "2", "properties": {"amount": "n/a", "hs_analytics_source": "EMAIL"}})).orderBy("id").collect()
    assert [(d.amount, d.utm_source, d.close_date) for d in deals] == [(12.5, "direct", None), (0.0, "EMAIL", None)]


def test_product_analytics(spark):
    lines = [{"event": "click", "properties": {"distinct_id": "u", "time": 1741651200, "utm_source": "x", "deep": {"a": 1}}}, "oops", {"event": "view", "properties": {}}]
    rows = payloads.normalize_mixpanel_events(raw(spark, *lines)).orderBy("event").collect()
    assert [(r.event, r.distinct_id, r.utm_source) for r in rows] == [("click", "u", "x"), ("view", "", "")]
    assert rows[0].time is not None and rows[1].time is None
    assert json.loads(rows[0].properties_json)["deep"] == {"a": 1}
    assert payloads.normalize_mixpanel_events(raw(spark, *lines), event_names=["view"]).count() == 1
    funnel = {"id": 7, "steps": [{"event": "a", "count": 10, "conversion_rate": 1}, {"name": "b", "count": 4, "step_conv_ratio": 0.43333}, {"count": 1}]}
    steps = payloads.normalize_mixpanel_funnels(raw(spark, funnel)).orderBy("step_index").collect()
    assert [(s.funnel_id, s.step_name, s["count"], s.conversion_rate) for s in steps] == [("7", "a", 10, 1.0), ("7", "b", 4, 0.4333), ("7", "Step 2", 1, 0.0)]
    event = {"event_type": "t", "user_id": None, "session_id": 12, "event_time": "2025-01-01 12:00:00.123000", "revenue": None, "user_properties": {"utm_source": ""}, "event_properties": {"utm_source": "e"}}
    rows = payloads.normalize_amplitude_events(raw(spark, event, {**event, "event_time": "yesterday", "user_properties": {"utm_source": "u"}})).orderBy("timestamp").collect()
    assert [(r.timestamp, r.utm_source, r.session_id, r.revenue, r.user_id) for r in rows] == [("2025-01-01T12:00:00Z", "e", "12", 0.0, ""), ("yesterday", "u", "12", 0.0, "")]
    cohorts = {"cohorts": [{"id": "c1", "name": "A", "size": 5, "lastComputed": "2026-01-02T00:00:00Z"}, {"id": "c2", "lastComputed": ""}]}
    rows = payloads.normalize_amplitude_cohorts(raw(spark, cohorts), "2026-03-12").orderBy("cohort_id").collect()
    assert [(r.cohort_id, r.size, str(r.last_computed)) for r in rows] == [("c1", 5, "2026-01-02"), ("c2", 0, "2026-03-12")]


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles", "Asia/Tokyo"])
def test_days_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = payloads.normalize_stripe_invoices(raw(spark, BILL)).selectExpr("cast(created as string) c").first()
        assert row.c == "2020-09-13"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_landing_takes_each_file_once(spark, tmp_path):
    landing, out, checkpoint = (str(tmp_path / name) for name in ("landing", "out", "checkpoint"))
    (tmp_path / "landing").mkdir()

    def run():
        normalize_landing(spark, landing, payloads.stripe_invoices_to_events, out, checkpoint, partition_by=["event_date"]).awaitTermination()
        return spark.read.parquet(out).count()

    (tmp_path / "landing" / "1.jsonl").write_text(json.dumps(BILL) + "\nnot json\n", encoding="utf-8")
    assert run() == 1
    (tmp_path / "landing" / "2.jsonl").write_text(json.dumps({**BILL, "id": "bill-78"}), encoding="utf-8")
    assert run() == 2
    assert run() == 2


def test_odd_neighbours_in_ad_reports_lose_no_result(spark):
    """A result counts by itself, whatever stands beside it or in one of its parts."""
    one = {"campaign": {"id": "g-1", "name": "One", "status": "ENABLED"}, "segments": {"date": "2020-06-01"}, "metrics": {"clicks": "9", "costMicros": 2500000}}
    odd = ["bad", 7, None, [], True, {"results": [one]}]
    parts = [{**one, "campaign": "text"}, {**one, "metrics": []}, {**one, "segments": 5}, {**one, "metrics": {"clicks": {"n": 1}, "costMicros": "2500000"}}]
    given = [
        [{"results": [one, *odd]}, "batch", None, {"results": "none"}, {"results": {}}, {"results": parts}],
        {"results": [one, "bad"]},
        '[{"results": [{"campaign": {"id": "g-2", "id": "g-3"}}, {"campaign": {"id": "g-4"}}]}]',
        "broken",
        "[]",
    ]
    rows = payloads.normalize_google_spend(raw(spark, *given)).collect()
    found = sorted((r.campaign_id, str(r.date), float(r.spend), r.clicks) for r in rows)
    full = ("g-1", "2020-06-01", 2.5, 9)
    # The object that is no campaign (a batch in place of a result) counts as a result without fields.
    assert found == sorted([full, full, ("", "None", 0.0, 0), ("", *full[1:]), (*full[:2], 0.0, 0), ("g-1", "None", 2.5, 9), ("g-1", "2020-06-01", 2.5, 0), ("g-4", "None", 0.0, 0)])
    campaigns = payloads.normalize_google_campaigns(raw(spark, *given)).collect()
    assert sorted((r.campaign_id, r.name) for r in campaigns if r.name) == [("g-1", "One")] * 5 and len(campaigns) == 8
    skipped = sorted(r.value for r in payloads.rejected_google_results(raw(spark, *given)).collect())
    assert {'"bad"', "7", "[]", "true", "broken"} <= set(skipped)


def test_lenient_texts_are_read_field_by_field(spark):
    texts = ['{"id": "a", "id": "b", "customer": "c", "lines": {"data": [{"period": {"start": 1600000000}}]}}', "{'id': 'q', 'customer_details': {'email': 'e@x'}}", '{"id": "n", "amount_paid": NaN}', "{broken"]
    rows = payloads.normalize_stripe_invoices(raw(spark, *texts)).orderBy("invoice_id").collect()
    assert [(r.invoice_id, r.customer_id, r.customer_email, str(r.period_start)) for r in rows] == [("b", "c", "", "2020-09-13"), ("n", "", "", "None"), ("q", "", "e@x", "None")]


def test_each_text_is_parsed_once(spark):
    """The strict parser appears once on the scanned text; the rest stands behind explodes."""
    for normalize, field in ((payloads.normalize_stripe_invoices, "RLIKE(value"), (payloads.stripe_invoices_to_events, "RLIKE(value"), (payloads.normalize_google_spend, "value")):
        plan = normalize(raw(spark, BILL))._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(rf"parseJson\((CASE WHEN )?{re.escape(field)}", plan)) == 1, plan


def test_reports_are_read_by_one_walk(spark):
    """No field is looked up by itself behind the explode of the results, and an odd field costs no other."""
    for normalize in (payloads.normalize_google_spend, payloads.normalize_google_campaigns):
        plan = normalize(raw(spark, BILL))._jdf.queryExecution().executedPlan().toString()
        assert "try_variant_get" not in plan.split("Generate explode")[0], plan
    texts = {"id": 12, "name": {"a": [1, 2.50]}, "status": "", "startDate": "2020-05-01x", "endDate": False}
    row = payloads.normalize_google_campaigns(raw(spark, {"results": [{"campaign": texts, "metrics": None}]})).first()
    assert (row.campaign_id, row.name, row.status, row.start_date, row.end_date) == ("12", '{"a":[1,2.5]}', "", None, None)


def test_report_batches_are_listed_behind_an_exchange_of_narrow_rows(spark, tmp_path):
    """A split of the scan sorts no lists, whatever its size; lines of one order are one batch, also without a key."""
    from datetime import datetime

    from tidemark.plans import tables

    lines = [(k, n, 7, 9, 2.0, 10.25, "A", datetime(2020, 1, n)) for k, n in ((1, 1), (1, 2), (1, 2), (2, 3), (None, 1), (None, 4))]
    names = "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame(lines, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    batches = tables._google_batches(spark, str(tmp_path))
    plan = batches._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")
    assert len(below) == 2 and "collect_list" not in below[1] and "REPARTITION_BY_NUM" in below[1], plan
    assert sorted(len(json.loads(r.value)[0]["results"]) for r in batches.collect()) == [1, 2, 3]
    assert payloads.normalize_google_spend(batches).count() == 6
