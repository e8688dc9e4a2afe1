"""Alias rules: resolution, bridge, suggestions, preview, apply and rollback."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.mapping import coverage, names, rollups, rules, similar, store, suggest
from tidemark.operators.mapping.profile import build_profile, read_profile
from tidemark.session import scratch_dir, snapshot

AS_OF = "2026-03-12"
GOOGLE = ("2026-03-06", "google_ads", "111", "Brand Search - US", 185.0, 12000, 640, 28.5)
META = ("2026-03-05", "meta_ads", "cmp_1", "Prospecting", 150.0, 10000, 320, 12.0)
BRAND = ("u1", "purchase", "2026-03-06", "google ads", "brand_search", 510.0)
FACEBOOK = ("u2", "purchase", "2026-03-05", "facebook ads", "Prospecting", 250.0)
LINKEDIN = ("u3", "purchase", "2026-03-04", "linkedin", "enterprise_push", 300.0)
ALIASES = [("campaign", "brandsearch", "Brand Search - US", "google_ads"), ("campaign", "brandsearch", "brand_search", "google_ads")]


def given(spark, rows=ALIASES):
    return rules.all_rules(spark, rules.user_rules(spark, list(rows)))


def keys(spark, names, rule_rows):
    frame = spark.createDataFrame(names, "c string, p string")
    resolved = rules.canonicalize(frame, given(spark, rule_rows), "c", "p").collect()
    return {(r.c, r.p): (r.channel_key, r.campaign_key) for r in resolved}


def test_first_rule_wins_and_scope_is_the_rows_own_channel(spark):
    rows = [
        ("campaign", "General", "spring", ""),
        ("campaign", "Scoped", "Spring", "meta-ads"),
        ("campaign", "ScopedFirst", "fall", "meta_ads"),
        ("campaign", "Later", "fall", ""),
        ("channel", "Google Search", "adwords", ""),
        ("channel", "X", "tv", ""),
    ]
    found = keys(spark, [("Meta Ads", "SPRING"), ("meta_ads", "fall"), ("facebook", "fall"), ("adwords", "x.y"), ("TV", None), (None, "a b")], rows)
    assert found[("Meta Ads", "SPRING")] == ("meta_ads", "General")
    assert found[("meta_ads", "fall")] == ("meta_ads", "ScopedFirst")
    assert found[("facebook", "fall")] == ("meta_ads", "Later")
    assert found[("adwords", "x.y")] == ("google_ads", "xy")
    assert found[("TV", None)] == ("X", "")
    assert found[(None, "a b")] == ("", "ab")


def test_rules_from_csv_keep_order_and_skip_incomplete_rows(spark, tmp_path):
    path = tmp_path / "rules.csv"
    path.write_text("scope,canonical_value,alias,channel\nCampaign ,b, a ,\nother,x,y,\nchannel,,z,\ncampaign,c,a,\n", encoding="utf-8")
    loaded = rules.read_rules_csv(spark, str(path)).orderBy("position").collect()
    assert [(r.scope, r.canonical_value, r.alias) for r in loaded] == [("campaign", "b", "a"), ("campaign", "c", "a")]
    resolved = rules.canonicalize(spark.createDataFrame([("x", "A")], "c string, p string"), rules.all_rules(spark, rules.read_rules_csv(spark, str(path))), "c", "p")
    assert resolved.first().campaign_key == "b"


def test_bridge_links_campaigns_to_revenue(spark, spend_rows, event_rows):
    spend = spend_rows(META, ("2026-03-06", "google_ads", "111", "Brand Search", 185.0, 12000, 640, 28.5))
    events = event_rows(
        ("u1", "signup", "2026-03-02", "meta_ads", "Prospecting", 0.0),
        ("u1", "purchase", "2026-03-05", "meta_ads", "Prospecting", 240.0),
        ("u2", "signup", "2026-03-03", "google_ads", "Brand Search", 0.0),
        ("u2", "purchase", "2026-03-06", "google_ads", "Brand Search", 420.0),
    )
    rows = rollups.attribution_bridge(spend, events, rules.all_rules(spark), AS_OF, limit=5).collect()
    assert [(r.campaign, r.attributed_revenue_30d, r.signups_30d, r.purchasers_30d) for r in rows] == [("Brand Search", 420.0, 1, 1), ("Prospecting", 240.0, 1, 1)]
    assert (rows[0].attributed_roas, rows[0].cost_per_purchaser) == (2.27, 185.0)
    covered = rollups.attribution_bridge_coverage(spend, events, rules.all_rules(spark), AS_OF).first()
    assert (covered.attributed_revenue_30d, covered.total_revenue_30d, covered.total_purchasers_30d, covered.coverage_pct) == (660.0, 660.0, 2, 100.0)


def test_bridge_by_channel_without_campaigns(spark, spend_rows, event_rows):
    events = event_rows(("u1", "purchase", "2026-03-05", "facebook", None, 240.0)).drop("utm_campaign")
    row = rollups.attribution_bridge(spend_rows(META), events, rules.all_rules(spark), AS_OF).first()
    assert (row.channel, row.campaign, row.campaign_id, row.attributed_revenue_30d) == ("meta_ads", "meta_ads", None, 240.0)


def test_diagnostics_with_aliases(spark, spend_rows, event_rows):
    spend, events = spend_rows(GOOGLE, META), event_rows(BRAND, FACEBOOK, LINKEDIN)
    bridge = {r.campaign: r.attributed_revenue_30d for r in rollups.attribution_bridge(spend, events, given(spark), AS_OF).collect()}
    assert bridge == {"Brand Search - US": 510.0, "Prospecting": 250.0}
    parts = coverage.mapping_diagnostics(spend, events, given(spark), AS_OF)
    row = parts["coverage"].first()
    assert (row.total_keys, row.matched_keys, row.attributed_revenue_30d, row.total_revenue_30d, row.spend_coverage_pct) == (2, 2, 760.0, 1060.0, 100.0)
    assert row.revenue_coverage_pct == 71.7
    assert [(r.utm_source, r.revenue_30d) for r in parts["unmatched_events"].collect()] == [("linkedin", 300.0)]
    assert parts["unmatched_spend"].count() == 0
    hits = {r.alias: (r.spend_rows, r.event_rows, r.spend_sample, r.event_sample) for r in parts["applied_rules"].collect()}
    # "facebook ads" and "google ads" resolve through aliases that differ from their canonical value only by what is normalized away,
    # or not at all; the campaign aliases are scoped to the channel's own name.
    assert hits["Brand Search - US"] == (1, 0, "Brand Search - US", "")
    assert hits["facebookads"] == (0, 1, "", "facebook ads")


def test_old_keys_stay_with_zero_spend(spark, spend_rows):
    rows = rollups.spend_rollup(spend_rows(GOOGLE, ("2025-01-01", "tv", "9", "Old", 70.0, 1, 1, 1.0)), rules.all_rules(spark), AS_OF).collect()
    assert {r.campaign_key: r.spend_30d for r in rows} == {"brandsearchus": 185.0, "old": 0.0}


def suggestions_of(spend, events, current, limit=None):
    """Suggestions on snapshots of the two key tables, as a snapshot of their own."""
    unmatched = snapshot(coverage.unmatched_event_keys(spend, events, current, AS_OF))
    catalog = snapshot(rollups.spend_rollup(spend, current, AS_OF))
    return snapshot(suggest.suggest_mappings(unmatched, catalog, current, limit))


@pytest.fixture(scope="module")
def workflow(spark, spend_rows, event_rows):
    spend = spend_rows(GOOGLE)
    events = event_rows(("u1", "purchase", "2026-03-06", "google_ads", "brand_search", 510.0))
    current = rules.all_rules(spark)
    now = snapshot(coverage.mapping_coverage(spend, events, current, AS_OF))
    return spend, events, current, suggestions_of(spend, events, current, limit=10), now


def test_suggestion_preview_and_risk(workflow):
    spend, events, current, suggestions, _ = workflow
    rows = suggestions.collect()
    assert [(r.scope, r.alias, r.canonical_value, r.channel, r.confidence) for r in rows] == [("campaign", "brand_search", "Brand Search - US", "google_ads", 0.85)]
    assert (rows[0].estimated_revenue_30d, rows[0].estimated_spend_30d) == (510.0, 185.0)
    pack = suggest.mapping_review_pack(spend, events, current, suggestions, AS_OF, min_confidence=0.7)
    preview = {r.metric: (r.current, r.preview) for r in pack["coverage_preview"].collect()}
    assert preview["Mapped spend (30d)"] == (0.0, 185.0)
    assert preview["Attributed revenue (30d)"] == (0.0, 510.0)
    risk = pack["risk_review"].first()
    assert "high_revenue_impact" in risk.flags.split(", ")
    assert [r.suggestions for r in pack["risk_mix"].collect()] == [1]


def test_apply_twice_review_and_rollback(spark, workflow):
    spend, events, current, suggestions, now = workflow
    path = scratch_dir(spark)
    run = lambda at: [r.status for r in store.apply_mappings(suggestions, path, current, now, min_confidence=0.7, changed_at=at).collect()]
    assert run("2026-03-12T00:00:00") == ["applied"]
    assert run("2026-03-12T01:00:00") == ["skipped"]
    active = store.active_rules(store.read_history(spark, path)).collect()
    assert [(r.alias, r.canonical_value) for r in active] == [("brand_search", "Brand Search - US")]
    resolved = coverage.mapping_coverage(spend, events, rules.all_rules(spark, store.active_rules(store.read_history(spark, path))), AS_OF).first()
    assert resolved.attributed_revenue_30d == 510.0

    untouched = store.rollback_mappings(spark, path, ["brand_search"], channel="meta_ads", changed_at="2026-03-12T02:00:00").collect()
    assert [(r.alias, r.status) for r in untouched] == [("brand_search", "not_found")]
    plan = store.rollback_mappings(spark, path, ["Brand Search", "unknown"], scope="campaign", changed_at="2026-03-12T03:00:00").collect()
    assert sorted((r.alias, r.status) for r in plan) == [("brand_search", "removed"), ("unknown", "not_found")]
    review = store.review_mappings(store.read_history(spark, path))
    assert review["rules"].count() == 0
    assert [r.action for r in review["history"].collect()] == ["rollback", "apply"]
    assert run("2026-03-12T04:00:00") == ["applied"]


def test_high_risk_blocks_everything_unless_forced(spark, workflow):
    _, _, current, suggestions, now = workflow
    conflicting = rules.all_rules(spark, rules.user_rules(spark, [("campaign", "other", "Brand-Search", "google_ads")]))
    nothing = store.active_rules(store.read_history(spark, scratch_dir(spark)))
    plan = store.plan_apply(suggestions, nothing, conflicting, now, min_confidence=0.7).first()
    assert (plan.status, plan.risk_level) == ("blocked", "high")
    assert "existing_alias_conflict" in plan.flags
    assert store.history_rows(store.plan_apply(suggestions, nothing, conflicting, now, min_confidence=0.7), "t").count() == 0
    assert store.plan_apply(suggestions, nothing, conflicting, now, min_confidence=0.7, force=True).first().status == "applied"
    assert store.plan_apply(suggestions, nothing, current, now, aliases=["something else"], min_confidence=0.7).count() == 0


def test_rollback_counts_by_the_moment_not_by_its_text(spark, workflow):
    _, _, current, suggestions, now = workflow
    path = scratch_dir(spark)
    store.apply_mappings(suggestions, path, current, now, min_confidence=0.7, changed_at="2024-01-01T00:00:00+00:00")
    store.rollback_mappings(spark, path, ["brand_search"], changed_at="2023-12-31T23:30:00-05:00")
    assert store.active_rules(store.read_history(spark, path)).count() == 0
    assert [r.action for r in store.review_mappings(store.read_history(spark, path))["history"].collect()] == ["rollback", "apply"]
    with pytest.raises(ValueError, match="recorded already"):
        store.apply_mappings(suggestions, path, current, now, min_confidence=0.7, changed_at="2024-01-01T05:30:00+01:00")


def test_all_suggestions_are_acted_on(spark, workflow):
    _, _, current, suggestions, now = workflow
    many = spark.createDataFrame(
        [("campaign", f"Name {k}", f"name_{k}", "google_ads", 0.9, 1.0 + k, 1.0) for k in range(45)],
        "scope string, canonical_value string, alias string, channel string, confidence double, estimated_revenue_30d double, estimated_spend_30d double",
    )
    nothing = store.active_rules(store.read_history(spark, scratch_dir(spark)))
    plan = store.plan_apply(many, nothing, current, now, force=True).orderBy("position").collect()
    assert [r.alias for r in plan] == [f"name_{k}" for k in range(44, -1, -1)] and {r.status for r in plan} == {"applied"}
    assert store.plan_apply(many, nothing, current, now, force=True, limit=3).count() == 3
    assert suggest.select_suggestions(many, limit=0).count() == 0
    path = scratch_dir(spark)
    store.record(snapshot(store.plan_apply(many, nothing, current, now, force=True)), path, "2024-01-01T00:00:00")
    assert store.review_mappings(store.read_history(spark, path))["rules"].count() == 45


def test_suggestions_across_channels(spark, spend_rows, event_rows):
    spend = spend_rows(
        ("2026-03-06", "linkedin", "1", "Spring Sale", 500.0, 1, 1, 1.0),
        ("2026-03-06", "google_ads", "2", "Spring Sale", 900.0, 1, 1, 1.0),
        ("2026-03-06", "google_ads", "3", "Fall", 10.0, 1, 1, 1.0),
    )
    events = event_rows(
        ("a", "purchase", "2026-03-06", "linkedinn", "sale spring", 80.0),  # close to a channel: 8 of 9 letters
        ("b", "purchase", "2026-03-06", "partner", "spring-sale!", 70.0),  # unknown channel: any campaign
        ("c", "purchase", "2026-03-06", "google", "winter", 60.0),  # known channel, no such campaign
    )
    current = rules.all_rules(spark)
    found = suggestions_of(spend, events, current)
    rows = {(r.scope, r.alias): (r.canonical_value, r.channel, r.confidence) for r in found.collect()}
    assert rows == {
        ("channel", "linkedinn"): ("linkedin", "", 0.89),
        ("campaign", "sale spring"): ("Spring Sale", "linkedin", 1.0),
        ("campaign", "spring-sale!"): ("Spring Sale", "google_ads", 0.91),
    }


def test_profile_outlives_its_inputs(spark, spend_rows, event_rows):
    path = scratch_dir(spark)
    current = rules.all_rules(spark)
    built = build_profile(spend_rows(GOOGLE, META), event_rows(BRAND, FACEBOOK, LINKEDIN), current, AS_OF, path=path)
    loaded = read_profile(spark, path)
    assert loaded.keys() == built.keys()
    assert [(r.alias, r.canonical_value) for r in loaded["suggestions"].collect()] == [("brand_search", "Brand Search - US")]
    assert {r.utm_source for r in loaded["unmatched_events"].collect()} == {"google ads", "linkedin"}
    assert loaded["coverage"].first().matched_keys == 1
    plan = store.plan_apply(loaded["suggestions"], store.active_rules(store.read_history(spark, scratch_dir(spark))), current, loaded["coverage"], min_confidence=0.7)
    assert [r.status for r in plan.collect()] == ["applied"]


def test_rules_by_channel_without_campaigns(spark, spend_rows, event_rows):
    """Without campaign names everything works by channel."""
    events = event_rows(("u", "purchase", "2026-03-06", "linkedinn", None, 80.0)).drop("utm_campaign")
    spend = spend_rows(("2026-03-06", "linkedin", "1", "Spring", 500.0, 1, 1, 1.0))
    profile = build_profile(spend, events, rules.all_rules(spark), AS_OF)
    assert [(r.scope, r.alias, r.canonical_value) for r in profile["suggestions"].collect()] == [("channel", "linkedinn", "linkedin")]
    assert [(r.channel, r.campaign) for r in profile["unmatched_spend"].collect()] == [("linkedin", "linkedin")]
    preview = suggest.preview_mappings(spend, events, rules.all_rules(spark), profile["suggestions"], AS_OF)
    assert {r.metric: r.preview for r in preview.collect()}["Matched keys"] == 1.0


def raw_tables(spark, spend_rows, event_rows):
    """Spend and events as tables by day, some rows old, with their folders."""
    folders = scratch_dir(spark), scratch_dir(spark)
    spend = spend_rows(GOOGLE, META, ("2025-01-01", "tv", "9", "Old", 70.0, 1, 1, 1.0), ("2025-02-01", "google_ads", "111", "Brand Search - US", 5.0, 1, 1, 1.0))
    spend.write.partitionBy("date").parquet(folders[0])
    event_rows(BRAND, FACEBOOK, LINKEDIN, ("u9", "signup", "2026-03-01", "meta_ads", "Prospecting", 0.0)).write.partitionBy("event_date").parquet(folders[1])
    return [spark.read.parquet(f) for f in folders], folders


def plan_of(frame):
    return frame._jdf.queryExecution().toString()


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_raw_tables_are_scanned_once_per_report(spark, spend_rows, event_rows, monkeypatch):
    """Each report reads every raw table in one scan of what it writes, and nowhere else."""
    (spend, events), folders = raw_tables(spark, spend_rows, event_rows)
    written = []

    def recorded(frame, path=None, run=names.snapshot):
        written.append(physical(frame))
        return run(frame, path)

    monkeypatch.setattr(names, "snapshot", recorded)
    current = given(spark)
    selected = spark.createDataFrame([("campaign", "Prospecting", "enterprise_push", "", 0.9, "r", 1.0, 1.0)], "scope string, canonical_value string, alias string, channel string, confidence double, reason string, estimated_revenue_30d double, estimated_spend_30d double")
    reports = {
        "diagnostics": lambda: list(coverage.mapping_diagnostics(spend, events, current, AS_OF).values()),
        "preview": lambda: [suggest.preview_mappings(spend, events, current, selected, AS_OF)],
        "pack": lambda: list(suggest.mapping_review_pack(spend, events, current, selected, AS_OF).values()),
        "profile": lambda: list(build_profile(spend, events, current, AS_OF).values()),
    }
    for report, run in reports.items():
        written.clear()
        frames = run()
        for folder in folders:
            name = folder.rsplit("/", 1)[1]
            assert sum(plan.count(name) for plan in written) == 1, report
            assert not any(name in plan_of(f).split("== Physical Plan ==")[1] for f in frames), report


def test_single_reports_scan_each_table_once(spark, spend_rows, event_rows):
    (spend, events), folders = raw_tables(spark, spend_rows, event_rows)
    current = given(spark)
    for report in (rollups.attribution_bridge, rollups.attribution_bridge_coverage, coverage.mapping_coverage, coverage.unmatched_event_keys, coverage.unmatched_spend_keys, coverage.applied_alias_rules):
        plan = physical(report(spend, events, current, AS_OF))
        assert [plan.count(folder.rsplit("/", 1)[1]) for folder in folders] == [1, 1], report.__name__


def test_no_sort_over_raw_rows_of_applied_rules(spark, spend_rows, event_rows):
    """Raw rows are counted per spelling by hash; only the counted spellings are sorted for their minima."""
    (spend, events), _ = raw_tables(spark, spend_rows, event_rows)
    for spelled in (names.spend_names(spend, AS_OF), names.event_names(events, AS_OF), names.event_users(events, AS_OF)):
        assert "SortAggregate" not in physical(spelled) and "HashAggregate" in physical(spelled)


def test_known_names_prune_the_scan(spark, spend_rows, event_rows):
    (spend, _), folders = raw_tables(spark, spend_rows, event_rows)
    path, compact = scratch_dir(spark), scratch_dir(spark)
    for load in ("date < '2025-01-15'", "date >= '2025-01-15'"):
        names.add_spend_names(spend.filter(load), path)
    names.compact_spend_names(spark, path, compact)
    names.add_spend_names(spend_rows(META), compact)
    whole = {tuple(r) for r in rollups.spend_rollup(spend, given(spark), AS_OF).collect()}
    for known in (path, compact):
        found = rollups.spend_rollup(spend, given(spark), AS_OF, known=names.read_spend_names(spark, known))
        assert {tuple(r) for r in found.collect()} == whole and len(whole) == 3
        scan = next(line for line in physical(found).splitlines() if folders[0].rsplit("/", 1)[1] in line)
        assert "PartitionFilters: [isnotnull(date" in scan and ">= 2026-02-10" in scan
    assert ("old", 0.0) in {(r.campaign_key, r.spend_30d) for r in rollups.spend_rollup(spend, given(spark), AS_OF, known=names.read_spend_names(spark, path)).collect()}
    by_channel = rollups.spend_rollup(spend, given(spark), AS_OF, by_campaign=False, known=names.read_spend_names(spark, path)).collect()
    assert {r.channel_key: r.spend_30d for r in by_channel} == {"google_ads": 185.0, "meta_ads": 150.0, "tv": 0.0}


@pytest.mark.parametrize("seed", range(3))
def test_similar_names_equal_all_pairs(spark, seed):
    """Random names of up to 500 characters, parts of one another and reorderings of words."""
    rng = random.Random(seed)
    words = ["a", "spring", "sale", "us", "brand", "x" * 30, "été", "q1", "2024"]

    def name():
        text = rng.choice([" ", "_", "-", ""]).join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 40])))[:500]
        return text

    base = [name() for _ in range(40)]

    def related():
        text = rng.choice(base)
        kind = rng.randint(0, 4)
        cut = rng.randint(0, max(1, len(text) // 3))
        if kind == 0:
            return text[cut:]
        if kind == 1:
            return text[: len(text) - cut]
        if kind == 2:
            return text[cut // 2 : len(text) - cut // 2].upper()
        if kind == 3:
            return " ".join(rng.sample(text.split(" "), len(text.split(" "))))
        return text + "z" * cut

    left, right = [related() for _ in range(60)] + ["", None], base + ["", " _", None]
    frames = [spark.createDataFrame([(n,) for n in side], "n string") for side in (left, right)]
    for threshold in (0.72, 0.78, 1.0):
        found = {(r.left_name, r.right_name, r.score) for r in similar.similar_names(*frames, threshold).collect()}
        pairs = frames[0].distinct().withColumnRenamed("n", "l").crossJoin(frames[1].distinct().withColumnRenamed("n", "r"))
        scored = pairs.withColumn("score", similar.name_similarity(similar.F.col("l"), similar.F.col("r"))).filter(f"score >= {threshold} AND l IS NOT NULL AND r IS NOT NULL")
        assert found == {tuple(r) for r in scored.collect()} and len(found) > 5


def test_suggestions_scan_little(spark, spend_rows, event_rows):
    spend, events = spend_rows(GOOGLE, META), event_rows(BRAND, FACEBOOK, LINKEDIN)
    current = rules.all_rules(spark)
    unmatched = snapshot(coverage.unmatched_event_keys(spend, events, current, AS_OF))
    catalog = snapshot(rollups.spend_rollup(spend, current, AS_OF))
    assert physical(suggest.suggest_mappings(unmatched, catalog, current)).count("FileScan") < 20
