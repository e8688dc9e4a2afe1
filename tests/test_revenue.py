"""Attribution, anomalies, drift and forecasts against plain Python."""

from __future__ import annotations

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import anomaly, channels, forecast
from tests.conftest import day


def coalition_shapley(journey, revenue):
    """Shapley values by averaging over all orders in which the channels can join."""
    names = sorted(set(journey))
    value = lambda group: revenue * sum(journey.count(c) for c in group) / len(journey)
    totals = dict.fromkeys(names, 0.0)
    orders = list(itertools.permutations(names))
    for order in orders:
        for i, name in enumerate(order):
            totals[name] += value(order[: i + 1]) - value(order[:i])
    return {name: round(total / len(orders), 4) for name, total in totals.items()}


def test_shapley_equals_enumeration(spark):
    rng = random.Random(3)
    journeys = {f"u{i}": [rng.choice("abcd") for _ in range(rng.randint(1, 9))] for i in range(60)}
    revenue = {user: rng.choice([0.0, -5.0, round(rng.uniform(1, 500), 2)]) for user in journeys if user != "u7"}
    touches = spark.createDataFrame([(u, c) for u, j in journeys.items() for c in j], "user_id string, channel string")
    money = spark.createDataFrame(list(revenue.items()), "user_id string, revenue double")
    expected = {}
    for user, journey in journeys.items():
        if revenue.get(user, 0) > 0:
            for name, value in coalition_shapley(journey, revenue[user]).items():
                expected[name] = expected.get(name, 0.0) + value
    rows = channels.shapley_attribution(touches, money).collect()
    assert {r.channel for r in rows} == set(expected)
    for row in rows:
        assert row.attributed_revenue == pytest.approx(expected[row.channel], abs=0.02)
    assert sum(r.attributed_revenue for r in rows) == pytest.approx(sum(v for v in revenue.values() if v > 0), abs=0.1)
    assert sum(r.pct for r in rows) == pytest.approx(100, abs=0.3)


def test_touch_models(spark):
    touches = spark.createDataFrame(
        [("a", 1, "x", 0.0), ("a", 2, "y", 10.0), ("a", 3, "z", 5.0), ("b", 1, "y", 0.0)],
        "user_id string, ts int, channel string, revenue double",
    )
    assert [(r.channel, r.converters, r.attributed_revenue) for r in channels.first_touch(touches).collect()] == [("x", 1, 15.0)]
    assert [(r.channel, r.attributed_revenue) for r in channels.last_touch(touches).collect()] == [("z", 15.0)]


def test_channel_attribution_keeps_both_sides(spend_rows, event_rows):
    spend = spend_rows(("2024-01-01", "a", "1", "c", 100.0, 1, 1, 0.0), ("2024-01-01", "b", "1", "c", 0.0, 1, 1, 0.0))
    events = event_rows(
        ("u", "purchase", "2024-01-01", "a", None, 150.0),
        ("u", "purchase", "2024-01-02", "a", None, 50.0),
        ("v", "purchase", "2024-01-02", "d", None, 200.0),
        ("v", "signup", "2024-01-02", "b", None, 0.0),
    )
    rows = {r.channel: (r.spend, r.conversions, r.revenue, r.roas, r.revenue_share_pct) for r in channels.channel_attribution(spend, events).collect()}
    assert rows == {"a": (100.0, 1, 200.0, 2.0, 50.0), "b": (0.0, 0, 0.0, None, 0.0), "d": (0.0, 1, 200.0, None, 50.0)}


def series(spark, values):
    return spark.createDataFrame([(day(f"2024-01-{i + 1:02d}"), v) for i, v in enumerate(values)], "date date, value double")


def test_anomalies(spark):
    values = [100.0] * 20 + [1000.0] + [101.0] * 5
    rows = anomaly.detect_anomalies(series(spark, values), "value", "2024-01-27").collect()
    deviation = np.std(values, ddof=1)
    assert [(r.status, r.z_score) for r in rows] == [("Spike", round((1000 - np.mean(values)) / deviation, 2))]
    assert anomaly.anomaly_explanation(anomaly.detect_anomalies(series(spark, values), "value", "2024-01-27")).first().days == 1
    assert anomaly.detect_anomalies(series(spark, [5.0] * 9), "value", "2024-01-10").count() == 0


def test_drift_and_alert(spark):
    values = [10.0] * 7 + [15.0] * 8
    rows = {r.period: r for r in anomaly.detect_data_drift(series(spark, values), "value", "2024-01-15").collect()}
    assert (rows["current"].n_rows, rows["previous"].n_rows) == (8, 7)
    assert (rows["current"].avg_change_pct, rows["current"].total_change_pct, rows["current"].needs_review) == (50.0, 71.4, True)
    alert = anomaly.drift_alert(series(spark, values), "value", "2024-01-15").first()
    assert (alert.change_pct, alert.direction) == (50.0, "up")
    assert anomaly.drift_alert(series(spark, values), "value", "2024-01-15", threshold_pct=50.1).count() == 0
    lonely = anomaly.detect_data_drift(series(spark, [1.0]), "value", "2024-01-01").collect()
    assert all(r.avg_change_pct is None and not r.needs_review for r in lonely)


def plain_line(values, horizon):
    x = np.arange(len(values))
    slope, start = np.polyfit(x, values, 1)
    spread = math.sqrt(np.sum((values - (start + slope * x)) ** 2) / max(len(values) - 2, 1))
    points = [max(start + slope * (len(values) + h), 0.0) for h in range(horizon)]
    return [(p, max(p - spread, 0.0), p + spread) for p in points]


def plain_smoothing(values, alpha=0.3):
    level, errors = values[0], []
    for value in values[1:]:
        level = alpha * value + (1 - alpha) * level
        errors.append(abs(level - value))
    spread = sum(errors) / len(errors) if errors else 0.0
    return level, max(level - spread, 0.0), level + spread


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("columns", "order_cols"),
    [("ts timestamp", ("ts",)), ("ts timestamp_ntz, event_id long", ("ts", "event_id")), ("ts date", ("ts",)), ("ts timestamp, event_id int", ("ts", "event_id")), ("ts string", ("ts",)), ("ts date, event_id double", ("ts", "event_id"))],
)
def test_touches_of_many_users_by_hash(spark, columns, order_cols):
    """Against plain picking, with missing times first and names as text; by a hash aggregate where the order fits a number."""
    rng = random.Random(11)
    kinds = {"timestamp": lambda: dt.datetime(1950 + rng.randint(0, 200), 1, 1, rng.randint(0, 23), 0, 0, rng.randint(0, 9)), "date": lambda: dt.date(2024, 1, rng.randint(1, 28)), "string": lambda: f"2024-01-{rng.randint(10, 28)}"}
    kinds |= {"timestamp_ntz": kinds["timestamp"], "long": lambda: rng.randint(-(2**62), 2**62), "int": lambda: rng.randint(-9, 9), "double": rng.random}
    makers = [kinds[part.split()[1]] for part in columns.split(", ")]
    rows, seen = [], set()
    for _ in range(400):
        order = tuple(None if i == 0 and rng.random() < 0.05 else make() for i, make in enumerate(makers))
        user = f"u{rng.randint(0, 40)}"
        if (user, order) not in seen:
            seen.add((user, order))
            rows.append((user, rng.choice(["a", "b", "été", None]), *order, float(rng.randint(-2, 5))))
    touches = spark.createDataFrame(rows, f"user_id string, channel string, {columns}, revenue double")
    key = lambda r: tuple((v is not None, v) if v is not None else (False,) for v in r[2:-1])
    for pick, model in ((min, channels.first_touch), (max, channels.last_touch)):
        expected = {}
        for user in {r[0] for r in rows}:
            own = [r for r in rows if r[0] == user]
            if (revenue := sum(r[-1] for r in own)) > 0:
                n, total = expected.get(pick(own, key=key)[1], (0, 0.0))
                expected[pick(own, key=key)[1]] = (n + 1, total + revenue)
        found = model(touches, order_cols)
        assert {r.channel: (r.converters, r.attributed_revenue) for r in found.collect()} == expected
        if "string" not in columns and "double" not in columns:
            by_user = plan_of(found).split("touches")[0]
            assert "SortAggregate(key=[user_id" not in by_user and "HashAggregate(keys=[user_id" in by_user


@pytest.mark.parametrize("alpha", [0.0, 1e-7, 0.001, 0.3, 0.999, 1.0])
def test_smoothing_of_any_length(spark, alpha):
    """Several series of thousands of days, some of them empty of values, against a loop."""
    rng = random.Random(12)
    lengths = {"long": 5_000, "one": 1, "two": 2, "middle": 900}
    rows = [(k, dt.date(2000, 1, 1) + dt.timedelta(days=2 * i), None if rng.random() < 0.02 else rng.uniform(0, 1e4)) for k, n in lengths.items() for i in range(n)]
    rng.shuffle(rows)
    daily = spark.createDataFrame(rows, "k string, date date, value double")
    found = {r.k: (r.value, r.upper) for r in forecast.forecast_exponential(daily, 1, ["k"], alpha=alpha).collect()}
    for k in lengths:
        values = [v or 0.0 for _, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        level, error = values[0], 0.0
        for v in values[1:]:
            level = alpha * v + (1 - alpha) * level
            error += abs(level - v)
        spread = error / (len(values) - 1) if len(values) > 1 else 0.0
        assert found[k] == pytest.approx((level, level + spread), abs=0.011)
    with pytest.raises(ValueError):
        forecast.forecast_exponential(daily, 1, ["k"], alpha=1.5)


def test_forecasts_gather_no_series(spark):
    daily = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1.0)], "k string, date date, value double")
    for fit in (forecast.forecast_linear, forecast.forecast_exponential):
        plan = plan_of(fit(daily, 3, ["k"]))
        assert "collect_list" not in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("values", [[3.0, 5.0, 4.0, 8.0, 9.5], [50.0, 30.0, 12.0], [7.0, 7.0], [1e9, 1.1e9, 1.2e9]])
def test_forecasts_match_loops(spark, values):
    line = forecast.forecast_linear(series(spark, values), 6).orderBy("day_offset").collect()
    for row, expected in zip(line, plain_line(np.array(values), 6), strict=True):
        assert (row.value, row.lower, row.upper) == pytest.approx(expected, abs=0.011, rel=1e-9)
    flat = forecast.forecast_exponential(series(spark, values), 3).collect()
    assert len(flat) == 3
    for row in flat:
        assert (row.value, row.lower, row.upper) == pytest.approx(plain_smoothing(values), abs=0.011, rel=1e-9)


def test_forecast_of_short_series(spark):
    assert {(r.value, r.lower, r.upper) for r in forecast.forecast_linear(series(spark, [4.0]), 2).collect()} == {(4.0, 4.0, 4.0)}
    assert {(r.value, r.lower, r.upper) for r in forecast.forecast_linear(series(spark, []), 2).collect()} == {(0.0, 0.0, 0.0)}
    assert {(r.value, r.upper) for r in forecast.forecast_exponential(series(spark, []), 2).collect()} == {(0.0, 0.0)}


def test_many_series_and_trend(spark):
    frame = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") % 100).alias("k"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 100).cast("int")).alias("date"),
        (F.floor(F.col("id") / 100) * F.when(F.col("id") % 100 < 50, 10).otherwise(-10) + 100).cast("double").alias("value"),
    )
    trends = forecast.with_trend(forecast.forecast_linear(frame, 5, ["k"]), ["k"]).groupBy("trend").count().collect()
    assert {r.trend: r["count"] for r in trends} == {"Up": 50, "Down": 50}


def test_growth_kpis(spend_rows, event_rows):
    spend = spend_rows(*[(f"2024-01-{d:02d}", "a", "1", "c", 70.0, 1, 1, 0.0) for d in range(1, 31)])
    events = event_rows(*[(u, "x", f"2024-01-{d:02d}", "a", None, 0.0) for d in range(1, 31) for u in ("p", "q")])
    rows = {r.kpi: r for r in forecast.forecast_growth_kpis(spend, events, "2024-01-30").collect()}
    assert (rows["Daily Spend"].current_avg, rows["Daily Spend"].forecast, rows["Daily Spend"].trend) == (80.0, 70.0, "Flat")
    users = rows["Daily Active Users"]
    assert (users.current_avg, users.avg_daily_users, users.forecast) == (0.29, 2.0, 2.0)
