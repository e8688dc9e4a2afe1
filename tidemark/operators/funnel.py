"""Conversion funnels.

A user reaches step k when they have an event of every step up to k, in any
order of time. One aggregation per user finds how far each user gets, however
many steps there are, and partial aggregation shrinks a user with very many
events before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike, between_days
from tidemark.functions.numeric import percent, rounded
from tidemark.operators.churn import churn_inactivity

# Step lists that go by a name, and what the steps mean.
PRESETS: dict[str, tuple[str, ...]] = {
    "default": ("signup", "activation", "purchase"),
    "saas": ("signup", "activation", "trial_start", "purchase"),
    "ecommerce": ("visit", "add_to_cart", "checkout", "purchase"),
    "plg": ("signup", "activation", "feature_adoption", "expansion"),
}
STEP_DESCRIPTIONS: dict[str, str] = {
    "signup": "User creates an account",
    "activation": "User completes initial setup or key action",
    "trial_start": "User starts a paid trial",
    "purchase": "User makes a purchase or subscribes",
    "add_to_cart": "User adds a product to cart",
    "checkout": "User begins the checkout process",
    "visit": "User visits the product page",
    "feature_adoption": "User activates a core feature",
    "expansion": "User upgrades or expands usage",
    "onboarding_complete": "User completes the onboarding flow",
    "referral": "User refers another user",
    "renewal": "User renews their subscription",
}


def parse_steps(steps: str | Sequence[str]) -> list[str]:
    """Steps from a comma-separated list, a preset name or a sequence of names."""
    if isinstance(steps, str):
        steps = PRESETS.get(steps.strip().lower()) or steps.split(",")
    return [name.strip() for name in steps if name.strip()]


def describe_step(step: str) -> str:
    """What a step means; the step name in title case when it is not a known one."""
    return STEP_DESCRIPTIONS.get(step.strip().lower(), step.replace("_", " ").title())


def _reached(names: Sequence[str], condition: Column | None = None) -> list[Column]:
    """Per-user aggregates: 1 for every step of which the user has an event."""
    flags = []
    for index, name in enumerate(names):
        hit = F.col("event_type") == name
        if condition is not None:
            hit = hit & condition
        if index:
            # Rows without a user count as one user in the first step only.
            hit = hit & F.col("user_id").isNotNull()
        flags.append(F.max(F.when(hit, 1).otherwise(0)))
    return flags


def _passed(prefix: str, count: int) -> list[Column]:
    """Users that have every step up to each one."""
    columns = []
    for last in range(count):
        everything = F.lit(True)
        for index in range(last + 1):
            everything = everything & (F.col(f"{prefix}{index}") == 1)
        columns.append(F.count(F.when(everything, 1)).alias(f"{prefix}{last}"))
    return columns


def _step_counts(events: DataFrame, names: list[str], scope: Column) -> DataFrame:
    """One row with the users of each step in columns s0, s1, ..."""
    relevant = events.filter(F.col("event_type").isin(sorted(set(names))) & scope)
    flags = [flag.alias(f"s{i}") for i, flag in enumerate(_reached(names))]
    return relevant.groupBy("user_id").agg(*flags).agg(*_passed("s", len(names)))


def _unfold(counts: DataFrame, rows: list[Column]) -> DataFrame:
    """The structs in ``rows`` of a one-row frame as rows of their own."""
    return counts.select(F.inline(F.array(*rows)))


def funnel_conversion(
    events: DataFrame,
    steps: str | Sequence[str],
    date_from: DateLike | None = None,
    date_to: DateLike | None = None,
) -> DataFrame:
    """``step, step_order, users`` for each step; days are inclusive."""
    names = parse_steps(steps)
    counts = _step_counts(events, names, between_days(F.col("event_date"), date_from, date_to))
    return _unfold(
        counts,
        [
            F.struct(F.lit(name).alias("step"), F.lit(i + 1).alias("step_order"), F.col(f"s{i}").alias("users"))
            for i, name in enumerate(names)
        ],
    )


def analyze_funnel(
    events: DataFrame,
    steps: str | Sequence[str],
    date_from: DateLike | None = None,
    date_to: DateLike | None = None,
) -> DataFrame:
    """Funnel with conversion from the first step, drop-off from the step before
    and a mark at the step that loses the largest share."""
    names = parse_steps(steps)
    counts = _step_counts(events, names, between_days(F.col("event_date"), date_from, date_to))
    zero = F.lit(0.0)
    drops = [
        F.coalesce(percent(F.col(f"s{i - 1}") - F.col(f"s{i}"), F.col(f"s{i - 1}"), None), zero)
        for i in range(1, len(names))
    ]
    # array_position finds the first of equal drops.
    worst = F.array_position(F.array(*drops), F.array_max(F.array(*drops))) if drops else F.lit(0)
    described = counts.withColumn("worst", worst)
    return _unfold(
        described,
        [
            F.struct(
                F.lit(name).alias("step"),
                F.lit(i + 1).alias("step_order"),
                F.col(f"s{i}").alias("users"),
                F.coalesce(percent(F.col(f"s{i}"), F.col("s0")), zero).alias("conversion_pct"),
                (rounded(drops[i - 1], 1) if i else F.lit(None).cast("double")).alias("drop_off_pct"),
                (F.col("worst") == i if i else F.lit(False)).alias("is_worst_drop"),
                F.lit(describe_step(name)).alias("description"),
            )
            for i, name in enumerate(names)
        ],
    )


def funnel_ab_comparison(
    events: DataFrame,
    steps: str | Sequence[str],
    period_a: tuple[DateLike | None, DateLike | None],
    period_b: tuple[DateLike | None, DateLike | None],
) -> DataFrame:
    """Conversion of two periods side by side, from one scan and one shuffle.

    ``verdict`` is improved above +2 points, regressed below -2.
    """
    names = parse_steps(steps)
    in_a = between_days(F.col("event_date"), *period_a)
    in_b = between_days(F.col("event_date"), *period_b)
    relevant = events.filter(F.col("event_type").isin(sorted(set(names))) & (in_a | in_b))
    flags = [f.alias(f"a{i}") for i, f in enumerate(_reached(names, in_a))]
    flags += [f.alias(f"b{i}") for i, f in enumerate(_reached(names, in_b))]
    counts = relevant.groupBy("user_id").agg(*flags).agg(*_passed("a", len(names)), *_passed("b", len(names)))

    def conversion(side: str, index: int) -> Column:
        return F.coalesce(percent(F.col(f"{side}{index}"), F.col(f"{side}0"), None), F.lit(0.0))

    rows = []
    for i, name in enumerate(names):
        delta = rounded(conversion("b", i) - conversion("a", i), 1)
        rows.append(
            F.struct(
                F.lit(name).alias("step"),
                F.lit(i + 1).alias("step_order"),
                F.col(f"a{i}").alias("users_a"),
                F.col(f"b{i}").alias("users_b"),
                rounded(conversion("a", i), 1).alias("conversion_a_pct"),
                rounded(conversion("b", i), 1).alias("conversion_b_pct"),
                delta.alias("delta_pp"),
                F.when(delta > 2, "improved").when(delta < -2, "regressed").otherwise("stable").alias("verdict"),
            )
        )
    return _unfold(counts, rows)


def funnel_diagnosis(
    events: DataFrame,
    steps: str | Sequence[str],
    as_of: DateLike,
    date_from: DateLike | None = None,
    date_to: DateLike | None = None,
    inactive_days: int = 30,
) -> dict[str, DataFrame]:
    """The funnel and the inactivity segments of the same events."""
    return {
        "funnel": analyze_funnel(events, steps, date_from, date_to),
        "churn": churn_inactivity(events, as_of, inactive_days),
    }
