"""Industry thresholds and the good / average / poor verdict."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values: (good, ok) per metric. Retention in percent, CAC in currency,
# the others as ratios or months.
RETENTION = {"month": (45.0, 30.0), "week": (60.0, 40.0)}
CAC = {
    "google_ads": (50.0, 150.0),
    "meta_ads": (40.0, 120.0),
    "linkedin": (100.0, 300.0),
    "organic": (10.0, 50.0),
}
MER = (3.0, 1.5)
LTV_CAC = (3.0, 1.5)
PAYBACK_MONTHS = (12.0, 24.0)
DEFAULT_RETENTION = 30.0


def classify_metric(value: Column, good: Column, ok: Column, higher_is_better: bool = True) -> Column:
    """Good, Average or Poor; null when the value is null."""
    if higher_is_better:
        reaches_good, reaches_ok = value >= good, value >= ok
    else:
        reaches_good, reaches_ok = value <= good, value <= ok
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(reaches_good, F.lit("Good"))
        .when(reaches_ok, F.lit("Average"))
        .otherwise(F.lit("Poor"))
    )


def channel_threshold(channel: Column, table: dict[str, tuple[float, float]] | None = None) -> Column:
    """``struct(benchmark, good, ok)`` of the first table entry that matches a channel.

    A channel matches when its cleaned name contains the entry's name or the
    other way round. The table is a handful of constants, so it becomes one
    CASE inside code generation instead of a join. Null without a match.
    """
    clean = F.translate(F.lower(channel), " -", "__")
    match = None
    for name, (good, ok) in (table or CAC).items():
        row = F.struct(F.lit(name).alias("benchmark"), F.lit(good).alias("good"), F.lit(ok).alias("ok"))
        hit = F.contains(clean, F.lit(name)) | F.contains(F.lit(name), clean)
        match = F.when(hit, row) if match is None else match.when(hit, row)
    return match


#: Metrics with one threshold for all rows: (good, ok) and whether more is better.
METRICS = {
    "mer": (MER, True),
    "ltv_cac": (LTV_CAC, True),
    "payback_months": (PAYBACK_MONTHS, False),
    "retention_month": (RETENTION["month"], True),
    "retention_week": (RETENTION["week"], True),
}


def metric_threshold(metric: str, channel: Column | None = None) -> tuple[Column, bool]:
    """``struct(benchmark, good, ok)`` of a metric, and whether more is better; ``cac`` goes by channel."""
    if metric == "cac":
        if channel is None:
            raise ValueError("the threshold of cac depends on a channel")
        return channel_threshold(channel), False
    (good, ok), higher = METRICS[metric]
    return F.struct(F.lit(metric).alias("benchmark"), F.lit(good).alias("good"), F.lit(ok).alias("ok")), higher
