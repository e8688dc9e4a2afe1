"""Guarded ratios and exact half-up rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(value: Column, digits: int) -> Column:
    """Round half up, as a double.

    Going through a decimal makes ties independent of the binary form of the
    double, so engines and partition orders agree on the digit. Values that fit
    no decimal (NaN, infinity) become null.
    """
    return F.round(value.try_cast("decimal(38,10)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column, digits: int | None = None) -> Column:
    """``numerator / denominator`` as a double, null unless the denominator is positive."""
    quotient = F.when(denominator > 0, numerator.cast("double") / denominator.cast("double"))
    return quotient if digits is None else rounded(quotient, digits)


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """``part`` in percent of ``whole``; null unless ``whole`` is positive."""
    return ratio(part.cast("double") * 100.0, whole, digits)


def change_pct(current: Column, previous: Column, digits: int | None = 1) -> Column:
    """Change from ``previous`` to ``current`` in percent; null unless ``previous`` is positive."""
    return percent(current.cast("double") - previous.cast("double"), previous, digits)


def mean(value: Column) -> Column:
    """Aggregate: average as sum / count in double, exact for decimal inputs."""
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def zero_if_null(value: Column) -> Column:
    """``value`` or 0."""
    return F.coalesce(value, F.lit(0))


def count_if(condition: Column) -> Column:
    """Aggregate: rows for which ``condition`` is true (0 when there are none)."""
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, value: Column) -> Column:
    """Aggregate: sum of ``value`` where ``condition`` holds; 0 when no row matches."""
    return F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
