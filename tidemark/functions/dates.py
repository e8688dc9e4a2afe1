"""Date windows counted back from an explicit ``as_of`` day.

All bounds are literals computed while the plan is built and compared with the
bare column, so they reach the Parquet scan and prune date partitions.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

DateLike = date | str


def to_date(value: DateLike) -> date:
    """A date from a date or an ISO string."""
    return value if isinstance(value, date) else date.fromisoformat(value)


def since(column: Column, as_of: DateLike, days: int) -> Column:
    """The last ``days`` days: on or after ``as_of - days``, open at the top.

    Rows dated ``as_of`` or later count as current, so a table with data for
    today spans ``days + 1`` calendar days.
    """
    return column >= F.lit(to_date(as_of) - timedelta(days=days))


def before(column: Column, as_of: DateLike, days: int) -> Column:
    """The ``days`` days that end where :func:`since` starts."""
    start = to_date(as_of) - timedelta(days=2 * days)
    end = to_date(as_of) - timedelta(days=days)
    return (column >= F.lit(start)) & (column < F.lit(end))


def since_both(column: Column, as_of: DateLike, days: int) -> Column:
    """The current and the previous period together, as one bound for the scan."""
    return since(column, as_of, 2 * days)


def between_days(column: Column, first: DateLike | None, last: DateLike | None) -> Column:
    """Inclusive day range for a date or timestamp column; an open side for None."""
    bounds = []
    if first:
        bounds.append(column >= F.lit(to_date(first)))
    if last:
        bounds.append(column < F.lit(to_date(last) + timedelta(days=1)))
    if not bounds:
        return F.lit(True)
    return bounds[0] if len(bounds) == 1 else bounds[0] & bounds[1]


def days_before(as_of: DateLike, column: Column) -> Column:
    """Days from ``column`` to ``as_of``."""
    return F.date_diff(F.lit(to_date(as_of)), column)


# The days and seconds of unix time that years 1 to 9999 span.
_DAYS = (-719_162, 2_932_896)
_SECONDS = (-62_135_596_800, 253_402_300_799)


def _epoch(seconds: Column) -> Column:
    """Unix seconds, also with a fraction or as text; null where unreadable."""
    return seconds.cast("string").try_cast("decimal(38,6)")


def date_from_epoch(seconds: Column) -> Column:
    """UTC day of a unix timestamp, whatever the session time zone; null for 0, null and years beyond 9999."""
    number = _epoch(seconds)
    day = F.floor(number / F.lit(86400)).try_cast("int")
    return F.when((number != 0) & day.between(*_DAYS), F.date_from_unix_date(day))


def time_from_epoch(seconds: Column) -> Column:
    """Timestamp of unix seconds without their fraction; null where unreadable or beyond year 9999."""
    whole = _epoch(seconds).try_cast("bigint")
    return F.when(whole.between(*_SECONDS), F.timestamp_seconds(whole))
