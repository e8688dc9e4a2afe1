"""One local session for all tests."""

from __future__ import annotations

import datetime as dt

import pytest

from tidemark.session import build_session, use_local_scratch


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    use_local_scratch(session)
    yield session
    session.stop()


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


SPEND_SCHEMA = (
    "date date, channel string, campaign_id string, campaign string, spend double, impressions bigint, clicks bigint, conversions double"
)
EVENT_SCHEMA = "user_id string, event_type string, event_date date, utm_source string, utm_campaign string, revenue double"


@pytest.fixture(scope="session")
def spend_rows(spark):
    """Builds a spend table from rows with ISO days."""
    return lambda *rows: spark.createDataFrame([(day(r[0]), *r[1:]) for r in rows], SPEND_SCHEMA)


@pytest.fixture(scope="session")
def event_rows(spark):
    """Builds an events table from rows with ISO days."""
    return lambda *rows: spark.createDataFrame([(r[0], r[1], day(r[2]), *r[3:]) for r in rows], EVENT_SCHEMA)
