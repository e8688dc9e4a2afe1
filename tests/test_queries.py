"""Every registered query against its SQL, and the shape of its plan."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry_point
import check
from tidemark.plans.registry import ALL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = list(ALL)


@pytest.fixture(scope="module")
def connection():
    database = duckdb.connect()
    for table in check.TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return database


def test_every_query_has_sql():
    assert set(NAMES) <= set(entry_point.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    _, problems = check.compare(spark, connection, SF_DIR, name)
    assert problems == []


@pytest.mark.parametrize("absent", ["public_tokenizers", "xxhash", "tidemark.llm", "corpus_pipeline"])
def test_other_queries_stand_without_the_corpus_ones(absent):
    """In a process of its own, in which one module can't be imported."""
    code = f"""
import sys
sys.modules[{absent!r}] = None
import __spark_entry__ as entry
assert set(entry.ALL) <= set(entry.queries()) and set(entry.ALL) <= set(entry.oracle_sql())
assert "pipeline" not in entry.queries()
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(entry_point.__file__)))


def test_entry(spark):
    assert entry_point.entry(spark).columns == ["step", "step_order", "users"]


@pytest.mark.parametrize("name", ["suggest_mappings", "channel_attribution", "mapping_coverage", "shapley_attribution", "growth_summary", "attribution_bridge"])
def test_no_nested_loops(spark, name):
    plan = entry_point.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_date_window_reaches_the_scan(spark, tmp_path):
    """A table partitioned by day is pruned to the window."""
    from tidemark.operators.anomaly import detect_data_drift
    from tidemark.plans import canonical

    path = str(tmp_path / "events")
    canonical.user_events(spark, SF_DIR).write.partitionBy("event_date").parquet(path)
    plan = detect_data_drift(spark.read.parquet(path), "revenue", canonical.AS_OF, "event_date")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((event_date" in plan or "PartitionFilters: [isnotnull(event_date" in plan
    assert "ReadSchema: struct<revenue:decimal(18,2)>" in plan
