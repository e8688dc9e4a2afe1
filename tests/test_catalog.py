"""Catalog, profiling, freshness, contracts and read-only SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.conftest import day
from tidemark.operators import adhoc, catalog


@pytest.fixture
def small(spend_rows, event_rows, spark):
    return {
        "marketing_spend": spend_rows(("2026-03-11", "a", "1", "c", 1.0, 1, 1, 0.0)),
        "user_events": event_rows(("u", "x", "2026-03-01", "a", None, 1.0), ("v", "x", "2026-02-01", "a", None, 1.0)),
        "campaigns": spark.createDataFrame([("1", "c", "a")], "campaign_id string, name string, channel string"),
    }


def test_freshness_and_range(spark, small):
    old = spark.createDataFrame([("2026-01-01",), ("no date",), (None,)], "created_at string")
    empty = spark.createDataFrame([], "date date")
    rows = {r.table_name: r for r in catalog.freshness({**small, "old": old, "empty": empty}, "2026-03-12").collect()}
    assert {name: r.status for name, r in rows.items()} == {"marketing_spend": "fresh", "user_events": "stale", "old": "outdated", "empty": "unknown"}
    assert (str(rows["user_events"].min_date), rows["user_events"].days_stale, rows["old"].date_column) == ("2026-02-01", 11, "created_at")
    span = catalog.source_date_range({**small, "old": old}, "2026-03-12").first()
    assert (str(span.min_date), str(span.max_date), span.stale_tables, span.outdated_tables) == ("2026-01-01", "2026-03-11", "user_events", "old")


def test_contracts(small):
    ready = catalog.validate_contracts(small, "2026-03-12")
    assert ready.filter("severity = 'error'").count() == 0
    broken = dict(small)
    del broken["campaigns"]
    broken["marketing_spend"] = small["marketing_spend"].drop("spend")
    broken["user_events"] = small["user_events"].withColumnRenamed("event_type", "event").withColumn("revenue", F.lit("text"))
    issues = {(t, s): m for t, s, m in catalog.contract_issues(broken)}
    assert issues[("campaigns", "error")] == "Missing canonical table."
    assert "spend" in issues[("marketing_spend", "error")]
    assert "event_type" in issues[("user_events", "warning")]
    assert "revenue" in issues[("user_events", "info")]
    renamed, changes = catalog.apply_contract_aliases(broken)
    assert changes == [("user_events", "event", "event_type")] and "event_type" in renamed["user_events"].columns
    assert catalog.apply_contract_aliases(small)[1] == []
    # Of two aliases the first listed one is taken, and no column is used twice.
    both, made = catalog.apply_contract_aliases({"marketing_spend": small["marketing_spend"].withColumnsRenamed({"channel": "source", "date": "day"})})
    assert sorted(made) == [("marketing_spend", "day", "date"), ("marketing_spend", "source", "channel")]


def test_list_and_profile(spark, small):
    listed = {r.table_name: (r.row_count, r.column_count, r.column_names) for r in catalog.list_tables(small).collect()}
    assert listed["user_events"] == (2, 6, "user_id, event_type, event_date, utm_source, utm_campaign, revenue")
    assert listed["marketing_spend"][2].endswith("(+2 more)")
    table = spark.createDataFrame([(i % 7, None if i % 4 == 0 else f"v{i}", day("2026-01-01")) for i in range(40)], "a int, `b c` string, d date")
    exact = {r.column_name: r for r in catalog.profile_table(table).collect()}
    assert (exact["a"].distinct_count, exact["a"].samples, exact["a"].data_type) == (7, "0, 1, 2, 3, 4", "int")
    assert (exact["b c"].null_pct, exact["b c"].distinct_count, exact["d"].samples) == (25.0, 30, "2026-01-01")
    sketched = {r.column_name: r.distinct_count for r in catalog.profile_table(table, approx=True).collect()}
    assert sketched["a"] == 7 and abs(sketched["b c"] - 30) <= 3
    nothing = catalog.profile_table(table.filter("false")).collect()
    assert [(r.row_count, r.distinct_count, r.samples) for r in nothing] == [(0, 0, "")] * 3
    text = [r.text for r in catalog.format_schema({"t": table}).orderBy("line").collect()]
    assert text[0] == "TABLE: t (40 rows)" and text[2].startswith("| b c | string | 30 | 25.0% |")
    assert catalog.sample_rows(table).count() == 3
    samples = {r.column_name: r.samples.split(", ") for r in catalog.profile_table(table, approx=True).collect()}
    assert set(samples["a"]) <= {str(i) for i in range(7)} and len(samples["a"]) == 5 and samples["d"] == ["2026-01-01"]
    assert len(samples["b c"]) == 5 and all(s.startswith("v") for s in samples["b c"])


def test_profile_exchanges_no_values(spark, tmp_path):
    """Values are counted as numbers; of texts, tasks hand on their first few."""
    spark.range(0, 5_000, 1, 4).selectExpr("id", "concat('value ', id % 1000) AS t", "if(id % 3 = 0, null, 'x') AS u", "cast(id AS double) / 7 AS f").write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    rows = {r.column_name: r for r in catalog.profile_table(table).collect()}
    assert [(r.row_count, r.distinct_count) for r in (rows[c] for c in ("id", "t", "u", "f"))] == [(5_000, 5_000), (5_000, 1_000), (5_000, 1), (5_000, 5_000)]
    assert rows["t"].samples == "value 0, value 1, value 10, value 100, value 101" and rows["u"].null_pct == 33.3
    plan = catalog._exact_counts(table)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "string" not in plan.split("Exchange")[1].split("+-")[0]
    least = catalog._least_values(table)
    handed = next(line for line in least._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line)
    assert "tasks" in handed
    # A task hands on no more than the samples of each column.
    texts = table.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(table.columns)])
    assert texts.rdd.getNumPartitions() * 4 * catalog.SAMPLES >= least.select(F.size(F.split("samples", ", ")).alias("n")).agg(F.sum("n")).first()[0]


READS = [
    "SELECT 1",
    "WITH cte AS (SELECT * FROM numbers) SELECT * FROM cte",
    "SELECT * FROM (SELECT n, count(*) AS c FROM numbers GROUP BY 1) t",
    "SELECT 1 AS n UNION ALL SELECT 2 AS n",
    "SELECT n, avg(n) OVER (ORDER BY n ROWS 6 PRECEDING) AS r FROM numbers;",
    "DESCRIBE numbers",
    "SHOW TABLES",
]
WRITES = [
    "DROP TABLE numbers",
    "-- safe\nDrOp   TaBlE numbers",
    "DELETE FROM numbers WHERE n < 0",
    "UPDATE numbers SET n = 0",
    "INSERT INTO numbers VALUES (1)",
    "WITH x AS (SELECT 1 AS n) INSERT INTO numbers SELECT n FROM x",
    "FROM numbers INSERT INTO a SELECT n INSERT INTO b SELECT n",
    "CREATE TABLE t AS SELECT 1",
    "CREATE TEMPORARY VIEW v AS SELECT 1",
    "ALTER TABLE numbers ADD COLUMN extra STRING",
    "TRUNCATE TABLE numbers",
    "SET spark.sql.shuffle.partitions = 1",
    "CACHE TABLE numbers",
    "REFRESH TABLE numbers",
    "WITH h AS (DELETE FROM numbers RETURNING *) SELECT * FROM h",
    "SELECT * FROM (UPDATE numbers SET n = 0 RETURNING *) t",
    "SELECT 1; SELECT 2",
    "SELECT * FROM numbers; DROP TABLE numbers",
    "",
    "  \n ",
    ";",
    "-- nothing",
]


@pytest.fixture
def numbers(spark):
    spark.range(10).withColumnRenamed("id", "n").createOrReplaceTempView("numbers")


@pytest.mark.parametrize("sql", READS)
def test_reads_are_allowed(spark, numbers, sql):
    adhoc.check_read_only(spark, sql)


@pytest.mark.parametrize("sql", WRITES)
def test_everything_else_is_refused(spark, numbers, sql):
    with pytest.raises(adhoc.ReadOnlyQueryError):
        adhoc.run_query(spark, sql)
    assert spark.table("numbers").count() == 10


def test_messages_and_paging(spark, numbers):
    with pytest.raises(adhoc.ReadOnlyQueryError, match="Multiple"):
        adhoc.check_read_only(spark, "SELECT 1; SELECT 2")
    with pytest.raises(adhoc.ReadOnlyQueryError, match="(?i)drop"):
        adhoc.check_read_only(spark, "DROP TABLE numbers")
    with pytest.raises(adhoc.ReadOnlyQueryError, match="Empty"):
        adhoc.check_read_only(spark, "")
    page = adhoc.run_query(spark, "SELECT n FROM numbers ORDER BY n", offset=4, limit=3)
    assert [r.n for r in page.collect()] == [4, 5, 6]
    assert adhoc.run_query(spark, "SELECT n FROM numbers").count() == 10


def test_query_sources(spark, numbers):
    spark.range(3).createOrReplaceTempView("other")
    sql = "WITH c AS (SELECT n FROM numbers) SELECT * FROM c WHERE n IN (SELECT id FROM other) AND n > (SELECT min(n) FROM numbers)"
    assert adhoc.query_sources(spark, sql) == ["numbers", "other"]


def test_custom_metric_and_benchmarks(spark):
    spend = spark.createDataFrame([("google-ads", 120.0), ("Organic Search", 9.0), ("unknown", 5.0), ("linkedin", None)], "channel string, cac double")
    metric = adhoc.CustomMetric("m", "Mean", "avg(cac)", "spend", benchmark_good=40, benchmark_ok=50, unit="$")
    assert adhoc.custom_metric(spend, metric, higher_is_better=False).first().verdict == "Average"
    rows = {r.channel: (r.benchmark, r.verdict) for r in adhoc.benchmark_join(spend, "channel", "cac").collect()}
    assert rows == {"google-ads": ("google_ads", "Average"), "Organic Search": ("organic", "Good"), "unknown": (None, None), "linkedin": ("linkedin", None)}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT java_method('java.lang.System', 'getProperty', 'user.dir')",
        "SELECT * FROM VALUES (1) t(a) WHERE reflect('java.util.UUID', 'randomUUID') <> ''",
        "WITH x AS (SELECT upper(try_reflect('java.lang.System', 'lineSeparator')) AS v) SELECT v FROM x",
        "SELECT (SELECT max(java_method('java.lang.System', 'nanoTime')))",
        "SELECT * FROM text.`/etc/hostname`",
        "SELECT a FROM VALUES (1) t(a) WHERE EXISTS (SELECT 1 FROM csv.`/tmp/x`)",
        "SELECT * FROM parquet.`/tmp/y` JOIN nowhere.z",
        "SELECT * FROM IDENTIFIER('text.`/etc/hostname`')",
        "SELECT IDENTIFIER('java_method')('java.lang.System', 'getProperty', 'user.dir')",
        "WITH x AS (SELECT IDENTIFIER('n') AS v FROM numbers) SELECT v FROM x",
        "SELECT TRANSFORM(n) USING 'cat' AS (b) FROM numbers",
        "SELECT b FROM (FROM numbers MAP n USING 'cat' AS b)",
        "EXECUTE IMMEDIATE 'CREATE OR REPLACE TEMP VIEW numbers AS SELECT 1 AS n'",
        "EXECUTE IMMEDIATE 'SELECT 1'",
        "BEGIN DROP VIEW numbers; END",
        "DECLARE VARIABLE x INT DEFAULT 1",
        "SET VARIABLE x = 2",
        "SET spark.sql.ansi.enabled = false",
        "RESET",
        "ADD JAR '/tmp/x.jar'",
        "LIST FILES",
        "ANALYZE TABLE numbers COMPUTE STATISTICS",
        "DESCRIBE QUERY SELECT * FROM text.`/etc/hostname`",
        "DESCRIBE QUERY SELECT java_method('java.lang.System', 'nanoTime')",
        "SELECT * FROM STREAM numbers",
        "SELECT * FROM numbers WHERE n IN (SELECT n FROM IDENTIFIER('numbers'))",
        "SELECT * FROM numbers, LATERAL (SELECT reflect('java.lang.Math', 'abs', n))",
        "SELECT transform(array(1), x -> java_method('java.lang.Math', 'abs', x))",
        "FROM numbers |> EXTEND java_method('java.lang.System', 'nanoTime') AS t",
        "SELECT from_protobuf(unhex('00'), 'M', '/etc/hostname')",
        "SELECT * FROM python_worker_logs()",
    ],
)
def test_reflection_and_files_are_refused(spark, numbers, sql):
    with pytest.raises(adhoc.ReadOnlyQueryError):
        adhoc.run_query(spark, sql)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT n, row_number() OVER w AS r FROM numbers WINDOW w AS (ORDER BY n DESC)",
        "SELECT * FROM (SELECT n FROM numbers) PIVOT (count(*) FOR n IN (1, 2))",
        "SELECT n, k, v FROM (SELECT n, n AS a FROM numbers) UNPIVOT (v FOR k IN (a))",
        "SELECT n, x FROM numbers LATERAL VIEW explode(array(n, n + 1)) t AS x",
        "SELECT a.n, b.m FROM numbers a JOIN LATERAL (SELECT a.n + 1 AS m) b",
        "WITH RECURSIVE r(x) AS (SELECT 1 UNION ALL SELECT x + 1 FROM r WHERE x < 5) SELECT max(x) FROM r",
        "SELECT n % 2 AS k, count(*) AS c FROM numbers GROUP BY ROLLUP (n % 2) HAVING count(*) > 1 ORDER BY k LIMIT 2 OFFSET 1",
        "SELECT * FROM numbers TABLESAMPLE (5 ROWS)",
        "SELECT * FROM range(3) r JOIN VALUES (1), (2) v(x) ON r.id = v.x",
        "SELECT /*+ BROADCAST(b) */ a.n FROM numbers a LEFT ANTI JOIN numbers b ON a.n = b.n",
        "FROM numbers |> WHERE n > 3 |> AGGREGATE sum(n) AS s",
        "SELECT filter(array(n, 2), x -> x > 1) AS f, (SELECT min(n) FROM numbers) AS m FROM numbers",
        "SELECT n FROM numbers INTERSECT SELECT 1 EXCEPT SELECT 2",
        "DESCRIBE QUERY SELECT n FROM numbers",
        "SHOW COLUMNS IN numbers",
        "EXPLAIN SELECT n FROM numbers",
    ],
)
def test_queries_of_many_kinds_run(spark, numbers, sql):
    adhoc.run_query(spark, sql).collect()


def test_a_view_may_read_what_it_likes(spark, tmp_path):
    """Whoever registers a view decides what it reads, files and Python included."""
    (tmp_path / "a.txt").write_text("x\ny\n")
    lines = spark.read.text(str(tmp_path)).mapInPandas(lambda batches: batches, "value string")
    lines.createOrReplaceTempView("lines_of_file")
    assert adhoc.run_query(spark, "SELECT count(*) AS n FROM lines_of_file").first().n == 2


@pytest.mark.parametrize(
    "expression",
    [
        "java_method('java.lang.System', 'getProperty', 'user.dir')",
        "count(reflect('java.util.UUID', 'randomUUID'))",
        "max((SELECT count(*) FROM text.`/etc/hostname`))",
        "sum(CASE WHEN cac IN (SELECT n FROM numbers) THEN 1 END)",
        "IDENTIFIER('java_method')('java.lang.System', 'nanoTime')",
        "sum(cac",
        "sum(cac) FROM numbers",
    ],
)
def test_metrics_reach_their_table_only(spark, numbers, expression):
    spend = spark.createDataFrame([("a", 1.0)], "channel string, cac double")
    with pytest.raises(adhoc.ReadOnlyQueryError):
        adhoc.custom_metric(spend, adhoc.CustomMetric("m", "M", expression, "spend"))


@pytest.mark.parametrize(
    ("metric", "value", "verdict"),
    [("mer", 3.0, "Good"), ("mer", 1.0, "Poor"), ("payback_months", 13.0, "Average"), ("payback_months", 30.0, "Poor"), ("retention_week", 61.0, "Good"), ("retention_month", 31.0, "Average")],
)
def test_benchmarks_that_hold_for_every_row(spark, metric, value, verdict):
    row = adhoc.benchmark_join(spark.createDataFrame([(value,)], "v double"), None, "v", metric=metric).first()
    assert (row.benchmark, row.verdict) == (metric, verdict)
    with pytest.raises(ValueError, match="channel"):
        adhoc.benchmark_join(spark.createDataFrame([(value,)], "v double"), None, "v")
