"""Files, databases and the source registry."""

from __future__ import annotations

import pytest

from tidemark.session import scratch_dir, snapshot
from tidemark.sources import database, files
from tidemark.sources.registry import SourceRegistry


def test_table_names():
    assert files.table_name("My-Report 2024") == "my_report_2024"
    assert files.table_name("2024 spend") == "t_2024_spend"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "marketing_spend.csv").write_text("date,cost,channel,clicks\n2026-03-01,1.50,a,3\n2026-03-02,2,b,\n", encoding="utf-8")
    (tmp_path / "Extra Table.csv").write_text("k,v\n1,x\n2,y\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("", encoding="utf-8")
    (tmp_path / "notes.txt").write_text("no table", encoding="utf-8")
    return tmp_path


def test_folder_of_csv(spark, folder):
    tables = files.load_csv_dir(spark, str(folder))
    assert {"marketing_spend", "extra_table"} <= tables.keys() and not {"notes", "empty"} & tables.keys()
    assert dict(tables["marketing_spend"].dtypes) == {"date": "date", "cost": "double", "channel": "string", "clicks": "bigint"}
    assert dict(tables["extra_table"].dtypes) == {"k": "int", "v": "string"}
    assert spark.table("extra_table").count() == 2
    assert files.load_csv_dir(spark, str(folder / "missing")) == {}
    named = files.load_csv(spark, str(folder / "Extra Table.csv"), "renamed", "k string, v string")
    assert dict(named.dtypes)["k"] == "string" and spark.table("renamed").count() == 2


def test_unreadable_file_is_skipped(spark, folder, monkeypatch):
    real = files.load_csv

    def fail(session, path, name=None, schema=None):
        if name == "extra_table":
            return session.read.parquet(path)
        return real(session, path, name, schema)

    monkeypatch.setattr(files, "load_csv", fail)
    assert "extra_table" not in files.load_csv_dir(spark, str(folder))


def test_registry(spark, folder, tmp_path_factory):
    second = tmp_path_factory.mktemp("second")
    (second / "extra_table.csv").write_text("k\n7\n", encoding="utf-8")
    registry = SourceRegistry()
    for path in (str(folder), str(second), str(folder), ""):
        registry.register_csv(path)
    registry.register_jdbc("postgresql://h/db", "a", "b", "a")
    assert registry.csv_dirs == [str(folder), str(second)] and len(registry.jdbc_tables) == 2
    registry.jdbc_tables.clear()
    assert [r.k for r in registry.load_sources(spark)["extra_table"].collect()] == [7]


def test_database_options():
    assert database.jdbc_options("postgresql://me:pw@host:5433/shop?ssl=true") == {
        "url": "jdbc:postgresql://host:5433/shop?ssl=true", "user": "me", "password": "pw",
    }
    assert database.jdbc_options("jdbc:other:x") == {"url": "jdbc:other:x"}
    with pytest.raises(ValueError):
        database.jdbc_options("mysql://host/db")


def test_database_read_needs_complete_ranges(spark):
    with pytest.raises(ValueError):
        database.load_jdbc(spark, "postgresql://h/db", "t", partition_column="id", lower_bound=1)


def test_extracts(spark, tmp_path):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string")
    assert files.write_extract(table.filter("false"), str(tmp_path / "none")) == "" and not (tmp_path / "none").exists()
    path = files.write_extract(table, str(tmp_path / "out.csv"))
    assert files.load_csv(spark, path, "out").count() == 2
    partitioned = files.write_extract(table, str(tmp_path / "out.parquet"), "parquet", ["k"])
    plan = spark.read.parquet(partitioned).filter("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(k" in plan


def test_scratch_folder_is_below_the_shared_one(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark)
    assert path != scratch_dir(spark) and (base is None or path.startswith(base.rstrip("/") + "/"))
    assert snapshot(spark.range(5)).count() == 5


def test_rows_that_do_not_fit_the_contract_are_handed_out(spark, tmp_path):
    path = tmp_path / "marketing_spend.csv"
    path.write_text('date,channel,spend,conversions,clicks\n2024-01-02,a,"1,200.50",1.5,7\n2024-01-03,b,3.25,2,8.5\nsoon,c,1,1,1\n2024-01-05,d,4,,9\n')
    table = files.load_csv(spark, str(path))
    assert dict(table.dtypes) == {"date": "date", "channel": "string", "spend": "double", "conversions": "double", "clicks": "bigint"}
    rows = {r.channel: (str(r.date), r.spend, r.conversions, r.clicks) for r in table.collect()}
    assert rows == {"a": ("2024-01-02", None, 1.5, 7), "b": ("2024-01-03", 3.25, 2.0, None), "c": ("None", 1.0, 1.0, 1), "d": ("2024-01-05", 4.0, None, 9)}
    unfit = {r.channel: r._unfit for r in files.unfit_rows(spark, str(path)).collect()}
    assert unfit == {"a": '2024-01-02,a,"1,200.50",1.5,7', "b": "2024-01-03,b,3.25,2,8.5", "c": "soon,c,1,1,1"}
    # Also when not all columns are asked for.
    assert files.unfit_rows(spark, str(path)).select("channel").count() == 3
    assert files.unfit_rows(spark, str(path), "other").count() == 0
    path.write_text("date,channel,spend,conversions,clicks\n2024-01-02,a,1200.50,1.5,7\n,b,,,\n")
    assert [(r.conversions, r.clicks) for r in files.load_csv(spark, str(path)).orderBy("channel").collect()] == [(1.5, 7), (None, None)]
    assert files.unfit_rows(spark, str(path)).count() == 0


def test_unknown_columns_do_not_cost_the_contract(spark, tmp_path):
    path = tmp_path / "marketing_spend.csv"
    path.write_text("date,campaign_id,channel,cost,note\n2024-01-02,7,a,5,x\n")
    assert dict(files.load_csv(spark, str(path)).dtypes) == {"date": "date", "campaign_id": "int", "channel": "string", "cost": "double", "note": "string"}


def test_a_contract_load_reads_the_file_once(spark, tmp_path):
    """Nothing but the header is read before the table is."""
    path = tmp_path / "marketing_spend.csv"
    path.write_text("date,channel,spend\n" + "2024-01-02,a,1\n" * 1_000)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("load", "load")
    files.load_csv(spark, str(path))
    stages = [spark.sparkContext.statusTracker().getJobInfo(j) for j in tracker.getJobIdsForGroup("load")]
    spark.sparkContext.setJobGroup("", "")
    assert len(stages) <= 1


def test_an_extract_runs_its_plan_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(batches, runs=runs):
        runs.add(1)
        yield from batches

    table = spark.range(10, numPartitions=1).selectExpr("id AS v", "id % 2 AS k").mapInPandas(counted, "v long, k long")
    path = str(tmp_path / "out")
    assert files.write_extract(table, path, "parquet") == path and runs.value == 1
    assert files.write_extract(table.filter("v < 4"), path, "parquet") == path and spark.read.parquet(path).count() == 4
    # Without rows the earlier extract stays, whatever the mode.
    for mode in ("overwrite", "append"):
        assert files.write_extract(table.filter("v < 0"), path, "parquet", mode=mode) == "" and spark.read.parquet(path).count() == 4
    assert files.write_extract(table, path, "parquet", mode="append") == path and spark.read.parquet(path).count() == 14
    assert files.write_extract(table, path, "parquet", mode="ignore") == path and spark.read.parquet(path).count() == 14
    assert files.write_extract(table.filter("v < 0"), str(tmp_path / "none"), "csv", ["k"]) == ""
    assert sorted(p.name for p in tmp_path.iterdir()) == ["out"]
    # An extract may be made from what it replaces.
    own = spark.read.parquet(path).filter("v = 3")
    assert files.write_extract(own, path, "parquet") == path and [r.v for r in spark.read.parquet(path).collect()] == [3, 3]


def test_registered_tables_carry_their_ranges(spark, monkeypatch):
    """Options only: no database runs here."""
    asked = []

    def load(session, url, table, *ranges, **options):
        asked.append((table, *ranges))
        if table == "information_schema.tables":
            names = [("public", "orders", "BASE TABLE"), ("public", "big", "BASE TABLE"), ("public", "recent", "VIEW"), ("audit", "log", "BASE TABLE"), ("public", "far", "FOREIGN")]
            return session.createDataFrame(names, "table_schema string, table_name string, table_type string")
        return session.range(1)

    monkeypatch.setattr(database, "load_jdbc", load)
    registry = SourceRegistry()
    registry.register_jdbc("postgresql://h/db", "big", database.JdbcTable("", "orders", "id", 1, 1_000, 8))
    registry.register_jdbc("postgresql://h/db", database.JdbcTable("", "big", "day", "2024-01-01", "2025-01-01", 12), "orders")
    for schema in ("public", "audit", "public"):
        registry.register_jdbc_schema("postgresql://h/db", schema)
    loaded = registry.load_sources(spark)
    assert set(loaded) == {"pg_big", "pg_orders", "pg_recent", "pg_audit_log"}
    tables = [a for a in asked if a[0] != "information_schema.tables"]
    nothing = (None,) * 4
    assert tables == [("big", "day", "2024-01-01", "2025-01-01", 12), ("orders", "id", 1, 1_000, 8), ("public.recent", *nothing), ("audit.log", *nothing)]
