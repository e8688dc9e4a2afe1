"""Queries on sources, payloads, the catalog and ad hoc SQL.

Payloads are derived from the given tables as JSON text and normalized from
there, so each query runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.functions.export import report_types
from tidemark.operators import adhoc, catalog, reports
from tidemark.plans import canonical as tables
from tidemark.plans.canonical import AS_OF, sql_ratio, sql_round, with_tables
from tidemark.session import scratch_dir
from tidemark.sources import files, payloads
from tidemark.sources.registry import SourceRegistry

# 2024-01-30 as a unix time, for payload times counted back from it.
AS_OF_SECONDS = 1706572800
DAY_SECONDS = 86400

# -- sources -----------------------------------------------------------------


def _load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend written as one CSV extract and read back with the contract's types."""
    path = f"{scratch_dir(spark)}/marketing_spend.csv"
    files.write_extract(tables.marketing_spend(spark, sf_dir), path)
    return report_types(files.load_csv(spark, path))


def _csv_folder(spark: SparkSession, sf_dir: str, *names: str) -> str:
    folder = scratch_dir(spark)
    for name in names:
        files.write_extract(getattr(tables, name)(spark, sf_dir), f"{folder}/{name}.csv")
    return folder


def _rows(name: str, table: DataFrame, *columns: str) -> DataFrame:
    """All rows of a table as texts, with the table's name and how often each occurs."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"value_{i}") for i, c in enumerate(columns, 1)]
    return table.select(F.lit(name).alias("table_name"), *texts).groupBy("table_name", *[f"value_{i}" for i in range(1, len(columns) + 1)]).agg(F.count(F.lit(1)).alias("n"))


def _load_csv_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two extracts of one folder, all their rows."""
    loaded = files.load_csv_dir(spark, _csv_folder(spark, sf_dir, "order_history", "campaigns"))
    history = _rows("order_history", loaded["order_history"], "user_id", "event_type", "event_date")
    return report_types(history.unionByName(_rows("campaigns", loaded["campaigns"], "campaign_id", "name", "start_date")))


def _load_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folders with a table of the same name: the later one counts; all rows."""
    registry = SourceRegistry()
    first, second = _csv_folder(spark, sf_dir, "campaigns", "invoices"), scratch_dir(spark)
    files.write_extract(tables.order_history(spark, sf_dir), f"{second}/invoices.csv")
    for folder in (first, second, first):
        registry.register_csv(folder)
    loaded = registry.load_sources(spark)
    rows = _rows("campaigns", loaded["campaigns"], "channel", "campaign_id", "name").unionByName(_rows("invoices", loaded["invoices"], "user_id", "event_type", "event_date"))
    return report_types(rows)


def _write_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events partitioned by day, all read back."""
    path = scratch_dir(spark)
    files.write_extract(tables.plain_events(spark, sf_dir), path, "parquet", partition_by=["event_date"])
    columns = ["event_date", "event_type", "utm_campaign"]
    return report_types(spark.read.parquet(path).groupBy(*columns).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("event_id").alias("ids"), F.sum("revenue").alias("revenue")))


def _contract_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under other column names, renamed and then summed by canonical names."""
    foreign = {
        "marketing_spend": tables.marketing_spend(spark, sf_dir).withColumnsRenamed({"spend": "cost", "date": "day", "channel": "source"}),
        "user_events": tables.user_events(spark, sf_dir).withColumnsRenamed({"event_type": "type", "event_date": "occurred_at"}),
    }
    renamed, _ = catalog.apply_contract_aliases(foreign)
    spend, events = renamed["marketing_spend"], renamed["user_events"]
    return report_types(
        spend.groupBy("channel").agg(F.sum("spend").alias("total"), F.max("date").alias("last_date")).unionByName(
            events.groupBy(F.col("event_type").alias("channel")).agg(F.sum("revenue").alias("total"), F.max("event_date").alias("last_date"))
        )
    )


# -- payloads ----------------------------------------------------------------


def _json(frame: DataFrame, *columns: Column) -> DataFrame:
    """Rows as JSON text; null fields are left out, as in real payloads."""
    # Through an explode, so that the text is built once however often it is used.
    return frame.select(F.explode_outer(F.array(F.to_json(F.struct(*columns)))).alias("value"))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read(spark, sf_dir, "orders")


def _seconds() -> Column:
    return F.lit(AS_OF_SECONDS) - F.col("o_orderkey") % 90 * DAY_SECONDS + F.col("o_orderkey") % DAY_SECONDS


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = _json(
        tables.read(spark, sf_dir, "customer"),
        F.concat(F.lit("cus_"), key).alias("id"),
        F.when(key % 3 > 0, F.lower("c_name")).alias("email"),
        F.col("c_name").alias("name"),
        (F.lit(AS_OF_SECONDS) - key * 3600).alias("created"),
        F.when(key % 2 == 0, "usd").alias("currency"),
        F.when(key % 5 == 0, key % 10 == 0).alias("delinquent"),
    )
    return report_types(payloads.normalize_stripe_customers(raw))


def _raw_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cents = F.col("o_orderkey"), (F.col("o_totalprice").cast("decimal(18,2)") * 100).cast("bigint")
    start = _seconds()
    return _json(
        _orders(spark, sf_dir),
        F.concat(F.lit("in_"), key).alias("id"),
        F.when(key % 7 > 0, F.concat(F.lit("cus_"), F.col("o_custkey"))).otherwise("").alias("customer"),
        F.when(key % 4 == 0, F.concat(F.lit("direct"), key)).alias("customer_email"),
        F.when(key % 2 == 0, F.struct(F.concat(F.lit("detail"), key).alias("email"))).alias("customer_details"),
        F.when(F.col("o_orderstatus") == "F", "paid").otherwise("open").alias("status"),
        F.lit("usd").alias("currency"),
        cents.alias("amount_paid"),
        F.when(key % 3 == 0, cents).alias("amount_due"),
        start.alias("created"),
        F.when(key % 5 > 0, F.struct((start + DAY_SECONDS).alias("paid_at"))).alias("status_transitions"),
        F.struct(
            F.when(
                key % 6 > 0,
                F.array(F.struct(F.struct(start.alias("start"), (start + 30 * DAY_SECONDS).alias("end")).alias("period"))),
            ).alias("data")
        ).alias("lines"),
    )


def _invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(payloads.normalize_stripe_invoices(_raw_invoices(spark, sf_dir)))


def _invoice_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(payloads.stripe_invoices_to_events(_raw_invoices(spark, sf_dir)))


def _subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    price = F.struct(
        F.concat(F.lit("price_"), key % 9).alias("id"),
        F.lit("eur").alias("currency"),
        (key % 1000 * 7).alias("unit_amount"),
        F.when(key % 3 > 0, F.struct(F.when(key % 2 == 0, "month").otherwise("year").alias("interval"))).alias("recurring"),
    )
    raw = _json(
        _orders(spark, sf_dir),
        F.concat(F.lit("sub_"), key).alias("id"),
        F.concat(F.lit("cus_"), F.col("o_custkey")).alias("customer"),
        F.when(key % 4 == 0, "active").alias("status"),
        _seconds().alias("created"),
        _seconds().alias("current_period_start"),
        F.when(key % 11 > 0, _seconds() + 30 * DAY_SECONDS).alias("current_period_end"),
        F.when(key % 2 == 0, key % 8 == 0).alias("cancel_at_period_end"),
        F.struct(F.when(key % 10 > 0, F.array(F.struct(price.alias("price")))).alias("data")).alias("items"),
    )
    return report_types(payloads.normalize_stripe_subscriptions(raw))


def _meta_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = _json(
        _orders(spark, sf_dir),
        F.concat(F.lit("cmp_"), key).alias("id"),
        F.col("o_orderpriority").alias("name"),
        F.when(key % 2 == 0, "OUTCOME_SALES").alias("objective"),
        F.lit("ACTIVE").alias("status"),
        F.when(key % 3 == 0, F.array(F.lit("ACTIVE"), F.lit("WITH_ISSUES"))).when(key % 3 == 1, F.array(F.lit("PAUSED"))).alias("effective_status"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00+0000")).alias("created_time"),
        F.when(key % 4 > 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z"))).alias("start_time"),
        (key * 100 + 50).cast("string").alias("daily_budget"),
        F.when(key % 5 == 0, F.lit("")).alias("lifetime_budget"),
    )
    return report_types(payloads.normalize_meta_campaigns(raw))


def _meta_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    raw = _json(
        _orders(spark, sf_dir),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date_start"),
        F.concat(F.lit("cmp_"), key % 50).alias("campaign_id"),
        F.col("o_orderpriority").alias("campaign_name"),
        price.cast("string").alias("spend"),
        (key * 3).cast("string").alias("impressions"),
        F.when(key % 4 > 0, F.concat(key % 100, F.lit(".0"))).otherwise("").alias("clicks"),
        F.when(key % 3 == 0, (key % 90).cast("string")).alias("reach"),
        F.lit("0.38").alias("cpc"),
        F.when(key % 2 == 0, F.lit("")).otherwise("2.27").alias("ctr"),
    )
    return report_types(payloads.normalize_meta_spend(raw))


def _google_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report batch per order, with one result for each of its lines."""
    # Narrow rows are exchanged, into parts that are kept apart, before the wide results are built of them: lists are then
    # sorted in parts of the shuffle instead of splits of the scan, and parts small in bytes but not in work are not merged.
    wanted = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = tables.read(spark, sf_dir, "lineitem").select(*wanted).repartition(parts, "l_orderkey")
    micros = (F.col("l_extendedprice").cast("decimal(18,2)") * 1000000).cast("bigint").cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    result = F.struct(
        F.struct(
            F.col("l_suppkey").cast("string").alias("id"),
            F.when(F.col("l_linenumber") > 1, F.concat(F.lit("Campaign "), F.col("l_suppkey"))).alias("name"),
            F.col("l_returnflag").alias("status"),
            F.lit("SEARCH").alias("advertisingChannelType"),
            day.alias("startDate"),
        ).alias("campaign"),
        F.struct(day.alias("date")).alias("segments"),
        F.struct(
            micros.alias("costMicros"),
            F.col("l_partkey").cast("string").alias("impressions"),
            F.when(F.col("l_linenumber") != 3, F.col("l_linenumber").cast("string")).alias("clicks"),
            (F.col("l_quantity").cast("double") / 4).alias("conversions"),
        ).alias("metrics"),
    )
    # Results become text line by line: as an input of the list they would be evaluated field by field without compiled code.
    lines = rows.select("l_orderkey", F.to_json(result).alias("result")).groupBy("l_orderkey").agg(F.array_join(F.collect_list("result"), ",").alias("results"))
    return lines.select(F.explode_outer(F.array(F.concat(F.lit('[{"results":['), "results", F.lit("]}]")))).alias("value"))


def _google_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    spend = payloads.normalize_google_spend(_google_batches(spark, sf_dir))
    return report_types(
        spend.groupBy("date", "campaign_id", "campaign").agg(
            *[F.sum(c).alias(c) for c in ("spend", "impressions", "clicks", "conversions")], F.count(F.lit(1)).alias("n")
        )
    )


def _google_campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(payloads.normalize_google_campaigns(_google_batches(spark, sf_dir)).groupBy("campaign_id", "name", "campaign_type", "campaign_sub_type", "status").agg(F.min("start_date").alias("start_date"), F.count(F.lit(1)).alias("n")))


def _contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    properties = F.struct(
        F.lower("c_name").alias("email"),
        F.when(key % 2 == 0, F.lit("Ann")).alias("firstname"),
        F.concat(F.lit("2023-11-"), F.lpad((key % 30 + 1).cast("string"), 2, "0"), F.lit("T08:00:00.000Z")).alias("createdate"),
        F.when(key % 3 == 0, F.lit("lead")).when(key % 3 == 1, F.lit("")).alias("lifecyclestage"),
        F.lower("c_mktsegment").alias("hs_analytics_source"),
    )
    raw = _json(tables.read(spark, sf_dir, "customer"), key.cast("string").alias("id"), properties.alias("properties"))
    return report_types(payloads.normalize_hubspot_contacts(raw))


def _deals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    amount = F.when(key % 4 == 0, "n/a").when(key % 4 > 1, F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    properties = F.struct(
        F.concat(F.lit("Deal "), key).alias("dealname"),
        amount.alias("amount"),
        F.col("o_orderstatus").alias("dealstage"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00Z")).alias("createdate"),
        F.when(key % 5 == 0, F.lit("")).alias("closedate"),
        F.when(key % 2 == 0, F.col("o_orderpriority")).alias("hs_analytics_source"),
    )
    raw = _json(_orders(spark, sf_dir), key.cast("string").alias("id"), properties.alias("properties"))
    return report_types(payloads.normalize_hubspot_deals(raw))


def _raw_mixpanel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported events; every 50th line is cut off and cannot be parsed."""
    number = F.col("event_id")
    properties = F.struct(
        F.col("user_id").cast("string").alias("distinct_id"),
        F.when(number % 10 > 0, F.lit(AS_OF_SECONDS) - number).alias("time"),
        F.when(number % 3 == 0, "google").alias("utm_source"),
        F.col("value").alias("amount"),
    )
    lines = F.to_json(F.struct(F.col("event_type").alias("event"), properties.alias("properties")))
    cut = F.when(number % 50 == 0, F.substring(lines, 1, 30)).otherwise(lines)
    return tables.read(spark, sf_dir, "events").select(F.explode_outer(F.array(cut)).alias("value"))


def _mixpanel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = payloads.normalize_mixpanel_events(_raw_mixpanel(spark, sf_dir), event_names=["click", "purchase"])
    return report_types(
        events.select(
            "event", "distinct_id", F.unix_seconds("time").alias("seconds"), "utm_source", "utm_campaign",
            F.get_json_object("properties_json", "$.amount").cast("double").alias("amount"),
        )
    )


def _mixpanel_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One funnel per order with its lines as steps."""
    number = F.col("l_linenumber")
    rate = F.col("l_discount").cast("double")
    step = F.struct(
        number.alias("position"),
        F.when(number % 3 == 0, F.concat(F.lit("event "), F.col("l_partkey"))).alias("event"),
        F.when(number % 3 == 1, F.concat(F.lit("name "), F.col("l_partkey"))).alias("name"),
        F.col("l_suppkey").alias("count"),
        F.when(number % 2 == 0, rate).alias("conversion_rate"),
        F.when(number % 2 == 1, rate / 3).alias("step_conv_ratio"),
    )
    funnels = tables.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    key = F.col("l_orderkey")
    raw = _json(funnels, F.when(key % 2 == 0, key).alias("funnel_id"), F.when(key % 2 == 1, key).alias("id"), F.col("steps"))
    return report_types(payloads.normalize_mixpanel_funnels(raw).select("funnel_id", "step_index", "count", "conversion_rate", F.regexp_replace("step_name", r"^Step \d+$", "Step").alias("step_name")).groupBy("funnel_id").agg(F.count(F.lit(1)).alias("steps"), F.max("step_index").alias("last_index"), F.sum("count").alias("users"), F.sum(F.col("conversion_rate").cast("decimal(18,4)")).alias("rates"), F.count(F.when(F.col("step_name") == "Step", 1)).alias("unnamed")))


def _amplitude_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    time = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    raw = _json(
        tables.read(spark, sf_dir, "events"),
        "event_type",
        F.when(number % 9 > 0, F.col("user_id").cast("string")).alias("user_id"),
        number.alias("session_id"),
        F.lit("iOS").alias("device_type"),
        F.when(number % 8 == 0, time.substr(1, 16)).otherwise(time).alias("event_time"),
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("revenue"),
        F.when(number % 4 == 0, F.struct(F.lit("user").alias("utm_source"))).alias("user_properties"),
        F.when(number % 2 == 0, F.struct(F.lit("event").alias("utm_source"), F.lit("spring").alias("utm_campaign"))).alias("event_properties"),
    )
    return report_types(payloads.normalize_amplitude_events(raw))


def _amplitude_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing per hundred customer keys, with the customers as cohorts."""
    key = F.col("c_custkey")
    cohort = F.struct(
        F.concat(F.lit("coh_"), key).alias("id"), F.col("c_name").alias("name"), (key % 77).alias("size"),
        F.when(key % 3 == 0, F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0"), F.lit("T00:00:00Z"))).when(key % 3 == 1, "").alias("lastComputed"),
    )
    listings = tables.read(spark, sf_dir, "customer").groupBy(F.floor(key / 100).alias("page")).agg(F.collect_list(cohort).alias("cohorts"))
    return report_types(payloads.normalize_amplitude_cohorts(_json(listings, F.col("cohorts")), AS_OF))


# -- catalog and SQL ---------------------------------------------------------


def _catalog(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "marketing_spend": tables.marketing_spend(spark, sf_dir),
        "user_events": tables.user_events(spark, sf_dir).drop("event_id", "ts"),
        "campaigns": tables.campaigns(spark, sf_dir),
    }


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(catalog.list_tables({name: tables.read(spark, sf_dir, name) for name in GIVEN}))


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(catalog.profile_table(tables.read(spark, sf_dir, "orders")))


def _format_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_types(catalog.format_schema({name: tables.read(spark, sf_dir, name) for name in ("customer", "nation")}))


def _freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = {**_catalog(spark, sf_dir), "user_events_old": tables.order_history(spark, sf_dir), "orders": tables.read(spark, sf_dir, "orders")}
    return report_types(catalog.freshness(everything, AS_OF))


def _date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = {**_catalog(spark, sf_dir), "old": tables.order_history(spark, sf_dir)}
    return report_types(catalog.source_date_range(everything, AS_OF))


def _validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data set without campaigns, with an aliased and a missing column."""
    broken = {
        "marketing_spend": tables.marketing_spend(spark, sf_dir).withColumnRenamed("spend", "cost").drop("channel"),
        "user_events": tables.plain_events(spark, sf_dir).drop("ts"),
    }
    return report_types(catalog.validate_contracts(broken, "2024-02-05"))


def _views(spark: SparkSession, sf_dir: str) -> None:
    for name in ("customer", "orders", "lineitem", "events", "nation", "region"):
        tables.read(spark, sf_dir, name).createOrReplaceTempView(name)


def _sql(text: str, offset: int = 0, limit: int | None = None):
    """The same read-only SQL through the guard in Spark and in the other engine."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        _views(spark, sf_dir)
        return report_types(adhoc.run_query(spark, text, offset, limit))

    return run


def _query_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table that the subquery example reads."""
    _views(spark, sf_dir)
    sources = {name: spark.table(name) for name in adhoc.query_sources(spark, _SUBQUERIES)}
    return report_types(catalog.list_tables(sources).select("table_name", "row_count"))


def _custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = adhoc.CustomMetric(
        name="cost_per_click",
        label="Cost per click",
        sql_expression="round(sum(spend) / sum(clicks), 2)",
        table="marketing_spend",
        benchmark_good=80.0,
        benchmark_ok=120.0,
        unit="$",
    )
    return report_types(adhoc.custom_metric(tables.marketing_spend(spark, sf_dir), metric, higher_is_better=False))


_PAGE = """SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey"""
_WINDOWS = """SELECT user_id, event_id, n, gap, recent FROM (
    SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
           event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap,
           count(*) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS recent
    FROM events) WHERE gap IS NOT NULL"""
_SET_OPERATIONS = """(SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT o_custkey FROM orders)
    UNION (SELECT user_id FROM events EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')"""
_SUBQUERIES = """WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey)
    SELECT c.c_custkey, c.c_mktsegment, b.n FROM customer c JOIN big b ON c.c_custkey = b.o_custkey
    WHERE b.n > (SELECT avg(n) FROM big) AND c.c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')
      AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')"""

_INV = """SELECT o_orderkey AS k, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
          DATE '2024-01-30' - CAST(o_orderkey % 90 AS INTEGER) + CAST((o_orderkey % 86400) // 86400 AS INTEGER) AS d FROM orders"""
_DAY = "strftime({}, '%Y-%m-%d')"


def _day(column: str) -> str:
    return _DAY.format(column)


def _profile_sql(table: str, columns: dict[str, str]) -> str:
    # Whole days are texts without a time in either engine; doubles of these tables are written alike below ten million.
    text = {"timestamp_ntz": "strftime({}, '%Y-%m-%d %H:%M:%S')", "timestamp": "strftime({}, '%Y-%m-%d %H:%M:%S')"}
    return " UNION ALL ".join(
        f"""SELECT CAST({i + 1} AS BIGINT) AS position, '{name}' AS column_name, '{kind}' AS data_type, count(*) AS row_count,
            {sql_round(f'(count(*) - count({name})) * 100.0 / count(*)', 1)} AS null_pct, count(DISTINCT {name}) AS distinct_count,
            (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {text.get(kind, 'CAST({} AS VARCHAR)').format(name)} AS v FROM {table} WHERE {name} IS NOT NULL ORDER BY v LIMIT 5)) AS samples FROM {table}"""
        for i, (name, kind) in enumerate(columns.items())
    )


# The types of the given tables' columns.
_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}
_NATION = {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}


def _schema_sql(table: str, columns: dict[str, str]) -> str:
    return f"""SELECT '{table}' AS table_name, CAST(0 AS BIGINT) AS line, format('TABLE: {table} ({{:,}} rows)', count(*)) AS text FROM {table}
        UNION ALL SELECT '{table}', position, format('| {{}} | {{}} | {{:,}} | {{:.1f}}% | {{}} |', column_name, data_type, distinct_count, null_pct, samples)
        FROM ({_profile_sql(table, columns)})"""


def _fresh_sql(tables_: dict[str, tuple[str, str]], as_of: str = AS_OF) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, '{column}' AS date_column, min({column}) AS a, max({column}) AS b FROM {source}" for name, (source, column) in tables_.items()
    )
    return f"""SELECT table_name, date_column, {_day('a')} AS min_date, {_day('b')} AS max_date, date_diff('day', b, DATE '{as_of}') AS days_stale,
        CASE WHEN date_diff('day', b, DATE '{as_of}') <= 2 THEN 'fresh' WHEN date_diff('day', b, DATE '{as_of}') <= 14 THEN 'stale' ELSE 'outdated' END AS status FROM ({rows})"""


def _list_sql() -> str:
    shown = """SELECT c.table_name, count(*) AS column_count, string_agg(column_name, ', ' ORDER BY column_index) FILTER (WHERE column_index <= 6)
        || CASE WHEN count(*) > 6 THEN ' (+' || (count(*) - 6) || ' more)' ELSE '' END AS column_names
        FROM (SELECT table_name, column_name, column_index FROM duckdb_columns()) c GROUP BY 1"""
    counts = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in GIVEN)
    return f"SELECT table_name, row_count, column_count, column_names FROM ({counts}) JOIN ({shown}) USING (table_name)"


QUERIES = {
    "load_csv": (
        _load_csv,
        with_tables(
            "marketing_spend",
            """SELECT strftime(date, '%Y-%m-%d') AS date, channel, CAST(campaign_id AS BIGINT) AS campaign_id, campaign, CAST(spend AS DOUBLE) AS spend, impressions, clicks, CAST(conversions AS DOUBLE) AS conversions FROM marketing_spend""",
        ),
    ),
    "load_csv_dir": (
        _load_csv_dir,
        with_tables(
            "order_history campaigns",
            f"""SELECT 'order_history' AS table_name, CAST(user_id AS VARCHAR) AS value_1, event_type AS value_2, {_day('event_date')} AS value_3, count(*) AS n FROM order_history GROUP BY ALL
                UNION ALL SELECT 'campaigns', CAST(campaign_id AS VARCHAR), name, {_day('start_date')}, count(*) FROM campaigns GROUP BY ALL""",
        ),
    ),
    "load_sources": (
        _load_sources,
        with_tables(
            "order_history campaigns",
            f"""SELECT 'campaigns' AS table_name, channel AS value_1, CAST(campaign_id AS VARCHAR) AS value_2, name AS value_3, count(*) AS n FROM campaigns GROUP BY ALL
               UNION ALL SELECT 'invoices', CAST(user_id AS VARCHAR), event_type, {_day('event_date')}, count(*) FROM order_history GROUP BY ALL""",
        ),
    ),
    "write_extract": (
        _write_extract,
        with_tables(
            "user_events",
            f"""SELECT {_day('event_date')} AS event_date, event_type, utm_campaign, count(*) AS events, count(DISTINCT event_id) AS ids, CAST(sum(revenue) AS DOUBLE) AS revenue
                FROM user_events GROUP BY ALL""",
        ),
    ),
    "apply_contract_aliases": (
        _contract_aliases,
        with_tables(
            "marketing_spend user_events",
            f"""SELECT channel, CAST(sum(spend) AS DOUBLE) AS total, {_day('max(date)')} AS last_date FROM marketing_spend GROUP BY 1
                UNION ALL SELECT event_type, CAST(sum(revenue) AS DOUBLE), {_day('max(event_date)')} FROM user_events GROUP BY 1""",
        ),
    ),
    "normalize_stripe_customers": (
        _customers,
        f"""SELECT 'cus_' || c_custkey AS customer_id, CASE WHEN c_custkey % 3 > 0 THEN lower(c_name) ELSE '' END AS email, c_name AS name,
            {_day(f"CAST(epoch_ms(({AS_OF_SECONDS} - c_custkey * 3600) * 1000) AS DATE)")} AS created, CASE WHEN c_custkey % 2 = 0 THEN 'usd' ELSE '' END AS currency,
            c_custkey % 10 = 0 AS delinquent FROM customer""",
    ),
    "normalize_stripe_invoices": (
        _invoices,
        with_tables(
            "",
            f"""SELECT 'in_' || k AS invoice_id, CASE WHEN k % 7 > 0 THEN 'cus_' || o_custkey ELSE '' END AS customer_id,
                CASE WHEN k % 4 = 0 THEN 'direct' || k WHEN k % 2 = 0 THEN 'detail' || k ELSE '' END AS customer_email,
                CASE o_orderstatus WHEN 'F' THEN 'paid' ELSE 'open' END AS status, 'usd' AS currency, CAST(price AS DOUBLE) AS amount_paid,
                CASE WHEN k % 3 = 0 THEN CAST(price AS DOUBLE) ELSE 0 END AS amount_due, CAST(0 AS DOUBLE) AS amount_remaining, {_day('d')} AS created,
                CASE WHEN k % 6 > 0 THEN {_day('d')} END AS period_start, CASE WHEN k % 6 > 0 THEN {_day('d + 30')} END AS period_end, '' AS subscription_id FROM inv""",
            inv=_INV,
        ),
    ),
    "stripe_invoices_to_events": (
        _invoice_events,
        with_tables(
            "",
            f"""SELECT CASE WHEN k % 7 > 0 THEN 'cus_' || o_custkey WHEN k % 4 = 0 THEN 'direct' || k ELSE 'in_' || k END AS user_id, 'purchase' AS event_type,
                {_day('CASE WHEN k % 5 > 0 THEN d + 1 ELSE d END')} AS event_date, 'stripe' AS utm_source, CAST(price AS DOUBLE) AS revenue, 'stripe' AS source_system
                FROM inv WHERE o_orderstatus = 'F'""",
            inv=_INV,
        ),
    ),
    "normalize_stripe_subscriptions": (
        _subscriptions,
        with_tables(
            "",
            f"""SELECT 'sub_' || k AS subscription_id, 'cus_' || o_custkey AS customer_id, CASE WHEN k % 4 = 0 THEN 'active' ELSE '' END AS status, {_day('d')} AS created,
                {_day('d')} AS current_period_start, CASE WHEN k % 11 > 0 THEN {_day('d + 30')} END AS current_period_end, k % 8 = 0 AS cancel_at_period_end,
                CASE WHEN k % 10 > 0 THEN 'eur' ELSE '' END AS currency, CASE WHEN k % 10 > 0 THEN 'price_' || (k % 9) ELSE '' END AS price_id,
                CASE WHEN k % 10 > 0 THEN CAST(CAST(k % 1000 * 7 AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(2,2)) AS DOUBLE) ELSE 0 END AS unit_amount,
                CASE WHEN k % 10 > 0 AND k % 3 > 0 THEN CASE WHEN k % 2 = 0 THEN 'month' ELSE 'year' END ELSE '' END AS interval FROM inv""",
            inv=_INV,
        ),
    ),
    "normalize_meta_campaigns": (
        _meta_campaigns,
        f"""SELECT 'cmp_' || o_orderkey AS campaign_id, o_orderpriority AS name, 'meta_ads' AS channel, CASE WHEN o_orderkey % 2 = 0 THEN 'OUTCOME_SALES' ELSE '' END AS objective,
            'ACTIVE' AS status, CASE o_orderkey % 3 WHEN 0 THEN 'ACTIVE,WITH_ISSUES' WHEN 1 THEN 'PAUSED' ELSE '' END AS effective_status, {_day('o_orderdate')} AS created_time,
            CASE WHEN o_orderkey % 4 > 0 THEN {_day('o_orderdate')} END AS start_date, CAST(NULL AS VARCHAR) AS stop_date, CAST(o_orderkey + 0.5 AS DOUBLE) AS daily_budget,
            CAST(0 AS DOUBLE) AS lifetime_budget, 'meta_ads' AS source_system FROM orders""",
    ),
    "normalize_meta_spend": (
        _meta_spend,
        f"""SELECT {_day('o_orderdate')} AS date, 'meta_ads' AS channel, 'cmp_' || (o_orderkey % 50) AS campaign_id, o_orderpriority AS campaign,
            CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS spend, o_orderkey * 3 AS impressions, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 100 ELSE 0 END AS clicks,
            CAST(0 AS DOUBLE) AS conversions, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 90 ELSE 0 END AS reach, CAST(0.38 AS DOUBLE) AS cpc,
            CASE WHEN o_orderkey % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(2.27 AS DOUBLE) END AS ctr, 'meta_ads' AS source_system FROM orders""",
    ),
    "normalize_google_spend": (
        _google_spend,
        f"""SELECT {_day('l_shipdate')} AS date, CAST(l_suppkey AS VARCHAR) AS campaign_id, CASE WHEN l_linenumber > 1 THEN 'Campaign ' || l_suppkey ELSE '' END AS campaign,
            CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS spend, CAST(sum(l_partkey) AS BIGINT) AS impressions,
            CAST(sum(CASE WHEN l_linenumber <> 3 THEN l_linenumber ELSE 0 END) AS BIGINT) AS clicks,
            CAST(sum(CAST(CAST(l_quantity AS DOUBLE) / 4 AS DECIMAL(18,2))) AS DOUBLE) AS conversions, count(*) AS n FROM lineitem GROUP BY 1, 2, 3""",
    ),
    "normalize_google_campaigns": (
        _google_campaigns,
        f"""SELECT CAST(l_suppkey AS VARCHAR) AS campaign_id, CASE WHEN l_linenumber > 1 THEN 'Campaign ' || l_suppkey ELSE '' END AS name, 'SEARCH' AS campaign_type,
            '' AS campaign_sub_type, l_returnflag AS status, {_day('min(l_shipdate)')} AS start_date, count(*) AS n FROM lineitem GROUP BY 1, 2, 5""",
    ),
    "normalize_hubspot_contacts": (
        _contacts,
        """SELECT CAST(c_custkey AS VARCHAR) AS id, lower(c_name) AS email, CASE WHEN c_custkey % 2 = 0 THEN 'Ann' ELSE '' END AS firstname, '' AS lastname,
           '2023-11-' || lpad(CAST(c_custkey % 30 + 1 AS VARCHAR), 2, '0') AS created_date, CASE WHEN c_custkey % 3 = 0 THEN 'lead' ELSE 'unknown' END AS lifecycle_stage,
           lower(c_mktsegment) AS lead_source, CAST(0 AS BIGINT) AS num_associated_deals FROM customer""",
    ),
    "normalize_hubspot_deals": (
        _deals,
        f"""SELECT CAST(o_orderkey AS VARCHAR) AS id, 'Deal ' || o_orderkey AS dealname, CASE WHEN o_orderkey % 4 > 1 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) ELSE 0 END AS amount,
            o_orderstatus AS stage, {_day('o_orderdate')} AS created_date, CAST(NULL AS VARCHAR) AS close_date, '' AS pipeline,
            CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'direct' END AS utm_source FROM orders""",
    ),
    "normalize_mixpanel_events": (
        _mixpanel_events,
        f"""SELECT event_type AS event, CAST(user_id AS VARCHAR) AS distinct_id, CASE WHEN event_id % 10 > 0 THEN {AS_OF_SECONDS} - event_id END AS seconds,
            CASE WHEN event_id % 3 = 0 THEN 'google' ELSE '' END AS utm_source, '' AS utm_campaign, value AS amount
            FROM events WHERE event_id % 50 <> 0 AND event_type IN ('click', 'purchase')""",
    ),
    "normalize_mixpanel_funnels": (
        _mixpanel_funnels,
        f"""SELECT CAST(l_orderkey AS VARCHAR) AS funnel_id, count(*) AS steps, count(*) - 1 AS last_index, CAST(sum(l_suppkey) AS BIGINT) AS users,
            CAST(sum(round(CAST(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_discount AS DOUBLE) ELSE CAST(l_discount AS DOUBLE) / 3 END AS DECIMAL(30,10)), 4)) AS DOUBLE) AS rates,
            count(CASE WHEN l_linenumber % 3 = 2 THEN 1 END) AS unnamed FROM lineitem GROUP BY l_orderkey""",
    ),
    "normalize_amplitude_events": (
        _amplitude_events,
        """SELECT event_type, CASE WHEN event_id % 9 > 0 THEN CAST(user_id AS VARCHAR) ELSE '' END AS user_id, CAST(event_id AS VARCHAR) AS session_id, 'iOS' AS device_type, '' AS country,
           CASE WHEN event_id % 4 = 0 THEN 'user' WHEN event_id % 2 = 0 THEN 'event' ELSE '' END AS utm_source, CASE WHEN event_id % 2 = 0 THEN 'spring' ELSE '' END AS utm_campaign,
           CASE WHEN event_type = 'purchase' THEN value ELSE 0 END AS revenue,
           CASE WHEN event_id % 8 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS timestamp FROM events""",
    ),
    "normalize_amplitude_cohorts": (
        _amplitude_cohorts,
        f"""SELECT 'coh_' || c_custkey AS cohort_id, c_name AS cohort_name, c_custkey % 77 AS size,
            CASE WHEN c_custkey % 3 = 0 THEN '2024-01-' || lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0') ELSE '{AS_OF}' END AS last_computed FROM customer""",
    ),
    "list_tables": (_list_tables, _list_sql()),
    "profile_table": (
        _profile,
        _profile_sql("orders", _ORDERS),
    ),
    "format_schema": (_format_schema, " UNION ALL ".join(_schema_sql(table, columns) for table, columns in (("customer", _CUSTOMER), ("nation", _NATION)))),
    "freshness": (
        _freshness,
        with_tables(
            "marketing_spend user_events order_history",
            _fresh_sql(
                {
                    "marketing_spend": ("marketing_spend", "date"),
                    "user_events": ("user_events", "event_date"),
                    "user_events_old": ("order_history", "event_date"),
                }
            ),
        ),
    ),
    "source_date_range": (
        _date_range,
        with_tables(
            "marketing_spend user_events order_history",
            """SELECT min(min_date) AS min_date, max(max_date) AS max_date, coalesce(string_agg(table_name, ', ') FILTER (WHERE status = 'stale'), '') AS stale_tables,
                      coalesce(string_agg(table_name, ', ') FILTER (WHERE status = 'outdated'), '') AS outdated_tables FROM f""",
            f=_fresh_sql(
                {"marketing_spend": ("marketing_spend", "date"), "user_events": ("user_events", "event_date"), "old": ("order_history", "event_date")}
            ),
        ),
    ),
    "validate_contracts": (
        _validate,
        with_tables(
            "marketing_spend user_events",
            """SELECT * FROM (VALUES ('marketing_spend', 'warning', 'Missing canonical column `spend` but alias detected.'),
                  ('marketing_spend', 'error', 'Missing required column `channel`.'), ('campaigns', 'error', 'Missing canonical table.')) v(table_name, severity, message)
               UNION ALL SELECT table_name, CASE status WHEN 'fresh' THEN 'ok' ELSE 'info' END, 'Dates in ' || date_column || ' up to ' || max_date || ' are ' || status FROM f""",
            f=_fresh_sql({"marketing_spend": ("marketing_spend", "date"), "user_events": ("user_events", "event_date")}, "2024-02-05"),
        ),
    ),
    "run_query": (_sql(_PAGE, 20, 50), _PAGE + " LIMIT 50 OFFSET 20"),
    "run_query_windows": (_sql(_WINDOWS), _WINDOWS),
    "run_query_set_operations": (_sql(_SET_OPERATIONS), _SET_OPERATIONS),
    "run_query_subqueries": (_sql(_SUBQUERIES), _SUBQUERIES),
    "query_sources": (
        _query_sources,
        "SELECT 'customer' AS table_name, count(*) AS row_count FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders",
    ),
    "custom_metric": (
        _custom_metric,
        with_tables(
            "marketing_spend",
            f"""SELECT 'cost_per_click' AS name, 'Cost per click' AS label, v AS value, '$' AS unit, CASE WHEN v <= 80 THEN 'Good' WHEN v <= 120 THEN 'Average' ELSE 'Poor' END AS verdict
                FROM (SELECT {sql_round('CAST(sum(spend) AS DOUBLE) / sum(clicks)', 2)} AS v FROM marketing_spend)""",
        ),
    ),
}
