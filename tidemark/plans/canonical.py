"""Canonical tables derived from the given star schema.

``user_events`` come from events and customers, spend and invoices from orders
and customers. Amounts are decimals, so sums do not depend on the order of
rows. ``CTES`` states the same tables in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# The day all windows count back from, and how spend spreads over days.
AS_OF = "2024-01-30"
SPEND_DAYS = 60

# Spellings in the events that differ from those of the spend tables.
SOURCE_SPELLINGS = {"furniture": "furnitur", "household": "house-hold"}
CAMPAIGN_SPELLINGS = ("1_urgent", "2 HIGH", "3.medium", "not_specified_4", "low")
# Channels of the first of the two spend tables.
META_CHANNELS = ("automobile", "building")


_SCHEMAS: dict[tuple[str, str], T.StructType] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; its schema is inferred once per application."""
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.coalesce(F.lower("c_mktsegment"), F.lit("unknown"))
    return read(spark, sf_dir, "customer").select("c_custkey", segment.alias("segment"))


def _choice(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a campaign picked by the event's ``k``, but without a source.

    The source needs a join with the customers; queries that do not look at it
    start from here and have none.
    """
    k = F.get_json_object("props", "$.k").try_cast("int")
    amount = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)"))
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("customer"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_id",
        "ts",
        "event_type",
        F.to_date("ts").alias("event_date"),
        F.coalesce(_choice(k % 5, CAMPAIGN_SPELLINGS), F.lit("")).alias("utm_campaign"),
        F.coalesce(amount, F.lit(0).cast("decimal(18,2)")).alias("revenue"),
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with campaign and, as source, the segment of the user."""
    source = F.coalesce("segment", F.lit("unknown"))
    for plain, spelled in SOURCE_SPELLINGS.items():
        source = F.when(F.col("segment") == plain, F.lit(spelled)).otherwise(source)
    joined = plain_events(spark, sf_dir).join(_segments(spark, sf_dir), F.col("customer") == F.col("c_custkey"), "left")
    return joined.withColumn("utm_source", source).drop("customer", "c_custkey", "segment")


def channel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a campaign name."""
    return user_events(spark, sf_dir).drop("utm_campaign")


def _spend_rows(spark: SparkSession, sf_dir: str, campaign_id: Column, campaign: Column) -> DataFrame:
    key = F.col("o_orderkey")
    spend = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(2,2)")
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("customer"),
        F.date_sub(F.lit(AS_OF).cast("date"), (key % SPEND_DAYS).cast("int")).alias("date"),
        campaign_id.alias("campaign_id"),
        campaign.alias("campaign"),
        spend.cast("decimal(18,4)").alias("spend"),
        (key % 1000 * 10 + 100).alias("impressions"),
        (key % 50 + 1).alias("clicks"),
        (key % 4).alias("conversions"),
    )


def _with_channel(spark: SparkSession, sf_dir: str, spend: DataFrame) -> DataFrame:
    joined = spend.join(_segments(spark, sf_dir), F.col("customer") == F.col("c_custkey"), "left")
    return joined.withColumn("channel", F.coalesce("segment", F.lit("unknown"))).select(
        "date", "channel", "campaign_id", "campaign", "spend", "impressions", "clicks", "conversions"
    )


def plain_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spend rows of the last 60 days by order key, without a channel and so without a join."""
    priority = F.col("o_orderpriority")
    return _spend_rows(spark, sf_dir, F.substring(priority, 1, 1), priority)


def marketing_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spend rows: priority as campaign, the customer's segment as channel."""
    return _with_channel(spark, sf_dir, plain_spend(spark, sf_dir))


def account_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same spend with one campaign per customer."""
    customer = F.col("o_custkey").cast("string")
    return _with_channel(spark, sf_dir, _spend_rows(spark, sf_dir, customer, F.concat(F.lit("account "), customer)))


def spend_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The spend rows as the tables of two platforms."""
    spend = marketing_spend(spark, sf_dir)
    is_meta = F.col("channel").isin(*META_CHANNELS)
    return {"meta_marketing_spend": spend.filter(is_meta), "google_marketing_spend": spend.filter(~is_meta)}


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices: fulfilled ones are paid."""
    status = F.when(F.col("o_orderstatus") == "F", "paid").when(F.col("o_orderstatus") == "O", "open").otherwise("void")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("invoice_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        status.alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount_paid"),
        F.date_sub(F.lit(AS_OF).cast("date"), (F.col("o_orderkey") % SPEND_DAYS).cast("int")).alias("created"),
    )


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as events of their customers, over years."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.lit("purchase").alias("event_type"), F.to_date("o_orderdate").alias("event_date")
    )


def touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journeys: every event is a touch of the channel that its campaign stands for."""
    return plain_events(spark, sf_dir).select("user_id", "event_id", "ts", F.col("utm_campaign").alias("channel"), "revenue")


def campaigns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns with their first day and a budget."""
    return (
        marketing_spend(spark, sf_dir)
        .groupBy(F.concat_ws("/", "channel", "campaign_id").alias("campaign_id"), F.col("campaign").alias("name"), "channel")
        .agg(F.min("date").alias("start_date"), F.sum("impressions").alias("monthly_budget"))
    )


def _case(column: str, spellings: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in spellings.items())
    return f"CASE {column} {whens} ELSE {default} END"


_SEGMENT = "coalesce(lower(c.c_mktsegment), 'unknown')"
_CAMPAIGN = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CAMPAIGN_SPELLINGS))



def _spend_sql(campaign_id: str, campaign: str) -> str:
    return f"""
        SELECT DATE '{AS_OF}' - CAST(o_orderkey % {SPEND_DAYS} AS INTEGER) AS date, {_SEGMENT} AS channel,
               {campaign_id} AS campaign_id, {campaign} AS campaign,
               CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(18,4)) AS spend,
               o_orderkey % 1000 * 10 + 100 AS impressions, o_orderkey % 50 + 1 AS clicks, o_orderkey % 4 AS conversions
        FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"""


CTES = {
    "user_events": f"""
        SELECT CAST(e.user_id AS VARCHAR) AS user_id, e.event_id, e.ts, e.event_type, CAST(e.ts AS DATE) AS event_date,
               {_case(_SEGMENT, SOURCE_SPELLINGS, _SEGMENT)} AS utm_source,
               coalesce(CASE TRY_CAST(regexp_extract(e.props, '"k": *([0-9]+)', 1) AS INTEGER) % 5 {_CAMPAIGN} END, '')
                 AS utm_campaign,
               CASE WHEN e.event_type = 'purchase' THEN CAST(e.value AS DECIMAL(18,2)) ELSE 0 END AS revenue
        FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey""",
    "marketing_spend": _spend_sql("substr(o_orderpriority, 1, 1)", "o_orderpriority"),
    "account_spend": _spend_sql("CAST(o_custkey AS VARCHAR)", "'account ' || o_custkey"),
    "spend_data": f"""
        SELECT CASE WHEN channel IN {META_CHANNELS} THEN 'meta_marketing_spend' ELSE 'google_marketing_spend' END
                 AS source_table, *
        FROM marketing_spend""",
    "invoices": f"""
        SELECT CAST(o_orderkey AS VARCHAR) AS invoice_id, CAST(o_custkey AS VARCHAR) AS customer_id,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'open' ELSE 'void' END AS status,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount_paid,
               DATE '{AS_OF}' - CAST(o_orderkey % {SPEND_DAYS} AS INTEGER) AS created
        FROM orders""",
    "order_history": """
        SELECT CAST(o_custkey AS VARCHAR) AS user_id, 'purchase' AS event_type, CAST(o_orderdate AS DATE) AS event_date
        FROM orders""",
    "touches": "SELECT user_id, event_id, ts, utm_campaign AS channel, revenue FROM user_events",
    "campaigns": """
        SELECT channel || '/' || campaign_id AS campaign_id, campaign AS name, channel, min(date) AS start_date,
               CAST(sum(impressions) AS BIGINT) AS monthly_budget
        FROM marketing_spend GROUP BY ALL""",
}
_NEEDS = {"spend_data": ("marketing_spend",), "touches": ("user_events",), "campaigns": ("marketing_spend",)}


def with_tables(names: str, query: str, **steps: str) -> str:
    """``query`` with the canonical tables in ``names`` and further ``steps`` as CTEs."""
    ordered: list[str] = []
    for name in names.split():
        for needed in (*_NEEDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    parts = [f"{name} AS ({CTES[name]})" for name in ordered] + [f"{name} AS ({sql})" for name, sql in steps.items()]
    return "WITH " + ",\n".join(parts) + "\n" + query if parts else query


def sql_round(value: str, digits: int) -> str:
    """Half-up rounding as :func:`tidemark.functions.numeric.rounded` does it."""
    return f"CAST(round(CAST(({value}) AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def sql_ratio(numerator: str, denominator: str, digits: int) -> str:
    """A guarded ratio in double."""
    quotient = sql_round(f"CAST({numerator} AS DOUBLE) / CAST({denominator} AS DOUBLE)", digits)
    return f"CASE WHEN {denominator} > 0 THEN {quotient} END"
