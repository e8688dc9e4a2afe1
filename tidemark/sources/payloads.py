"""Raw payloads of billing, ads, CRM and product analytics as canonical tables.

Every normalizer takes a frame with the payloads as JSON text in one column
(one object per row, as ``spark.read.text`` gives it) and returns the table.
They are projections without shuffles or state, so they run on a batch and on
a stream alike. Text that is no JSON object is skipped, and ``rejected`` lists
it (``rejected_google_results`` those of ad reports). A field of another type than
usual never loses its record: nested payloads are parsed once to a variant, from
which each field is taken by its own path, flat ones as text by field, and what
cannot be read counts as missing. Missing text becomes '', missing amounts 0 and
missing dates null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions.dates import DateLike, date_from_epoch, time_from_epoch, to_date
from tidemark.functions.text import filled

PAYLOAD = "value"


def unpack_pages(pages: DataFrame, field: str = "data", column: str = PAYLOAD) -> DataFrame:
    """The objects of paged API responses ``{"<field>": [...]}``, one per row."""
    items = F.from_json(F.col(column), f"`{field}` array<string>")[field]
    return pages.select(F.explode_outer(items).alias(PAYLOAD)).filter(F.col(PAYLOAD).isNotNull())


# Texts of JSON values that count as false.
FALSE = ("", "false", "0", "0.0", "[]", "{}")


def _as_object(fields: str, text: Column) -> Column:
    """The named fields of an object given as text, each as text; null for anything else."""
    schema = ", ".join(f"`{name}` string" for name in fields.split())
    return F.from_json(F.when(text.rlike(r"^\s*\{"), text), schema)


def _as_list(text: Column) -> Column:
    """The elements of a list given as text, each as text; null for anything else."""
    return F.from_json(F.when(text.rlike(r"^\s*\["), text), "array<string>")


def _read(raw: DataFrame, fields: str, column: str) -> DataFrame:
    """``raw`` as ``_value`` with the parsed struct ``p``, null where the text is no JSON object.

    The parsed struct passes through an (outer) explode. Filters on it then stay
    behind the explode instead of being pushed down as further copies of the
    parser, so each text is parsed once.
    """
    schema = ", ".join(f"`{name}` string" for name in fields.split())
    text = F.when(F.col(column).rlike(r"^\s*\{"), F.col(column))
    parsed = F.from_json(text, f"{schema}, `_bad` string", {"columnNameOfCorruptRecord": "_bad"})
    read = raw.select(F.col(column).alias("_value"), F.explode_outer(F.array(parsed)).alias("p"))
    return read.withColumn("p", F.when(F.col("p._bad").isNull(), F.col("p")))


def _parse(raw: DataFrame, fields: str, column: str) -> DataFrame:
    """The payload as struct ``p`` with the named fields as text; rows that are no JSON object are dropped."""
    return _read(raw, fields, column).filter("p IS NOT NULL").select("p")


def rejected(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """The texts that the normalizers of single objects skip because they are no JSON object."""
    return _read(raw, "_any", column).filter("p IS NULL").select(F.col("_value").alias(PAYLOAD))


def _variants(raw: DataFrame, fields: str, column: str) -> DataFrame:
    """The payload as variant ``v``; rows that are no JSON object are dropped.

    Texts that are no strict JSON (repeated keys, single quotes) give a variant of
    the named fields. Parsed values pass through (outer) explodes for the reason
    given in ``_read``.
    """
    text = F.when(F.col(column).rlike(r"^\s*\{"), F.col(column))
    strict = raw.select(text.alias("_text"), F.explode_outer(F.array(F.try_parse_json(text))).alias("s"))
    schema = ", ".join(f"`{name}` string" for name in fields.split())
    again = F.from_json("_text", f"{schema}, `_bad` string", {"columnNameOfCorruptRecord": "_bad"})
    read = strict.select("s", F.explode_outer(F.array(F.when(F.col("s").isNull(), again))).alias("f"))
    values = [_as_variant(F.col(f"f.{name}")).alias(name) for name in fields.split()]
    known = read.filter("s IS NOT NULL OR (f IS NOT NULL AND f._bad IS NULL)")
    return known.select(F.coalesce("s", F.to_variant_object(F.struct(*values))).alias("v"))


def _as_variant(text: Column) -> Column:
    """A field's text as the JSON it is, or as a string."""
    return F.coalesce(F.try_parse_json(text), F.to_variant_object(F.array(text)).cast("array<variant>")[0])


def _at(path: str, variant: str = "v") -> Column:
    """The value at a path as text, null where any part of the path is missing or of another kind."""
    return F.nullif(F.try_variant_get(variant, f"$.{path}", "string"), F.lit(""))


def _text_at(path: str, default: str = "") -> Column:
    return F.coalesce(_at(path), F.lit(default))


def _is_true(text: Column) -> Column:
    return ~F.coalesce(F.trim(text), F.lit("")).isin(*FALSE)


def _truth(name: str) -> Column:
    return _is_true(F.col(name))


def _text(name: str) -> Column:
    return filled(F.col(name))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _minor(value: Column | str) -> Column:
    """Minor units (cents) as an amount."""
    units = F.coalesce(F.nullif(_column(value), F.lit("")).try_cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)"))
    return (units / 100).cast("decimal(18,2)")


def _number(value: Column | str, digits: int = 2) -> Column:
    """A number that may come as text; blank or unreadable as 0."""
    rounded = F.round(_column(value).try_cast("decimal(30,10)"), digits)
    return F.coalesce(rounded.try_cast(f"decimal(20,{digits})"), F.lit(0).cast(f"decimal(20,{digits})"))


def _whole(value: Column | str) -> Column:
    """The whole part of a number that may come as text; blank or unreadable as 0."""
    return F.coalesce(_column(value).try_cast("decimal(38,10)").try_cast("bigint"), F.lit(0))


def _day(value: Column) -> Column:
    """The day of an ISO time as written, without shifting its zone."""
    return F.substring(value, 1, 10).try_cast("date")


# -- billing -----------------------------------------------------------------


def normalize_stripe_customers(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Customers of the billing system."""
    return _parse(raw, "id email name created currency delinquent", column).select(
        _text("p.id").alias("customer_id"),
        _text("p.email").alias("email"),
        _text("p.name").alias("name"),
        date_from_epoch(F.col("p.created")).alias("created"),
        _text("p.currency").alias("currency"),
        _truth("p.delinquent").alias("delinquent"),
    )


_INVOICE = (
    "id customer customer_email customer_details status currency amount_paid amount_due amount_remaining created "
    "subscription status_transitions lines"
)


def normalize_stripe_invoices(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Invoices; the period is that of the first line. Customer details that are text are the address."""
    details = F.when(~F.coalesce(_at("customer_details"), F.lit("")).rlike(r"^\s*[\[{]"), _at("customer_details"))
    return _variants(raw, _INVOICE, column).select(
        _text_at("id").alias("invoice_id"),
        _text_at("customer").alias("customer_id"),
        F.coalesce(_at("customer_email"), _at("customer_details.email"), details, F.lit("")).alias("customer_email"),
        _text_at("status").alias("status"),
        _text_at("currency").alias("currency"),
        *[_minor(_at(name)).alias(name) for name in ("amount_paid", "amount_due", "amount_remaining")],
        date_from_epoch(_at("created")).alias("created"),
        date_from_epoch(_at("lines.data[0].period.start")).alias("period_start"),
        date_from_epoch(_at("lines.data[0].period.end")).alias("period_end"),
        _text_at("subscription").alias("subscription_id"),
    )


def normalize_stripe_subscriptions(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Subscriptions with the price of their first item."""
    fields = "id customer status created current_period_start current_period_end cancel_at_period_end items"
    price = "items.data[0].price"
    return _variants(raw, fields, column).select(
        _text_at("id").alias("subscription_id"),
        _text_at("customer").alias("customer_id"),
        _text_at("status").alias("status"),
        *[date_from_epoch(_at(name)).alias(name) for name in ("created", "current_period_start", "current_period_end")],
        _is_true(_at("cancel_at_period_end")).alias("cancel_at_period_end"),
        _text_at(f"{price}.currency").alias("currency"),
        _text_at(f"{price}.id").alias("price_id"),
        _minor(_at(f"{price}.unit_amount")).alias("unit_amount"),
        _text_at(f"{price}.recurring.interval").alias("interval"),
    )


def stripe_invoices_to_events(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Paid invoices as purchase events of their customer."""
    return (
        _variants(raw, _INVOICE, column)
        .filter(_at("status") == "paid")
        .select(
            F.coalesce(_at("customer"), _at("customer_email"), _at("id"), F.lit("")).alias("user_id"),
            F.lit("purchase").alias("event_type"),
            F.coalesce(date_from_epoch(_at("status_transitions.paid_at")), date_from_epoch(_at("created"))).alias("event_date"),
            F.lit("stripe").alias("utm_source"),
            _minor(_at("amount_paid")).alias("revenue"),
            F.lit("stripe").alias("source_system"),
        )
    )


# -- ads ---------------------------------------------------------------------


def normalize_meta_campaigns(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Campaigns of the first ads platform; a list of delivery states is joined by commas."""
    fields = "id name objective status effective_status created_time start_time stop_time daily_budget lifetime_budget"
    state = F.col("p.effective_status")
    joined = F.array_join(_as_list(state), ",")
    return _parse(raw, fields, column).select(
        _text("p.id").alias("campaign_id"),
        _text("p.name").alias("name"),
        F.lit("meta_ads").alias("channel"),
        _text("p.objective").alias("objective"),
        _text("p.status").alias("status"),
        F.when(joined.isNotNull(), joined).otherwise(filled(state)).alias("effective_status"),
        _day(F.col("p.created_time")).alias("created_time"),
        _day(F.col("p.start_time")).alias("start_date"),
        _day(F.col("p.stop_time")).alias("stop_date"),
        _minor("p.daily_budget").alias("daily_budget"),
        _minor("p.lifetime_budget").alias("lifetime_budget"),
        F.lit("meta_ads").alias("source_system"),
    )


def normalize_meta_spend(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Daily insights as spend rows. The platform reports no conversions here."""
    fields = "date_start campaign_id campaign_name spend impressions clicks reach cpc ctr"
    return _parse(raw, fields, column).select(
        F.col("p.date_start").try_cast("date").alias("date"),
        F.lit("meta_ads").alias("channel"),
        _text("p.campaign_id").alias("campaign_id"),
        _text("p.campaign_name").alias("campaign"),
        _number("p.spend").alias("spend"),
        _whole("p.impressions").alias("impressions"),
        _whole("p.clicks").alias("clicks"),
        F.lit(0.0).alias("conversions"),
        _whole("p.reach").alias("reach"),
        _number("p.cpc").alias("cpc"),
        _number("p.ctr").alias("ctr"),
        F.lit("meta_ads").alias("source_system"),
    )


def _google_results(raw: DataFrame, column: str, kind: str) -> DataFrame:
    """The results of report batches as ``r`` of the given type; a single batch counts as a list of one.

    What does not fit the type is null, by itself: an unfit field costs neither its
    result nor its neighbours. One walk through a parsed text takes all fields. A
    text that is no strict JSON gives those of its results that are.
    """
    parsed = raw.select(F.col(column).alias("_value"), F.explode_outer(F.array(F.try_parse_json(column))).alias("b"))
    batch = f"struct<results:array<{kind}>>"
    batches = F.coalesce(F.try_variant_get("b", "$", f"array<{batch}>"), F.array(F.try_variant_get("b", "$", batch)))
    # A batch without results adds none; a list with a null list in it would flatten to null.
    results = F.flatten(F.filter(batches["results"], lambda listed: listed.isNotNull()))
    texts = F.flatten(F.from_json("_value", "array<struct<results:array<string>>>")["results"])
    lenient = F.transform(F.filter(texts, lambda text: text.isNotNull()), lambda text: F.try_variant_get(F.try_parse_json(text), "$", kind))
    return parsed.select("_value", F.explode_outer(F.when(F.col("b").isNotNull(), results).otherwise(lenient)).alias("r"))


def _is_object(variant: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))


def rejected_google_results(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """What the normalizers of ad reports skip: texts without any result, and results that are no object."""
    read = _google_results(raw, column, "variant").filter(~_is_object("r"))
    return read.select(F.coalesce(F.to_json("r"), F.col("_value")).alias(PAYLOAD))


def _google_fields(raw: DataFrame, column: str, **parts: str) -> DataFrame:
    """The named fields of each part of the results as text in structs by part; results that are no object are dropped."""
    fields = {part: ", ".join(f"`{name}`: string" for name in names.split()) for part, names in parts.items()}
    kind = ", ".join(f"`{part}`: struct<{names}>" for part, names in fields.items())
    return _google_results(raw, column, f"struct<{kind}>").filter("r IS NOT NULL").select("r.*")


def normalize_google_campaigns(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Campaigns of the second ads platform."""
    return _google_fields(raw, column, campaign="id name advertisingChannelType advertisingChannelSubType status startDate endDate").select(
        _text("campaign.id").alias("campaign_id"),
        _text("campaign.name").alias("name"),
        F.lit("google_ads").alias("channel"),
        _text("campaign.advertisingChannelType").alias("campaign_type"),
        _text("campaign.advertisingChannelSubType").alias("campaign_sub_type"),
        _text("campaign.status").alias("status"),
        F.col("campaign.startDate").try_cast("date").alias("start_date"),
        F.col("campaign.endDate").try_cast("date").alias("end_date"),
        F.lit("google_ads").alias("source_system"),
    )


def normalize_google_spend(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Daily campaign performance as spend rows; costs come in millionths."""
    fields = {"campaign": "id name", "segments": "date", "metrics": "costMicros impressions clicks conversions"}
    cost = F.coalesce(F.col("metrics.costMicros").try_cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return _google_fields(raw, column, **fields).select(
        F.col("segments.date").try_cast("date").alias("date"),
        F.lit("google_ads").alias("channel"),
        _text("campaign.id").alias("campaign_id"),
        _text("campaign.name").alias("campaign"),
        F.round(cost / 1_000_000, 2).cast("decimal(20,2)").alias("spend"),
        _whole("metrics.impressions").alias("impressions"),
        _whole("metrics.clicks").alias("clicks"),
        _number("metrics.conversions").cast("double").alias("conversions"),
        F.lit("google_ads").alias("source_system"),
    )


# -- CRM ---------------------------------------------------------------------


def normalize_hubspot_contacts(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Contacts; a missing stage or source is 'unknown'."""
    return _variants(raw, "id properties", column).select(
        _text_at("id").alias("id"),
        _text_at("properties.email").alias("email"),
        _text_at("properties.firstname").alias("firstname"),
        _text_at("properties.lastname").alias("lastname"),
        _day(_at("properties.createdate")).alias("created_date"),
        _text_at("properties.lifecyclestage", "unknown").alias("lifecycle_stage"),
        _text_at("properties.hs_analytics_source", "unknown").alias("lead_source"),
        F.lit(0).alias("num_associated_deals"),
    )


def normalize_hubspot_deals(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Deals; an unreadable amount is 0 and a missing source 'direct'."""
    return _variants(raw, "id properties", column).select(
        _text_at("id").alias("id"),
        _text_at("properties.dealname").alias("dealname"),
        F.coalesce(_at("properties.amount").try_cast("double"), F.lit(0.0)).alias("amount"),
        _text_at("properties.dealstage").alias("stage"),
        _day(_at("properties.createdate")).alias("created_date"),
        _day(_at("properties.closedate")).alias("close_date"),
        _text_at("properties.pipeline").alias("pipeline"),
        _text_at("properties.hs_analytics_source", "direct").alias("utm_source"),
    )


# -- product analytics -------------------------------------------------------


def normalize_mixpanel_events(
    raw: DataFrame, column: str = PAYLOAD, event_names: Sequence[str] | None = None
) -> DataFrame:
    """Exported events with their properties kept as JSON text, optionally of some names only."""
    properties = _as_object("distinct_id time utm_source utm_campaign", F.col("p.properties"))
    events = _parse(raw, "event properties", column).withColumn("q", properties)
    result = events.select(
        _text("p.event").alias("event"),
        _text("q.distinct_id").alias("distinct_id"),
        time_from_epoch(F.col("q.time")).alias("time"),
        _text("q.utm_source").alias("utm_source"),
        _text("q.utm_campaign").alias("utm_campaign"),
        F.coalesce("p.properties", F.lit("{}")).alias("properties_json"),
    )
    return result.filter(F.col("event").isin(list(event_names))) if event_names else result


def normalize_mixpanel_funnels(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """One row per funnel step, numbered from 0; funnels come alone, as a list or as a list under ``results``.

    A step that is no object keeps its number and has no users.
    """
    text = F.col(column)
    listed = F.coalesce(_as_list(text), _as_list(_as_object("results", text)["results"]), F.array(text))
    funnels = raw.select(F.explode(listed).alias(column))
    parsed = _parse(funnels, "funnel_id id steps", column).select(
        F.coalesce("p.funnel_id", "p.id", F.lit("")).alias("funnel_id"), F.posexplode(_as_list(F.col("p.steps"))).alias("step_index", "step")
    )
    parsed = parsed.withColumn("s", _as_object("event name count conversion_rate step_conv_ratio", F.col("step")))
    rate = F.coalesce("s.conversion_rate", "s.step_conv_ratio")
    return parsed.select(
        "funnel_id",
        F.coalesce("s.event", "s.name", F.concat(F.lit("Step "), F.col("step_index"))).alias("step_name"),
        "step_index",
        _whole("s.count").alias("count"),
        F.coalesce(F.round(rate.try_cast("decimal(30,10)"), 4).cast("double"), F.lit(0.0)).alias("conversion_rate"),
    )


# The export's time format, and the one it is rewritten to.
_EXPORT_TIME = "yyyy-MM-dd HH:mm:ss.SSSSSS"
_ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def normalize_amplitude_events(raw: DataFrame, column: str = PAYLOAD) -> DataFrame:
    """Exported events; campaign tags of the user come before those of the event.

    ``timestamp`` is ISO text; a time in another format is kept as it came.
    """
    fields = "event_type user_id session_id device_type country event_time revenue user_properties event_properties"
    time = _at("event_time")

    def tag(name: str) -> Column:
        return F.coalesce(_at(f"user_properties.{name}"), _at(f"event_properties.{name}"), F.lit(""))

    return _variants(raw, fields, column).select(
        *[_text_at(name).alias(name) for name in ("event_type", "user_id", "session_id", "device_type", "country")],
        tag("utm_source").alias("utm_source"),
        tag("utm_campaign").alias("utm_campaign"),
        F.coalesce(_at("revenue").try_cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.date_format(F.try_to_timestamp(time, F.lit(_EXPORT_TIME)), _ISO_TIME), time, F.lit("")).alias(
            "timestamp"
        ),
    )


def normalize_amplitude_cohorts(raw: DataFrame, as_of: DateLike, column: str = PAYLOAD) -> DataFrame:
    """Cohorts of a cohort listing; a missing computation day is ``as_of``."""
    parsed = _parse(raw, "cohorts", column).select(F.explode(_as_list(F.col("p.cohorts"))).alias("cohort"))
    parsed = parsed.select(_as_object("id name size lastComputed", F.col("cohort")).alias("c")).filter("c IS NOT NULL")
    computed = F.when(F.length("c.lastComputed") >= 10, _day(F.col("c.lastComputed")))
    return parsed.select(
        _text("c.id").alias("cohort_id"),
        _text("c.name").alias("cohort_name"),
        _whole("c.size").alias("size"),
        F.coalesce(computed, F.lit(to_date(as_of))).alias("last_computed"),
    )
