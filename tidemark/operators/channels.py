"""Revenue attribution by channel: observed, by journey shares and by touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tidemark.functions.numeric import percent, ratio, rounded, zero_if_null


def channel_attribution(spend: DataFrame, events: DataFrame) -> DataFrame:
    """Spend against purchase revenue per channel, with ROAS and revenue share."""
    channel_spend = spend.groupBy("channel").agg(F.sum("spend").alias("spend"))
    revenue = (
        events.filter(F.col("event_type") == "purchase")
        .groupBy(F.col("utm_source").alias("channel"), "user_id")
        .agg(F.sum("revenue").alias("revenue"))
        .groupBy("channel")
        .agg(F.count("user_id").alias("conversions"), F.sum("revenue").alias("revenue"))
    )
    joined = channel_spend.join(revenue, "channel", "full").select(
        "channel",
        zero_if_null(F.col("spend")).alias("spend"),
        zero_if_null(F.col("conversions")).alias("conversions"),
        zero_if_null(F.col("revenue")).alias("revenue"),
    )
    # The totals read every column, so their exchanges equal the main plan's and are reused.
    totals = joined.agg(
        F.struct(
            F.sum("revenue").alias("revenue"), F.sum("spend").alias("spend"), F.sum("conversions").alias("conversions")
        )
    )
    return (
        joined.withColumn("total", totals.scalar())
        .withColumn("revenue_share_pct", zero_if_null(percent(F.col("revenue"), F.col("total.revenue"))))
        .withColumn("roas", ratio(F.col("revenue"), F.col("spend"), 2))
        .drop("total")
    )


def shapley_attribution(
    touches: DataFrame,
    revenue: DataFrame | None = None,
    user_col: str = "user_id",
    channel_col: str = "channel",
    revenue_col: str = "revenue",
) -> DataFrame:
    """``channel, attributed_revenue, pct``: exact Shapley values over user journeys.

    A coalition of channels is worth its share of the journey's touches times
    the revenue. Such a game is additive, so a channel's Shapley value is its
    own share and no coalition has to be enumerated. Journeys without revenue
    count for nothing.

    ``revenue`` holds one or more rows per user; without it the touches carry
    the revenue themselves.
    """
    user, channel = F.col(user_col).alias("user_id"), F.col(channel_col).alias("channel")
    measures = [F.count(F.lit(1)).alias("touches")]
    if revenue is None:
        measures.append(F.sum(revenue_col).alias("revenue"))
    counts = touches.groupBy(user, channel).agg(*measures)
    journey = Window.partitionBy("user_id")
    shares = counts.withColumn("journey_touches", F.sum("touches").over(journey)).withColumn(
        "journey_channels", F.count(F.lit(1)).over(journey)
    )
    if revenue is None:
        shares = shares.withColumn("revenue", F.sum("revenue").over(journey))
    else:
        totals = revenue.groupBy(F.col(user_col).alias("user_id")).agg(F.sum(revenue_col).alias("revenue"))
        shares = shares.join(totals, "user_id")
    share = F.col("revenue").cast("double") * F.col("touches") / F.col("journey_touches")
    value = share.try_cast("decimal(30,10)")
    per_channel = (
        shares.filter(F.col("revenue") > 0)
        # A journey's shares are rounded to 4 digits unless one channel takes all.
        .withColumn("value", F.when(F.col("journey_channels") > 1, F.round(value, 4)).otherwise(value))
        .groupBy("channel")
        .agg(F.sum("value").alias("value"))
    )
    total = per_channel.agg(F.sum("value").alias("total"))
    return per_channel.withColumn("total", total.scalar()).select(
        "channel",
        rounded(F.col("value"), 2).alias("attributed_revenue"),
        percent(F.col("value"), F.col("total")).alias("pct"),
    )


# Least and largest of a timestamp in microseconds and of a long, with digits that hold them.
_LOWEST_TIME, _TIME_DIGITS = -(10**17) * 6, 18
_LOWEST_LONG, _LONG_DIGITS = -(2**63), 20
_TIMES = (T.TimestampType, T.TimestampNTZType)
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType)


def _decimal(number: int) -> Column:
    return F.lit(str(number)).cast("decimal(38,0)")


def _order_key(touches: DataFrame, order_cols: tuple[str, ...]) -> Column:
    """One number that sorts like the order columns, missing values first; a struct where they fit into none.

    A number has a fixed width, so the first or last touch of a user is found by a
    hash aggregate; a struct or text would sort all touches.
    """
    parts, digits = [], 0
    for name in order_cols:
        kind = touches.schema[name].dataType
        if isinstance(kind, _TIMES):
            value = F.unix_micros(F.col(name).cast("timestamp")) if isinstance(kind, T.TimestampType) else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), name)
            lowest, width = _LOWEST_TIME, _TIME_DIGITS
        elif isinstance(kind, _WHOLE):
            value = F.unix_date(name) if isinstance(kind, T.DateType) else F.col(name)
            lowest, width = _LOWEST_LONG, _LONG_DIGITS
        else:
            return F.struct(*order_cols)
        if len(order_cols) == 1:
            return F.coalesce(value.cast("long"), F.lit(_LOWEST_LONG))
        # Above zero, so that a missing value can be zero.
        whole = value.cast("decimal(38,0)") + _decimal(1 - lowest)
        parts.append((F.coalesce(whole.cast("decimal(38,0)"), _decimal(0)), width))
        digits += width
    if digits > 38:
        return F.struct(*order_cols)
    key = parts[0][0]
    for value, width in parts[1:]:
        key = (key * _decimal(10**width) + value).cast("decimal(38,0)")
    return key


def _touch(touches: DataFrame, pick, order_cols: tuple[str, ...]) -> DataFrame:
    """Revenue and converting users per channel of one touch of each journey.

    The aggregate by user carries a 64-bit number of the channel instead of its
    name, so its buffer has a fixed width; the names come back on the result, which
    has a row per channel. Two channels of one number are refused.
    """
    number = F.xxhash64("channel")
    users = (
        touches.select("user_id", "revenue", number.alias("number"), _order_key(touches, order_cols).alias("key"))
        .groupBy("user_id")
        .agg(pick("number", "key").alias("number"), F.sum("revenue").alias("revenue"))
        .filter(F.col("revenue") > 0)
    )
    found = users.groupBy("number").agg(F.count("user_id").alias("converters"), rounded(F.sum("revenue"), 2).alias("attributed_revenue"))
    names = touches.groupBy("channel").agg(F.count(F.lit(1)).alias("touches")).groupBy(F.xxhash64("channel").alias("number"))
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("two channels share a number")).cast("string")).otherwise(F.min("channel"))
    return found.join(names.agg(single.alias("channel")), "number", "left").select("channel", "converters", "attributed_revenue")


def first_touch(touches: DataFrame, order_cols: tuple[str, ...] = ("ts",)) -> DataFrame:
    """All revenue of a user to the channel of their first touch; a missing time comes before all others."""
    return _touch(touches, F.min_by, order_cols)


def last_touch(touches: DataFrame, order_cols: tuple[str, ...] = ("ts",)) -> DataFrame:
    """All revenue of a user to the channel of their last touch; a missing time comes before all others."""
    return _touch(touches, F.max_by, order_cols)
