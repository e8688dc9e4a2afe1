"""Schema contracts of the canonical tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column names under which a table may carry its date, by preference.
DATE_COLUMNS = ("date", "event_date", "created_at", "signup_date", "purchase_date")


@dataclass(frozen=True)
class Contract:
    """Required and optional columns of one table, with accepted other names."""

    name: str
    required: dict[str, T.DataType]
    optional: dict[str, T.DataType] = field(default_factory=dict)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        """Explicit read schema: required columns first."""
        return T.StructType([T.StructField(n, t) for n, t in {**self.required, **self.optional}.items()])


# Canonical tables, their columns and the accepted aliases.
CONTRACTS: dict[str, Contract] = {
    "marketing_spend": Contract(
        name="marketing_spend",
        required={"date": T.DateType(), "channel": T.StringType(), "spend": T.DoubleType()},
        optional={
            "campaign": T.StringType(),
            "impressions": T.LongType(),
            "clicks": T.LongType(),
            "conversions": T.DoubleType(),
        },
        aliases={
            "date": ("day", "spend_date"),
            "channel": ("utm_source", "source"),
            "spend": ("cost", "ad_spend"),
        },
    ),
    "user_events": Contract(
        name="user_events",
        required={"user_id": T.StringType(), "event_type": T.StringType(), "event_date": T.DateType()},
        optional={"utm_source": T.StringType(), "revenue": T.DoubleType()},
        aliases={
            "event_date": ("date", "occurred_at"),
            "event_type": ("event", "type"),
            "utm_source": ("channel", "source"),
        },
    ),
    "campaigns": Contract(
        name="campaigns",
        required={"campaign_id": T.StringType(), "name": T.StringType(), "channel": T.StringType()},
        optional={"start_date": T.DateType(), "monthly_budget": T.LongType(), "status": T.StringType()},
        aliases={"campaign_id": ("id",), "monthly_budget": ("budget",)},
    ),
}
