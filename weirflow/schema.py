"""Explicit schemas, allowed values and row validation for the transfer model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values of the transfer contract
SCHEMA_VERSION = "1.0.0"
STATUSES = ("pending", "completed", "failed", "reversed", "held")
CHANNELS = ("upi", "neft", "rtgs", "imps", "wire", "card", "cash", "internal", "other")
ORIGINS = ("bank_feed", "manual_upload", "api_push", "synthetic")
CASE_STATUSES = ("open", "under_review", "escalated", "resolved", "closed")
CASE_ORIGINS = ("customer_report", "bank_detection", "shared_intelligence", "manual_investigation", "synthetic")
EVIDENCE_PROVIDERS = ("ingestion", "graph_engine", "taint_engine", "ml_model", "human_analyst", "external_system")

ACCOUNT = T.StructType(
    [T.StructField("account_id", T.StringType(), False), T.StructField("institution", T.StringType()), T.StructField("label", T.StringType())]
)
EVENT = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("transaction_id", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("sender", ACCOUNT),
        T.StructField("receiver", ACCOUNT),
        T.StructField("amount_minor_units", T.LongType()),
        T.StructField("currency", T.StringType()),
        T.StructField("occurred_at", T.StringType()),
        T.StructField("observed_at", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("origin", T.StringType()),
    ]
)
CASE = T.StructType(
    [
        T.StructField("schema_version", T.StringType()),
        T.StructField("case_id", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("origin", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("transaction_ids", T.ArrayType(T.StringType())),
        T.StructField("opened_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
EVIDENCE = T.StructType(
    [
        T.StructField("evidence_id", T.StringType(), False),
        T.StructField("case_id", T.StringType()),
        T.StructField("provider_type", T.StringType()),
        T.StructField("provider_name", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("body", T.StringType()),  # JSON
        T.StructField("created_at", T.TimestampType()),
    ]
)
_ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def violations(event: Column | None = None) -> Column:
    """Names of the contract rules that a nested event row breaks, in declaration order."""
    col = (lambda n: event[n]) if event is not None else F.col

    def broken(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    return F.array_compact(
        F.array(
            broken("schema_version", F.coalesce(col("schema_version"), F.lit(SCHEMA_VERSION)) == SCHEMA_VERSION),
            broken("event_id", F.length(col("event_id")) >= 1),
            broken("transaction_id", F.length(col("transaction_id")) >= 1),
            broken("sender", F.length(col("sender")["account_id"]) >= 1),
            broken("receiver", F.length(col("receiver")["account_id"]) >= 1),
            broken("amount_minor_units", col("amount_minor_units") >= 0),
            broken("currency", (F.length(col("currency")) == 3) & (F.upper(col("currency")) == col("currency"))),
            broken("occurred_at", col("occurred_at").rlike(_ZONED) & F.try_to_timestamp(col("occurred_at")).isNotNull()),
            broken("observed_at", col("observed_at").rlike(_ZONED) & F.try_to_timestamp(col("observed_at")).isNotNull()),
            broken("status", col("status").isin(*STATUSES)),
            broken("channel", col("channel").isin(*CHANNELS)),
            broken("origin", col("origin").isin(*ORIGINS)),
        )
    )


def flatten(events: DataFrame) -> DataFrame:
    """Nested events to the flat transfer columns; extra columns stay."""
    named = ("sender", "receiver", "occurred_at", "observed_at")
    return events.select(
        *(c for c in events.columns if c not in named),
        F.col("sender.account_id").alias("sender"),
        F.col("receiver.account_id").alias("receiver"),
        F.col("sender.institution").alias("sender_inst"),
        F.col("receiver.institution").alias("receiver_inst"),
        F.try_to_timestamp("occurred_at").alias("occurred_at"),
        F.try_to_timestamp("observed_at").alias("observed_at"),
    )
