"""Transfer tables derived from the ``events`` stream table, in Spark and in SQL.

``transfers`` uses every user as an account; ``transfers_dense`` folds accounts
to twenty so that funds mix; ``transfers_ties`` truncates times to the hour so
that many events share a time. One case is one day, or one month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.schema import CHANNELS

DENSE_ACCOUNTS = 20


def transfers(spark: SparkSession, sf_dir: str, dense: bool = False, ties: bool = False, monthly: bool = False) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    n = DENSE_ACCOUNTS if dense else (events.agg(F.max("user_id")).first()[0] or 0) + 1
    sender = F.col("user_id") % n if dense else F.col("user_id")
    kind = F.col("event_type")
    bank = lambda c: F.concat(F.lit("BANK_"), F.substr(F.lit("ABCD"), (F.col(c) % 4 + 1).cast("int"), F.lit(1)))
    flat = events.select(
        "event_id",
        F.concat(F.lit("txn-"), F.col("event_id")).alias("transaction_id"),
        F.col("event_id").alias("ingest_seq"),
        sender.alias("sender"),
        ((sender + 1 + (F.col("event_id") % 7) * 2) % n).alias("receiver"),
        F.round(F.col("value") * 100).cast("bigint").alias("amount_minor_units"),
        F.lit("INR").alias("currency"),
        (F.date_trunc("hour", "ts").cast("timestamp_ntz") if ties else F.col("ts").cast("timestamp_ntz")).alias("occurred_at"),
        (F.col("ts").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id") % 5)).alias("observed_at"),
        F.when(kind == "signup", "pending").when(kind == "error", "failed").otherwise("completed").alias("status"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (F.col("event_id") % len(CHANNELS) + 1).cast("int")).alias("channel"),
        F.date_format("ts", "yyyy-MM" if monthly else "yyyy-MM-dd").alias("case_id"),
    )
    return flat.withColumns({"sender_inst": bank("sender"), "receiver_inst": bank("receiver")})


def transfers_sql(dense: bool = False, ties: bool = False, monthly: bool = False) -> str:
    """The body of a ``WITH transfers AS (...)`` clause over ``events``."""
    n = str(DENSE_ACCOUNTS) if dense else "(SELECT max(user_id) + 1 FROM events)"
    sender = f"(user_id % {n})" if dense else "user_id"
    time = "date_trunc('hour', ts)" if ties else "ts"
    channels = ", ".join(f"'{c}'" for c in CHANNELS)
    return f"""
        SELECT *, 'BANK_' || ['A','B','C','D'][sender % 4 + 1] AS sender_inst, 'BANK_' || ['A','B','C','D'][receiver % 4 + 1] AS receiver_inst
        FROM (SELECT event_id, 'txn-' || event_id AS transaction_id, event_id AS ingest_seq, {sender} AS sender,
            ({sender} + 1 + (event_id % 7) * 2) % {n} AS receiver, CAST(round(value * 100) AS BIGINT) AS amount_minor_units,
            'INR' AS currency, CAST({time} AS TIMESTAMP) AS occurred_at, ts + to_seconds(event_id % 5) AS observed_at,
            CASE event_type WHEN 'signup' THEN 'pending' WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
            [{channels}][event_id % {len(CHANNELS)} + 1] AS channel, strftime(ts, '{'%Y-%m' if monthly else '%Y-%m-%d'}') AS case_id
        FROM events)"""


def seeds(transfers: DataFrame) -> DataFrame:
    """One seed a case: its first active event, wholly tainted."""
    first = transfers.where("status = 'completed' AND amount_minor_units > 0").groupBy("case_id").agg(
        F.min_by(F.struct("transaction_id", "amount_minor_units"), F.struct("occurred_at", "ingest_seq")).alias("s")
    )
    return first.select(
        "case_id", F.col("s.transaction_id").alias("transaction_id"), F.col("s.amount_minor_units").alias("tainted_amount"),
        F.concat(F.lit("case-"), "case_id", F.lit(":"), F.col("s.transaction_id")).alias("source_id"),
    )
