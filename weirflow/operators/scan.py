"""Filters, range queries, projections and set operations on transfers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDGE = ["case_id", "event_id", "transaction_id", "sender", "receiver", "amount_minor_units", "currency", "occurred_at", "observed_at", "status", "channel"]


def is_active() -> Column:
    """Only completed transfers move money."""
    return F.col("status") == "completed"


def active(transfers: DataFrame) -> DataFrame:
    return transfers.where(is_active())


def edges(transfers: DataFrame) -> DataFrame:
    """The edge columns only."""
    return transfers.select(*(c for c in EDGE if c in transfers.columns))


def between(transfers: DataFrame, start: Any = None, end: Any = None, active_only: bool = True) -> DataFrame:
    """Events in the closed range ``[start, end]``; both reach the scan as pushed filters."""
    out = active(transfers) if active_only else transfers
    if start is not None:
        out = out.where(F.col("occurred_at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("occurred_at") <= F.lit(end))
    return out


def outgoing(transfers: DataFrame, account: Any, start: Any = None, end: Any = None, active_only: bool = True) -> DataFrame:
    return between(transfers, start, end, active_only).where(F.col("sender") == F.lit(account))


def incoming(transfers: DataFrame, account: Any, start: Any = None, end: Any = None, active_only: bool = True) -> DataFrame:
    return between(transfers, start, end, active_only).where(F.col("receiver") == F.lit(account))


def in_time_order(transfers: DataFrame, *first: str) -> DataFrame:
    return transfers.orderBy(*first, "occurred_at", "ingest_seq")


def event(transfers: DataFrame, event_id: Any) -> DataFrame:
    """Point lookup; no row if there is no such event."""
    return transfers.where(F.col("event_id") == F.lit(event_id))


def accounts(transfers: DataFrame) -> DataFrame:
    """``case_id, account`` of all senders and receivers."""
    return legs(transfers).select("case_id", "account").distinct()


def legs(transfers: DataFrame) -> DataFrame:
    """Each transfer twice: as the sender's outgoing and the receiver's incoming leg (a self-transfer has both)."""
    leg = lambda account, other, direction: F.struct(F.col(account).alias("account"), F.col(other).alias("counterparty"), F.lit(direction).alias("direction"))
    both = transfers.withColumn("__leg", F.explode(F.array(leg("sender", "receiver", "out"), leg("receiver", "sender", "in"))))
    return both.select(*transfers.columns, "__leg.*")


def node_totals(transfers: DataFrame) -> DataFrame:
    """Per account: inflow, outflow and number of legs, over all statuses."""
    amount = F.col("amount_minor_units")
    return legs(transfers).groupBy("case_id", "account").agg(
        F.sum(F.when(F.col("direction") == "in", amount).otherwise(0)).alias("total_inflow"),
        F.sum(F.when(F.col("direction") == "out", amount).otherwise(0)).alias("total_outflow"),
        F.count("*").alias("transaction_count"),
    )


def timeline(transfers: DataFrame) -> DataFrame:
    """All events of each case with their position in time order (ties: order of ingestion)."""
    order = Window.partitionBy("case_id").orderBy("occurred_at", "ingest_seq")
    return transfers.withColumn("position", F.row_number().over(order) - 1)


def manifest(transfers: DataFrame) -> DataFrame:
    """Per case: node and edge counts, sorted nodes, event ids in time order; inactive events included."""
    nodes = accounts(transfers).groupBy("case_id").agg(F.count("*").alias("node_count"), F.array_sort(F.collect_list("account")).alias("nodes"))
    order = F.array_sort(F.collect_list(F.struct("occurred_at", "ingest_seq", "event_id")))
    events = transfers.groupBy("case_id").agg(F.count("*").alias("edge_count"), F.transform(order, lambda x: x["event_id"]).alias("event_ids"))
    return nodes.join(events, "case_id")


def as_of(transfers: DataFrame, time: Any | Column) -> DataFrame:
    """The graph that is known at ``time``: active events up to and including it."""
    return active(transfers).where(F.col("occurred_at") <= (time if isinstance(time, Column) else F.lit(time)))


def seeds_in(seeds: DataFrame, history: DataFrame) -> DataFrame:
    """Seeds whose transaction is part of ``history``."""
    return seeds.join(history.select("case_id", "transaction_id").distinct(), ["case_id", "transaction_id"], "left_semi")


def split_at(transfers: DataFrame, time: Any | Column) -> DataFrame:
    """``is_available``: whether an event is known at the decision time; ``step``: its rank among a case's distinct times."""
    order = Window.partitionBy("case_id").orderBy("occurred_at")
    when = time if isinstance(time, Column) else F.lit(time)
    return transfers.withColumns({"is_available": F.col("occurred_at") <= when, "step": F.dense_rank().over(order) - 1})


def normalised(events: DataFrame) -> DataFrame:
    """Observed events, edges and forecast hops in one shape.

    ``is_forecast``: the origin is synthetic or there is a probability;
    ``is_active``: the status is completed, or there is none.
    """
    def pick(*names: str) -> Column:
        found = [F.col(n).cast("string") for n in names if n in events.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    has = lambda n: n in events.columns
    forecast = F.lit(False)
    if has("origin"):
        forecast = forecast | F.coalesce(F.col("origin") == "synthetic", F.lit(False))
    if has("probability"):
        forecast = forecast | F.col("probability").isNotNull()
    keep = [c for c in ("case_id", "ingest_seq") if has(c)]
    return events.select(
        *keep, "event_id", (F.coalesce("transaction_id", F.col("event_id").cast("string")) if has("transaction_id") else F.col("event_id").cast("string")).alias("transaction_id"),
        pick("sender", "sender_account_id").alias("sender"), pick("receiver", "receiver_account_id").alias("receiver"),
        "occurred_at", "amount_minor_units",
        (F.coalesce(F.col("status") == "completed", F.lit(True)) if has("status") else F.lit(True)).alias("is_active"),
        forecast.alias("is_forecast"),
    )


def eligible(events: DataFrame, time: Any | Column | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """Events open to intervention: those of ``explicit``, else those after ``time``, else all."""
    if explicit is not None:
        return events.join(explicit.select("event_id").distinct(), "event_id", "left_semi")
    if time is None:
        return events
    return events.where(F.col("occurred_at") > (time if isinstance(time, Column) else F.lit(time)))
