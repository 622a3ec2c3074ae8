"""Sliding-window flow patterns as range frames and forward as-of lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.scan import active

_MICROS = "unix_micros(to_timestamp_ltz(occurred_at))"


def _burst(transfers: DataFrame, hub: str, spoke: str, seconds: int, k: int) -> DataFrame:
    """The first window of each hub that starts at one of its events and holds ``k`` distinct spokes.

    An event adds a spoke to every window that starts after the spoke's event
    before it, not later than itself, and not more than the window's length
    before. So the spokes of a window are counted by one running sum over the
    ends of such spans; no window is collected but the one that is returned.
    """
    moves = active(transfers).select("case_id", F.col(hub).alias("hub"), F.col(spoke).alias("spoke"), "event_id", "occurred_at", "ingest_seq", F.expr(_MICROS).alias("t"))
    # hubs with too few partners never open a window
    busy = moves.groupBy("case_id", "hub").agg(F.count_distinct("spoke").alias("n")).where(F.col("n") >= k).drop("n")
    moves = moves.join(busy, ["case_id", "hub"], "left_semi")
    length = int(seconds) * 1_000_000
    before = F.lag("t").over(Window.partitionBy("case_id", "hub", "spoke").orderBy("t", "ingest_seq"))
    spans = moves.select("case_id", "hub", "t", "ingest_seq", F.greatest(before, F.col("t") - length - 1).alias("after"))
    mark = lambda t, kind, change: F.struct(F.col(t).alias("t"), F.lit(kind).alias("kind"), F.lit(change).alias("change"))
    marks = spans.select("case_id", "hub", "ingest_seq", F.explode(F.array(mark("t", 0, 0), mark("after", 1, 1), mark("t", 1, -1))).alias("m")).select("case_id", "hub", "ingest_seq", "m.*")
    so_far = Window.partitionBy("case_id", "hub").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    first = marks.withColumn("held", F.sum("change").over(so_far)).where((F.col("kind") == 0) & (F.col("held") >= k)).groupBy("case_id", "hub").agg(F.min("t").alias("start"))
    inside = moves.join(first, ["case_id", "hub"]).where(F.col("t").between(F.col("start"), F.col("start") + length))
    found = inside.groupBy("case_id", "hub").agg(
        F.min("occurred_at").alias("window_start"), F.max("occurred_at").alias("window_end"), F.array_sort(F.collect_set("spoke")).alias("spokes"),
        F.array_sort(F.collect_list(F.struct("occurred_at", "ingest_seq", "event_id"))).alias("e"),
    )
    return found.select("case_id", "hub", "window_start", "window_end", "spokes", F.transform("e", lambda x: x["event_id"]).alias("event_ids"))


def fan_out(transfers: DataFrame, seconds: int = 3600, k: int = 3) -> DataFrame:
    """``case_id, source, window_start, window_end, targets, event_ids``: first burst to ``k`` or more receivers."""
    found = _burst(transfers, "sender", "receiver", seconds, k)
    return found.withColumnsRenamed({"hub": "source", "spokes": "targets"})


def fan_in(transfers: DataFrame, seconds: int = 3600, k: int = 3) -> DataFrame:
    """``case_id, target, window_start, window_end, sources, event_ids``: first burst from ``k`` or more senders."""
    found = _burst(transfers, "receiver", "sender", seconds, k)
    return found.withColumnsRenamed({"hub": "target", "spokes": "sources"})


def next_out(transfers: DataFrame) -> DataFrame:
    """Each incoming leg with the account's first outgoing event at or after it (a forward as-of join in one sort)."""
    moves = active(transfers)
    leg = lambda a, d: moves.select("case_id", F.col(a).alias("account"), F.lit(d).alias("d"), "event_id", "occurred_at", "ingest_seq", "amount_minor_units")
    both = leg("receiver", 0).unionByName(leg("sender", 1))
    order = Window.partitionBy("case_id", "account").orderBy("occurred_at", "d", "ingest_seq").rowsBetween(0, Window.unboundedFollowing)
    out = F.when(F.col("d") == 1, F.struct("event_id", "occurred_at", "amount_minor_units"))
    paired = both.withColumn("out", F.first(out, True).over(order)).where("d = 0 AND out IS NOT NULL")
    delay = F.expr(_MICROS.replace("occurred_at", "out.occurred_at")) - F.expr(_MICROS)
    return paired.select(
        "case_id", "account", F.col("event_id").alias("in_event_id"), F.col("out.event_id").alias("out_event_id"),
        F.col("occurred_at").alias("in_at"), F.col("out.occurred_at").alias("out_at"),
        F.col("amount_minor_units").alias("in_amount"), F.col("out.amount_minor_units").alias("out_amount"), delay.alias("delay_micros"),
    )


def rapid_pass_through(transfers: DataFrame, seconds: int = 300) -> DataFrame:
    """Incoming events that the account passes on within ``seconds``; an outgoing event may serve several."""
    return next_out(transfers).where(F.col("delay_micros") <= int(seconds) * 1_000_000)


def fan_out_fan_in(transfers: DataFrame, seconds: int = 3600, k: int = 3) -> DataFrame:
    """``case_id, source, target, intermediaries``: a fan-out whose receivers later meet, ``k`` or more, in one account."""
    spread = fan_out(transfers, seconds, k).select("case_id", "source", "window_start", F.explode("targets").alias("sender"))
    later = active(transfers).select("case_id", "sender", F.col("receiver").alias("target"), "occurred_at")
    met = spread.join(later, ["case_id", "sender"]).where("occurred_at > window_start AND target <> source")
    met = met.groupBy("case_id", "source", "target").agg(F.array_sort(F.collect_set("sender")).alias("intermediaries"))
    return met.where(F.size("intermediaries") >= k)
