"""Streams of transfers. The same functions take batch frames where no state is kept."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators.scan import active
from weirflow.operators.taint import Ledger, replay

TIME = "event_time"


def timed(transfers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``transfers`` with an instant column and a watermark on it."""
    return transfers.withColumn(TIME, F.to_timestamp_ltz("occurred_at")).withWatermark(TIME, late)


def deduplicated(transfers: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One row per event id within the watermark; state is dropped behind it."""
    return timed(transfers, late).dropDuplicatesWithinWatermark(["case_id", "event_id"])


def velocity(transfers: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Outgoing transfers and volume by account and tumbling or sliding window."""
    moves = timed(active(transfers), late) if transfers.isStreaming else active(transfers).withColumn(TIME, F.to_timestamp_ltz("occurred_at"))
    counted = moves.groupBy(F.window(TIME, size, slide or size), F.col("sender").alias("account")).agg(F.count("*").alias("transfers"), F.sum("amount_minor_units").alias("volume"))
    return counted.select("account", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "transfers", "volume")


def sessions(transfers: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Bursts of outgoing transfers of an account with no pause of ``gap`` or more."""
    moves = timed(active(transfers), late) if transfers.isStreaming else active(transfers).withColumn(TIME, F.to_timestamp_ltz("occurred_at"))
    counted = moves.groupBy(F.session_window(TIME, gap), F.col("sender").alias("account")).agg(F.count("*").alias("transfers"), F.sum("amount_minor_units").alias("volume"))
    return counted.select("account", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "transfers", "volume")


_OUT = (
    "case_id string, event_id bigint, transaction_id string, sender bigint, receiver bigint, occurred_at timestamp_ntz, amount_minor_units bigint, "
    "balance_before bigint, tainted bigint, clean bigint, unattributed bigint, is_seed boolean"
)


def running_taint(transfers: DataFrame, seeds: dict[str, dict[str, int]], late: str = "10 minutes") -> DataFrame:
    """Allocations of a stream: events wait until the watermark passes them, then run in (time, sequence) order.

    ``seeds``: by transaction id, the amount by source. State is one case's
    balances and its waiting events; rows behind the watermark never change
    what has been allotted.
    """
    moves = timed(active(transfers), late).select("case_id", "event_id", "transaction_id", "ingest_seq", "sender", "receiver", "amount_minor_units", "occurred_at", TIME)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        waiting, saved = state.get if state.exists else ("[]", "{}")
        rows, ledger = json.loads(waiting), Ledger({int(a): p for a, p in json.loads(saved).items()})
        if not state.hasTimedOut:
            for batch in batches:
                micros = batch["occurred_at"].astype("datetime64[us]").astype("int64")
                rows += [list(r) for r in zip(micros.tolist(), batch["ingest_seq"].tolist(), batch["event_id"].tolist(), batch["transaction_id"].tolist(), batch["sender"].tolist(), batch["receiver"].tolist(), batch["amount_minor_units"].tolist())]
        mark = state.getCurrentWatermarkMs() * 1000
        ready = sorted(r for r in rows if r[0] <= mark)
        rows = [r for r in rows if r[0] > mark]
        outcomes = replay(ledger, [tuple(r[2:]) for r in ready], seeds)
        state.update((json.dumps(rows), json.dumps({str(a): p for a, p in ledger.balances.items()})))
        if rows:
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(r[0] for r in rows) // 1000 + 1))
        if ready:
            frame = pd.DataFrame([r[2:] for r in ready], columns=["event_id", "transaction_id", "sender", "receiver", "amount_minor_units"])
            frame["case_id"], frame["occurred_at"] = key[0], pd.to_datetime([r[0] for r in ready], unit="us")
            for name, i in (("balance_before", 1), ("tainted", 3), ("clean", 4), ("unattributed", 5), ("is_seed", 7)):
                frame[name] = [o[i] for o in outcomes]
            yield frame[["case_id", "event_id", "transaction_id", "sender", "receiver", "occurred_at", "amount_minor_units", "balance_before", "tainted", "clean", "unattributed", "is_seed"]]

    return moves.groupBy("case_id").applyInPandasWithState(step, _OUT, "waiting string, ledger string", "append", "EventTimeTimeout")
