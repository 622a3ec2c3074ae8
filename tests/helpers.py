from datetime import datetime, timedelta

T0 = datetime(2026, 10, 8, 12, 0)
SCHEMA = (
    "case_id string, event_id string, transaction_id string, ingest_seq bigint, sender string, receiver string, "
    "amount_minor_units bigint, occurred_at timestamp_ntz, status string"
)


def graph(spark, *rows, case="c"):
    """Rows are (event, sender, receiver, minutes[, amount[, status]])."""
    out = []
    for n, (event, sender, receiver, minutes, *rest) in enumerate(rows):
        amount, status = (*rest, *(10_000, "completed")[len(rest) :])
        out.append((case, event, f"tx-{event}", n, sender, receiver, amount, T0 + timedelta(minutes=minutes), status))
    return spark.createDataFrame(out, SCHEMA)


def seeds(spark, *rows, case="c"):
    """Rows are (event, amount[, source case])."""
    return spark.createDataFrame([(case, f"tx-{e}", a, f"{(*rest, case)[0]}:tx-{e}") for e, a, *rest in rows], "case_id string, transaction_id string, tainted_amount bigint, source_id string")


def at(spark, minutes, case="c"):
    return spark.createDataFrame([(case, T0 + timedelta(minutes=minutes))], "case_id string, as_of timestamp_ntz")


def named(spark, *accounts, case="c"):
    return spark.createDataFrame([(case, a) for a in accounts], "case_id string, account string")


CHAIN = [("e1", "A", "B", 0), ("e2", "B", "C", 10), ("e3", "C", "D", 20)]
