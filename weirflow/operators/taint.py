"""Pooled proportional provenance: an ordered fold per case, and what follows from it.

The fold is not associative, since proportions depend on the order of events,
but events that share no account do not wait for each other. A case of up to
``fold_events`` events is one fold, in (time, ingestion) order, read a batch at a time. A larger one is
taken apart: accounts that are connected by no transfer are folds of their own;
a connected part that is still too large is cut into stretches of ``PART_EVENTS``
events (``fold_events``, if fewer), folded one after another, and within a stretch again the accounts that
its events connect are folds of their own, which begin with the balances that
the stretch before has left. So no fold of a part has more than twice as many.
Everything derived from the allocations is built-in operations.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import CLEAN
from weirflow.operators.scan import active
from weirflow.operators.traverse import components, cut_lineage, ranked

PART = "struct<source_id:string,amount:bigint>"
ALLOCATION = (
    "case_id string, sequence int, event_id bigint, transaction_id string, sender bigint, receiver bigint, occurred_at timestamp_ntz, "
    "amount_minor_units bigint, balance_before bigint, tainted_before bigint, tainted bigint, clean bigint, unattributed bigint, "
    f"is_seed boolean, contributions array<{PART}>"
)


def split(amount: int, pool: dict[str, int]) -> dict[str, int]:
    """Largest-remainder split of ``amount`` over ``pool``; leftovers by larger remainder, then key."""
    total = sum(pool.values())
    if not total or not amount:
        return dict.fromkeys(pool, 0)
    out, remainders = {}, []
    for key, balance in pool.items():
        out[key], rest = divmod(amount * balance, total)
        remainders.append((-rest, key))
    for _, key in sorted(remainders)[: amount - sum(out.values())]:
        out[key] += 1
    return out


class Ledger:
    """Balances by account: clean money and money of each source."""

    def __init__(self, balances: dict | None = None) -> None:
        self.balances: dict = {a: dict(p) for a, p in (balances or {}).items()}

    def copy(self) -> Ledger:
        return Ledger(self.balances)

    def _credit(self, account, clean: int, parts: dict[str, int]) -> None:  # noqa: ANN001
        pool = self.balances.setdefault(account, {CLEAN: 0})
        pool[CLEAN] += clean
        for source, amount in parts.items():
            if amount:
                pool[source] = pool.get(source, 0) + amount

    def seed(self, receiver, amount: int, parts: dict[str, int]) -> tuple:  # noqa: ANN001
        """Inject seeds: the receiver is credited and nobody is debited."""
        tainted = sum(parts.values())
        self._credit(receiver, amount - tainted, parts)
        return 0, tainted, tainted, amount - tainted, 0, parts

    def transfer(self, sender, receiver, amount: int) -> tuple:  # noqa: ANN001
        """Move money in the pool's proportions: before, tainted before, tainted, clean, unattributed, parts."""
        pool = self.balances.setdefault(sender, {CLEAN: 0})
        before = sum(pool.values())
        covered = min(amount, before)
        parts = split(covered, pool)
        for key, moved in parts.items():
            pool[key] -= moved
        for key in [k for k, v in pool.items() if not v and k != CLEAN]:
            del pool[key]
        clean = parts.pop(CLEAN, 0)
        parts = {k: v for k, v in parts.items() if v}
        tainted_before = before - pool[CLEAN] - clean
        self._credit(receiver, clean + amount - covered, parts)
        return before, tainted_before, sum(parts.values()), clean, amount - covered, parts


def replay(ledger: Ledger, events: Iterable[tuple], seeded: dict[str, dict[str, int]], blocked: frozenset | set = frozenset()) -> list[tuple]:
    """Run ``(event_id, transaction_id, sender, receiver, amount)`` in order, but for ``blocked``; one outcome an event that ran."""
    out = []
    for event_id, transaction_id, sender, receiver, amount in events:
        if event_id in blocked:
            continue
        parts = seeded.get(transaction_id)
        outcome = ledger.seed(receiver, amount, parts) if parts else ledger.transfer(sender, receiver, amount)
        out.append((event_id, *outcome, bool(parts)))
    return out


def check_seeds(transfers: DataFrame, seeds: DataFrame) -> DataFrame:
    """``case_id, problem`` for whatever makes a taint run invalid; no row if it is valid."""
    moves = active(transfers).select("case_id", "transaction_id", "event_id", "amount_minor_units")
    joined = seeds.groupBy("case_id", "transaction_id").agg(F.sum("tainted_amount").alias("sum"), F.min("tainted_amount").alias("least"))
    joined = joined.join(moves, ["case_id", "transaction_id"], "left").groupBy("case_id", "transaction_id").agg(
        F.first("sum").alias("sum"), F.first("least").alias("least"), F.count("event_id").alias("n"), F.max("amount_minor_units").alias("amount")
    )
    problem = (
        F.when(F.col("least") <= 0, "seed amount must be positive").when(F.col("n") == 0, "seed has no active event")
        .when(F.col("n") > 1, "seed has several active events").when(F.col("sum") > F.col("amount"), "seeds exceed the transfer")
    )
    bad = joined.select("case_id", problem.alias("problem")).where("problem IS NOT NULL")
    twice = transfers.groupBy("case_id", "event_id").count().where("count > 1").select("case_id", F.lit("repeated event id").alias("problem"))
    sources = seeds.groupBy("case_id", "source_id").count().where("count > 1").select("case_id", F.lit("repeated source").alias("problem"))
    return bad.unionByName(twice).unionByName(sources)


def seeds_of(pdf: pd.DataFrame) -> dict[str, dict[str, int]]:
    """Seeds by transaction: amounts by source."""
    out: dict[str, dict[str, int]] = {}
    for tx, source, amount in zip(pdf["transaction_id"], pdf["source_id"], pdf["tainted_amount"]):
        if source is not None and not pd.isna(amount):
            out.setdefault(tx, {})[source] = int(amount)
    return out


_COLUMNS = ["case_id", "event_id", "transaction_id", "ingest_seq", "sender", "receiver", "amount_minor_units", "occurred_at"]
#: Events of one fold. A whole case is read in batches, so this bounds the time of a task and, for parts of a case, their data frames.
FOLD_EVENTS = 2_000_000
#: Events of a part of a larger case, a data frame each.
PART_EVENTS = 200_000


def _fold(ledger: Ledger, events: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
    """``events`` in order with what each carried; ``ledger`` is left as it is after them."""
    events = events.sort_values(["occurred_at", "ingest_seq"], kind="stable").reset_index(drop=True)
    moves = zip(events["event_id"], events["transaction_id"], events["sender"], events["receiver"], (int(a) for a in events["amount_minor_units"]))
    ran = replay(ledger, moves, seeds_of(marked))
    frame = events.copy()
    if "sequence" not in frame:
        frame.insert(1, "sequence", range(len(frame)))
    for name, i in (("balance_before", 1), ("tainted_before", 2), ("tainted", 3), ("clean", 4), ("unattributed", 5), ("is_seed", 7)):
        frame[name] = [r[i] for r in ran]
    frame["contributions"] = pd.Series([[{"source_id": s, "amount": a} for s, a in sorted(r[6].items())] for r in ran], dtype=object)
    return frame


def allocations(transfers: DataFrame, seeds: DataFrame, fold_events: int = FOLD_EVENTS) -> DataFrame:
    """What each active event carried: one row per event, in ``sequence`` within its case."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _typed(transfers, ALLOCATION)
    names = [f.name for f in _parse_datatype_string(schema).fields]
    moves = active(transfers).select(*_COLUMNS)
    marked = seeds.select(*(F.col(c).alias(c) for c in ("case_id", "transaction_id", "source_id", "tainted_amount")))
    large = cut_lineage(moves.groupBy("case_id").count().where(F.col("count") > fold_events).select("case_id"))
    if large.isEmpty():
        return _in_order(moves, marked, schema, names)
    whole = _in_order(moves.join(large, "case_id", "left_anti"), marked, schema, names)
    return whole.unionByName(_in_parts(moves.join(large, "case_id", "left_semi"), marked, min(fold_events, PART_EVENTS), schema, names))


def _marks_of(events: pd.DataFrame) -> pd.DataFrame:
    """Seeds of ``events`` from their ``marks``, one row each."""
    marks = [(tx, m["source_id"], m["tainted_amount"]) for tx, some in zip(events["transaction_id"], events["marks"]) if some is not None for m in some]
    return pd.DataFrame(marks, columns=["transaction_id", "source_id", "tainted_amount"])


def _in_order(moves: DataFrame, marked: DataFrame, schema: str, names: list[str]) -> DataFrame:
    """Allocations of whole cases: a task reads its cases' events in order, a batch at a time, and holds one ledger."""
    told = marked.groupBy("case_id", "transaction_id").agg(F.collect_list(F.struct("source_id", "tainted_amount")).alias("marks"))
    rows = moves.join(told, ["case_id", "transaction_id"], "left").repartition("case_id")
    rows = rows.sortWithinPartitions("case_id", F.asc_nulls_last("occurred_at"), F.asc_nulls_last("ingest_seq"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        ledger, case, done = Ledger(), None, 0
        for batch in batches:
            for _, events in batch.groupby("case_id", sort=False, dropna=False):
                now = events["case_id"].iloc[0]
                if now != case:
                    ledger, case, done = Ledger(), now, 0
                numbered = events.assign(sequence=range(done, done + len(events)))
                yield _fold(ledger, numbered, _marks_of(events))[names]
                done += len(events)

    return rows.mapInPandas(run, schema)


def _in_parts(moves: DataFrame, marked: DataFrame, fold_events: int, schema: str, names: list[str]) -> DataFrame:
    """Allocations of cases that are too large for one fold."""
    moves = cut_lineage(ranked(moves, "case_id", ["occurred_at", "ingest_seq"], "sequence").withColumn("sequence", F.col("sequence").cast("int")))
    told = marked.groupBy("case_id", "transaction_id").agg(F.collect_list(F.struct("source_id", "tainted_amount")).alias("marks"))
    moves = moves.join(told, ["case_id", "transaction_id"], "left")

    def with_root(rows: DataFrame, scope: list[str], name: str) -> DataFrame:
        roots = components(rows.select(*scope, F.col("sender").alias("a"), F.col("receiver").alias("b")), scope)
        return rows.join(roots.select(*scope, F.col("node").alias("sender"), F.col("root").alias(name)), [*scope, "sender"])

    moves = cut_lineage(with_root(moves, ["case_id"], "part"))
    sizes = moves.groupBy("case_id", "part").agg(F.count("*").alias("n"))
    order = Window.partitionBy("case_id", "part").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    # a stretch is a run of spans of the case's sequence, each with fold_events of its events at most, so it has less than twice as many
    spans = moves.join(sizes.where(F.col("n") > fold_events).drop("n"), ["case_id", "part"], "left_semi").withColumn("__span", F.floor(F.col("sequence") / fold_events))
    spans = spans.groupBy("case_id", "part", "__span").agg(F.count("*").alias("n")).withColumn("stretch", (F.coalesce(F.sum("n").over(order), F.lit(0)) / fold_events).cast("int"))
    moves = moves.withColumn("__span", F.floor(F.col("sequence") / fold_events)).join(spans.drop("n"), ["case_id", "part", "__span"], "left").drop("__span")
    moves = cut_lineage(moves.withColumn("stretch", F.coalesce("stretch", F.lit(0))))
    moves = cut_lineage(with_root(moves, ["case_id", "part", "stretch"], "fold"))
    types = dict(moves.dtypes)
    balance = f"case_id string, account {types['sender']}, source_id string, amount bigint"

    def run(key: tuple, events: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        columns = ["case_id", "account", "source_id", "amount", *names[1:]]
        if not len(events):
            return pd.DataFrame([], columns=columns, dtype=object)
        pools: dict = {}
        for account, source, amount in zip(held["account"], held["source_id"], held["amount"]):
            pools.setdefault(account, {CLEAN: 0})[source] = int(amount)
        ledger = Ledger(pools)
        done = _fold(ledger, events, _marks_of(events))[names]
        rows = [(key[0], None, None, None, *r[1:]) for r in done.itertuples(index=False, name=None)]
        rows += [(key[0], a, s, v, *(None for _ in names[1:])) for a, pool in ledger.balances.items() for s, v in pool.items() if v]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    out_schema = f"{balance}, {schema.removeprefix('case_id string, ')}"
    balances_, found = None, None
    for k in range(moves.agg(F.max("stretch")).first()[0] + 1):
        now = moves.where(F.col("stretch") == k)
        touched = now.select("case_id", "fold", F.explode(F.array("sender", "receiver")).alias("account")).distinct()
        empty = touched.select("case_id", "fold", "account", F.lit("").alias("source_id"), F.lit(0).cast("bigint").alias("amount")).where("false")
        held = empty if balances_ is None else balances_.join(touched, ["case_id", "account"]).select("case_id", "fold", "account", "source_id", "amount")
        held = held.select(*(F.col(c).alias(c) for c in held.columns))
        said = cut_lineage(now.groupBy("case_id", "fold").cogroup(held.groupBy("case_id", "fold")).applyInPandas(run, out_schema))
        done, after = said.where("event_id IS NOT NULL").select(*names), said.where("account IS NOT NULL").select("case_id", "account", "source_id", "amount")
        found = done if found is None else found.unionByName(done)
        kept = after if balances_ is None else balances_.join(touched.select("case_id", "account"), ["case_id", "account"], "left_anti").unionByName(after)
        balances_ = cut_lineage(kept)
    return found


def _typed(transfers: DataFrame, schema: str) -> str:
    """``schema`` with the account and event id types of ``transfers``."""
    types = dict(transfers.dtypes)
    for name in ("event_id", "sender", "receiver"):
        schema = schema.replace(f" {name} bigint", f" {name} {types[name]}")
    return schema


def movements(allocated: DataFrame) -> DataFrame:
    """Signed changes by account and source (``__clean__`` for clean money); seeds debit nobody."""
    entry = lambda account, source, amount: F.struct(F.col(account).alias("account"), source.alias("source_id"), amount.cast("bigint").alias("amount"))
    inward = F.transform("contributions", lambda c: entry("receiver", c["source_id"], c["amount"]))
    outward = F.transform("contributions", lambda c: entry("sender", c["source_id"], -c["amount"]))
    clean_in = F.array(entry("receiver", F.lit(CLEAN), F.col("clean") + F.col("unattributed")))
    clean_out = F.array(entry("sender", F.lit(CLEAN), -F.col("clean")))
    all_ = F.when(F.col("is_seed"), F.concat(inward, clean_in)).otherwise(F.concat(inward, clean_in, outward, clean_out))
    return allocated.select("case_id", "sequence", F.explode(all_).alias("m")).select("case_id", "sequence", "m.*")


def source_balances(allocated: DataFrame) -> DataFrame:
    """Final ``amount`` by account and source, where positive."""
    return movements(allocated).groupBy("case_id", "account", "source_id").agg(F.sum("amount").alias("amount")).where("amount > 0")


def balances(allocated: DataFrame) -> DataFrame:
    """Final ``clean``, ``tainted`` and sorted ``contributions`` of accounts that hold anything."""
    held = source_balances(allocated)
    clean = F.col("source_id") == CLEAN
    part = F.when(~clean, F.struct("source_id", "amount"))
    return held.groupBy("case_id", "account").agg(
        F.coalesce(F.sum(F.when(clean, F.col("amount"))), F.lit(0)).alias("clean"), F.coalesce(F.sum(F.when(~clean, F.col("amount"))), F.lit(0)).alias("tainted"),
        F.array_sort(F.collect_list(part)).alias("contributions"),
    )


def tainted_accounts(allocated: DataFrame) -> DataFrame:
    return balances(allocated).where("tainted > 0")


def shortfalls(allocated: DataFrame) -> DataFrame:
    """Transfers of more than the sender was seen to hold."""
    return allocated.where("unattributed > 0").select(
        "case_id", "sequence", "event_id", F.col("sender").alias("account"), "amount_minor_units", "balance_before", F.col("unattributed").alias("shortfall")
    )


def conservation(allocated: DataFrame, seeds: DataFrame) -> DataFrame:
    """Per source: injected, volume over edges, remaining in accounts, and the difference (zero)."""
    volume = allocated.select("case_id", F.explode("contributions").alias("c")).groupBy("case_id", F.col("c.source_id").alias("source_id")).agg(F.sum("c.amount").alias("edge_volume"))
    left = source_balances(allocated).where(F.col("source_id") != CLEAN).groupBy("case_id", "source_id").agg(F.sum("amount").alias("remaining"))
    out = seeds.groupBy("case_id", "source_id").agg(F.sum("tainted_amount").alias("injected")).join(volume, ["case_id", "source_id"], "left").join(left, ["case_id", "source_id"], "left")
    zero = lambda n: F.coalesce(n, F.lit(0))
    return out.select("case_id", "source_id", "injected", zero("edge_volume").alias("edge_volume"), zero("remaining").alias("remaining"), F.lit(0).cast("bigint").alias("terminated"), (F.col("injected") - zero("remaining")).alias("error"))


def allocations_for(allocated: DataFrame, source_id: str) -> DataFrame:
    return allocated.where(F.exists("contributions", lambda c: c["source_id"] == source_id))


def trace(allocated: DataFrame) -> DataFrame:
    """Per source: receivers in the order they first got its money."""
    parts = allocated.select("case_id", "sequence", "receiver", F.explode("contributions.source_id").alias("source_id"))
    first = parts.groupBy("case_id", "source_id", "receiver").agg(F.min("sequence").alias("sequence"))
    order = Window.partitionBy("case_id", "source_id").orderBy("sequence")
    return first.withColumn("step", F.row_number().over(order)).select("case_id", "source_id", "step", F.col("receiver").alias("account"), "sequence")


def inactive(transfers: DataFrame) -> DataFrame:
    """Ids of events that move no money."""
    return transfers.where("status <> 'completed'").select("case_id", "event_id", "status")
