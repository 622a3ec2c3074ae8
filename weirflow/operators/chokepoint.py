"""Time-expanded flow networks built by joins and windows, and their least cuts.

Node keys are text: ``S`` and ``T``; ``i:event`` and ``o:event`` for an event's
two ends; ``v:account:micros`` for an account at one of its times.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators import flow
from weirflow.operators.features import micros
from weirflow.operators.scan import active
from weirflow.operators.traverse import cut_lineage

WIDE = "decimal(38,0)"


@dataclass(frozen=True)
class Budgets:
    """What a search may take: sizes of one case's network, and paths that are counted."""

    # fixed values: defaults
    events: int = 10_000
    vertices: int = 50_000
    arcs: int = 100_000
    paths: int = 1_000

    def __post_init__(self) -> None:
        if min(self.events, self.vertices, self.arcs, self.paths) < 1:
            raise ValueError("budgets must be positive")


def check_terminals(sources: DataFrame, sinks: DataFrame) -> None:
    """Both sides must have accounts, and none in common."""
    clean = lambda d: d.where(F.trim(F.col("account").cast("string")) != "").select("case_id", F.trim(F.col("account").cast("string")).alias("account")).distinct()
    a, b = clean(sources), clean(sinks)
    if a.isEmpty() or b.isEmpty():
        raise ValueError("sources and sinks must not be empty")
    if not a.join(b, ["case_id", "account"], "left_semi").isEmpty():
        raise ValueError("an account is both source and sink")


def encoded_costs(events: DataFrame, eligible: DataFrame, collateral: DataFrame) -> DataFrame:
    """``case_id, event_id, collateral, cost``: least collateral first, then fewest edges.

    ``cost = collateral * (N + 1) + 1`` with N eligible edges of the case, in decimals.
    """
    open_ = events.select("case_id", "event_id").join(eligible.select("case_id", "event_id"), ["case_id", "event_id"], "left_semi")
    known = open_.join(collateral.select("case_id", "event_id", "collateral"), ["case_id", "event_id"], "left")
    known = known.join(F.broadcast(known.groupBy("case_id").agg(F.count("*").alias("n"))), "case_id")  # a number for each case
    n = F.col("n")
    amount = F.coalesce(F.col("collateral"), F.lit(0))
    checked = F.when(amount < 0, F.raise_error(F.lit("collateral must not be negative")).cast("bigint")).otherwise(amount)
    return known.select("case_id", "event_id", checked.alias("collateral"), (checked.cast("decimal(19,0)") * (n + 1).cast("decimal(18,0)") + 1).cast(WIDE).alias("cost"))


def network_arcs(events: DataFrame, costs: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, kind, from_node, to_node, capacity, event_id, cuttable`` of the six kinds of arcs.

    An account waits from each of its times to the next; an event leaves from
    the account's time before its own, so hops are strictly later; source
    accounts feed all their departures.
    """
    moves = active(events).select("case_id", "event_id", "sender", "receiver", micros("occurred_at").alias("t"))
    node = lambda account, t: F.concat(F.lit("v:"), F.col(account).cast("string"), F.lit(":"), F.col(t).cast("string"))
    enter, leave = F.concat(F.lit("i:"), F.col("event_id").cast("string")), F.concat(F.lit("o:"), F.col("event_id").cast("string"))
    infinite = costs.groupBy("case_id").agg((F.sum("cost") + 1).cast(WIDE).alias("infinite"))
    endless = lambda d: d.join(F.broadcast(infinite), "case_id", "left").withColumn("infinite", F.coalesce("infinite", F.lit(1).cast(WIDE)))
    times = moves.select("case_id", F.explode(F.array("sender", "receiver")).alias("account"), "t").distinct()
    of = Window.partitionBy("case_id", "account").orderBy("t")
    times = endless(times.withColumns({"before": F.lag("t").over(of), "after": F.lead("t").over(of)}))
    moves = endless(moves)
    none = F.lit(None).cast(dict(events.dtypes)["event_id"])
    arc = lambda d, kind, a, b, cap, event, cut: d.select("case_id", F.lit(kind).alias("kind"), a.alias("from_node"), b.alias("to_node"), cap.cast(WIDE).alias("capacity"), event.alias("event_id"), cut.alias("cuttable"))
    inf, no = F.col("infinite"), F.lit(False)
    priced = moves.join(costs.select("case_id", "event_id", "cost"), ["case_id", "event_id"], "left")
    leaving = moves.join(times.where("before IS NOT NULL").select("case_id", F.col("account").alias("sender"), "t", "before"), ["case_id", "sender", "t"])
    side = lambda accounts, to: moves.join(accounts.select("case_id", F.col("account").alias(to)).distinct(), ["case_id", to], "left_semi")
    parts = [
        arc(priced, "event", enter, leave, F.coalesce("cost", inf), F.col("event_id"), F.col("cost").isNotNull()),
        arc(times.where("after IS NOT NULL"), "wait", node("account", "t"), node("account", "after"), inf, none, no),
        arc(moves, "arrive", leave, node("receiver", "t"), inf, none, no),
        arc(leaving, "depart", node("sender", "before"), enter, inf, none, no),
        arc(side(sources, "sender"), "source", F.lit("S"), enter, inf, none, no),
        arc(side(sinks, "receiver"), "sink", leave, F.lit("T"), inf, none, no),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def budgets(arcs: DataFrame, limits: Budgets = Budgets()) -> DataFrame:
    """``case_id, events, vertices, arcs, exceeded``: sizes of each case's network against the limits."""
    ends = arcs.select("case_id", F.explode(F.array("from_node", "to_node")).alias("n")).groupBy("case_id").agg(F.count_distinct("n").alias("vertices"))
    sizes = arcs.groupBy("case_id").agg(F.count_if(F.col("kind") == "event").alias("events"), F.count("*").alias("arcs")).join(ends, "case_id")
    return sizes.withColumn("exceeded", (F.col("events") > limits.events) | (F.col("vertices") > limits.vertices) | (F.col("arcs") > limits.arcs))


def network_sizes(events: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, events, vertices, arcs`` of the network that ``network_arcs`` lists, counted from events and times without its arcs or names."""
    moves = active(events).select("case_id", "sender", "receiver", micros("occurred_at").alias("t"))
    for accounts, side, flag in ((sources, "sender", "begins"), (sinks, "receiver", "ends")):
        marked = accounts.select("case_id", F.col("account").alias(side)).distinct().withColumn(flag, F.lit(1))
        moves = moves.join(F.broadcast(marked), ["case_id", side], "left")  # terminals of the cases
    count = moves.groupBy("case_id").agg(F.count("*").alias("events"), F.count("begins").alias("begins"), F.count("ends").alias("ends"))
    leg = lambda side, sent: F.struct(F.col(side).alias("account"), F.lit(sent).alias("sent"))
    legs = moves.select("case_id", "t", F.explode(F.array(leg("sender", 1), leg("receiver", 0))).alias("leg")).select("case_id", "leg.account", "t", "leg.sent")
    times = legs.groupBy("case_id", "account", "t").agg(F.sum("sent").alias("sent"), F.min("sent").alias("alone"))
    of = Window.partitionBy("case_id", "account").orderBy("t")
    times = times.withColumns({"first": F.lag("t").over(of).isNull(), "last": F.lead("t").over(of).isNull()})
    # an account's only time is a node if something arrives then
    spots = times.groupBy("case_id").agg(F.count_if(~F.col("last")).alias("waits"), F.sum(F.when(~F.col("first"), F.col("sent")).otherwise(0)).alias("departs"), F.count_if(~(F.col("first") & F.col("last")) | (F.col("alone") == 0)).alias("spots"))
    ends = F.signum("begins").cast("bigint") + F.signum("ends").cast("bigint")
    return count.join(spots, "case_id").select("case_id", "events", (2 * F.col("events") + F.col("spots") + ends).alias("vertices"), (2 * F.col("events") + F.col("waits") + F.col("departs") + F.col("begins") + F.col("ends")).alias("arcs"))


def min_cut(events: DataFrame, costs: DataFrame, sources: DataFrame, sinks: DataFrame, limits: Budgets | None = None, region_arcs: int = flow.REGION_ARCS) -> DataFrame:
    """``case_id, status, cost, residual_path, event_id``: one row per cut edge, or one with a null event.

    The cut nearest the sources, which every maximum flow gives alike. A case of
    any size is solved, by regions. A caller may set budgets of the full
    network: cases beyond them get status ``budget_exceeded``.
    """
    moves = active(events)
    over = None
    if limits is not None:
        sizes = cut_lineage(budgets(network_arcs(moves, costs, sources, sinks), limits))
        over = sizes.where("exceeded").select("case_id")
        moves = moves.join(over, "case_id", "left_anti")
    found = flow.least_cut(moves, *flow.max_flow(flow.contracted(flow.on_paths(moves, sources, sinks), costs, sources, sinks), region_arcs))
    if over is None:
        return found
    event = dict(events.dtypes)["event_id"]
    return found.unionByName(over.select("case_id", F.lit("budget_exceeded").alias("status"), F.lit(None).cast(WIDE).alias("cost"), F.lit(None).cast("boolean").alias("residual_path"), F.lit(None).cast(event).alias("event_id")))


def chokepoints(events: DataFrame, eligible: DataFrame, collateral: DataFrame, sources: DataFrame, sinks: DataFrame, limits: Budgets | None = None) -> DataFrame:
    """The least-collateral cut of each case with its edges' details, in time order within the case."""
    costs = encoded_costs(active(events), eligible, collateral)
    return _detailed(events, costs, min_cut(events, costs, sources, sinks, limits))


def _detailed(events: DataFrame, costs: DataFrame, cut: DataFrame) -> DataFrame:
    detail = events.select("case_id", "event_id", "transaction_id", "sender", "receiver", "amount_minor_units", "occurred_at")
    out = cut.join(detail, ["case_id", "event_id"], "left").join(costs.withColumnRenamed("cost", "edge_cost"), ["case_id", "event_id"], "left")
    order = Window.partitionBy("case_id").orderBy("occurred_at", "event_id")
    return out.withColumn("position", F.when(F.col("event_id").isNotNull(), F.row_number().over(order)))


def count_paths(events: list[tuple], sources: set, sinks: set, most: int, depth: int = 10) -> int:
    """Paths of strictly later events without a repeated account from sources to sinks, up to ``most``.

    ``events``: (time, sender, receiver). Only events from which a sink can still be reached are followed.
    """
    last: dict = {}  # latest useful departure of each account
    leaving: dict = {}
    at = len(events)
    events = sorted(events, key=lambda e: e[0])
    while at:
        first = at - 1
        while first and events[first - 1][0] == events[at - 1][0]:
            first -= 1
        useful = [e for e in events[first:at] if e[2] in sinks or last.get(e[2], e[0]) > e[0]]
        for e in useful:
            last.setdefault(e[1], e[0])
            leaving.setdefault(e[1], []).append(e)
        at = first
    found = 0
    for source in sources:
        steps = [iter(leaving.get(source, ()))]
        path = [(None, source)]
        while steps and found < most:
            e = next(steps[-1], None)
            if e is None:
                steps.pop()
                path.pop()
                continue
            if (path[-1][0] is not None and e[0] <= path[-1][0]) or any(e[2] == a for _, a in path):
                continue
            if e[2] in sinks:
                found += 1
            elif len(steps) < depth:
                steps.append(iter(leaving.get(e[2], ())))
                path.append((e[0], e[2]))
    return found


def reports(events: DataFrame, eligible: DataFrame, collateral: DataFrame, sources: DataFrame, sinks: DataFrame, limits: Budgets | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per case of a search, and the edges of its cuts (as ``chokepoints`` gives them).

    Status, cost, size and collateral of the cut; whether it is verified: no
    residual flow in the network, and no path left in the graph without its
    edges. Paths before and after (counted up to the budget), sizes of the
    network, and sentences. Without ``limits`` every case is solved and paths are
    counted up to the default. Terminals that are missing or on both sides make a
    case ``invalid_input``.
    """
    moves = active(events)
    clean = lambda d: d.where(F.trim(F.col("account").cast("string")) != "").groupBy("case_id").agg(F.collect_set("account").alias("accounts"))
    sides = moves.select("case_id").distinct().join(clean(sources).withColumnRenamed("accounts", "sources"), "case_id", "left").join(clean(sinks).withColumnRenamed("accounts", "sinks"), "case_id", "left")
    invalid = F.col("sources").isNull() | F.col("sinks").isNull() | F.coalesce(F.arrays_overlap("sources", "sinks"), F.lit(False))
    sides = cut_lineage(sides.withColumn("invalid", invalid))
    asked = sides.where("NOT invalid")
    side = lambda c: asked.select("case_id", F.explode(c).alias("account"))
    costs = cut_lineage(encoded_costs(moves, eligible, collateral))
    sizes = network_sizes(moves.join(asked.select("case_id"), "case_id", "left_semi"), side("sources"), side("sinks"))
    most = (limits or Budgets()).paths
    cut = cut_lineage(min_cut(moves.join(asked.select("case_id"), "case_id", "left_semi"), costs, side("sources"), side("sinks"), limits))
    edges = _detailed(events, costs, cut)
    totals = edges.groupBy("case_id").agg(
        F.first("status").alias("status"), F.first("cost").alias("cost"), F.first("residual_path").alias("residual_path"), F.count("event_id").alias("cut_size"), F.coalesce(F.sum("collateral"), F.lit(0)).alias("collateral"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("event_id").isNotNull(), F.struct("position", "event_id", "collateral")))), lambda x: F.struct(x["event_id"].alias("event_id"), x["collateral"].alias("collateral"))).alias("per_edge"),
    )
    solved = totals.where("status = 'optimal_cut_found'").join(asked, "case_id").select("case_id", "sources", "sinks", F.col("per_edge.event_id").alias("cut"))
    solved = solved.select(*(F.col(c).alias(c) for c in solved.columns))  # both sides of the cogroup come from the transfers
    rows = moves.join(solved.select("case_id"), "case_id", "left_semi").select("case_id", "event_id", "sender", "receiver", micros("occurred_at").alias("t"))

    def verify(key: tuple, moves_: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        counts = []
        for one in asked_.itertuples():
            gone = set(one.cut)
            every = list(zip(moves_["event_id"], moves_["t"], moves_["sender"], moves_["receiver"]))
            before, after = ([e[1:] for e in every if keep or e[0] not in gone] for keep in (True, False))
            counts.append((key[0], *(count_paths(e, set(one.sources), set(one.sinks), most) for e in (before, after))))
        return pd.DataFrame(counts, columns=["case_id", "initial_paths", "residual_paths"])

    paths = rows.groupBy("case_id").cogroup(solved.groupBy("case_id")).applyInPandas(verify, "case_id string, initial_paths bigint, residual_paths bigint")
    out = sides.join(totals, "case_id", "left").join(paths, "case_id", "left").join(sizes, "case_id", "left").join(costs.groupBy("case_id").agg(F.count("*").alias("eligible")), "case_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    optimal = F.col("status") == "optimal_cut_found"
    out = out.withColumn("status", F.when(F.col("invalid"), "invalid_input").otherwise(F.coalesce("status", F.lit("no_path_exists"))))
    verified = (F.col("status") == "no_path_exists") | (optimal & ~F.col("residual_path") & (F.col("residual_paths") == 0))
    summary = F.when(
        optimal, F.format_string("A least cut of %d edge(s) parts %d source(s) from %d sink(s) at an estimated collateral of %d minor units.", zero("cut_size"), F.size("sources"), F.size("sinks"), zero("collateral"))
    ).otherwise(F.concat(F.lit("The search ended with status "), F.col("status"), F.lit(".")))
    return out.select(
        "case_id", "status", "cost", zero("cut_size"), zero("collateral"), F.coalesce(verified, F.lit(False)).alias("verified"), zero("initial_paths"), zero("residual_paths"),
        zero("events"), zero("vertices"), zero("arcs"), zero("eligible"), F.coalesce("per_edge", F.array().cast(dict(totals.dtypes)["per_edge"])).alias("per_edge"), summary.alias("summary"),
    ), edges


def cut_candidates(cut: DataFrame, account_type: str = "bigint") -> DataFrame:
    """Edge holds for the edges of a cut."""
    return cut.where("event_id IS NOT NULL").select("case_id", F.lit("edge_hold").alias("kind"), F.lit(None).cast(account_type).alias("target_account"), F.col("event_id").alias("target_event")).distinct()
