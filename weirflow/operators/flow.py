"""Greatest flows and least cuts of time-expanded networks that may not fit one task.

Accounts hold money for any time, so a chain of waiting places matters only where
something arrives. The network is contracted to one node for each account and
time of arrival: an event is one arc from the sender's latest arrival before it
(or the source) to the receiver's node (or the sink), and an account waits from
each of its arrivals to the next. Hops stay strictly later.

A case is cut by time into regions of about ``region_arcs`` arcs; a region is one
task. The flow is found against the arcs' direction, so that the cut nearest the
sources falls out of it:

1. All arcs into the sink are filled, which gives their tails an excess.
2. Regions learn how many region borders lie between each border node and the
   source, by rounds of searches in their residual arcs, until nothing changes.
3. Every region pushes its excess towards the source, or to border nodes of
   other regions, nearest first, along augmenting paths. Pushed amounts are added
   up by arc. Steps 2 and 3 repeat until nothing moves.
4. What excess is left cannot reach the source; it is taken back along the arcs
   that it came from, in order of time. Now the amounts are a flow.

Nodes from which the source can be reached in residual arcs are its side of the
least cut. Cases of a single region need none of the rounds.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.features import micros
from weirflow.operators.scan import active
from weirflow.operators.traverse import cut_lineage

WIDE = "decimal(38,0)"
#: Arcs of a region, and the equal spans of a case's time from which regions are made up.
REGION_ARCS, SPANS = 1_000_000, 4096
_ARC = ("case_id", "arc", "tail", "tail_t", "tail_region", "head", "head_t", "head_region", "capacity", "flow")
_NEWS = "case_id string, region int, what string, name string, value string"


class FlowGraph:
    """Residual capacities as flat lists; augments along shortest levels without recursion."""

    def __init__(self, n: int) -> None:
        self.out: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, capacity: int, back: int = 0) -> int:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [capacity, back]
        return len(self.to) - 2

    def levels(self, start: int, end: int) -> list[int]:
        """Steps from ``start``, of no more nodes once ``end`` is reached: no shortest path holds them."""
        level = [-1] * len(self.out)
        level[start] = 0
        queue = deque([start])
        while queue and level[end] < 0:
            u = queue.popleft()
            for e in self.out[u]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[u] + 1
                    queue.append(self.to[e])
        return level

    def max_flow(self, start: int, end: int) -> int:
        total = 0
        while (level := self.levels(start, end))[end] >= 0:
            turn, path, u = [0] * len(self.out), [], start
            while True:
                if u == end:
                    least = min(self.room[e] for e in path)
                    total += least
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    full = next(i for i, e in enumerate(path) if not self.room[e])
                    u = self.to[path[full] ^ 1]
                    del path[full:]
                    continue
                while turn[u] < len(self.out[u]):
                    e = self.out[u][turn[u]]
                    if self.room[e] and level[self.to[e]] == level[u] + 1:
                        break
                    turn[u] += 1
                if turn[u] < len(self.out[u]):
                    path.append(self.out[u][turn[u]])
                    u = self.to[path[-1]]
                elif path:
                    level[u] = -1
                    u = self.to[path.pop() ^ 1]
                else:
                    break
        return total


def _sided(events: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, event_id, sender, receiver, occurred_at, status, t`` of active events, and whether one ``begins`` at a source or ``ends`` at a sink."""
    moves = active(events).select("case_id", "event_id", "sender", "receiver", "occurred_at", "status", micros("occurred_at").alias("t"))
    for accounts, side, flag in ((sources, "sender", "begins"), (sinks, "receiver", "ends")):
        marked = accounts.select("case_id", F.col("account").alias(side)).distinct().withColumn(flag, F.lit(True))
        moves = moves.join(F.broadcast(marked), ["case_id", side], "left")  # terminals of the cases
    return moves.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("begins", "ends")})


def _best_times(moves: DataFrame, start: str, here: str, there: str, sign: int) -> DataFrame:
    """``case_id, account, best``: the least ``sign * t`` of events at an account's ``there`` side on ways of events that leave each other ``here``, from those of ``start`` on.

    Rounds of a join with the accounts that got a better time, until there is none.
    """
    t = F.col("t") * sign
    of = lambda d: d.groupBy("case_id", F.col(there).alias("account")).agg(F.min(t).alias("best"))
    now = fresh = cut_lineage(of(moves.where(start)))
    between = moves.where("NOT begins AND NOT ends")
    while not fresh.isEmpty():
        found = of(between.join(fresh.withColumnsRenamed({"account": here, "best": "since"}), ["case_id", here]).where(t > F.col("since")))
        found = found.join(now.withColumnRenamed("best", "known"), ["case_id", "account"], "left").where("known IS NULL OR best < known")
        fresh = cut_lineage(found.select("case_id", "account", "best"))
        now = cut_lineage(now.unionByName(fresh).groupBy("case_id", "account").agg(F.min("best").alias("best")))
    return now


def on_paths(events: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, event_id, sender, receiver, occurred_at, status`` of the active ``events`` on a path of strictly later hops from a source to a sink; no other carries flow or is cut."""
    moves = cut_lineage(_sided(events, sources, sinks))
    arrival = _best_times(moves, "begins AND NOT ends", "sender", "receiver", 1)
    moves = moves.join(arrival.withColumnRenamed("account", "sender"), ["case_id", "sender"], "left").where("begins OR t > best").drop("best")
    moves = cut_lineage(moves)
    departure = _best_times(moves, "ends AND NOT begins", "receiver", "sender", -1)
    kept = moves.join(departure.withColumnRenamed("account", "receiver"), ["case_id", "receiver"], "left").where("ends OR -t > best")
    return cut_lineage(kept.select("case_id", "event_id", "sender", "receiver", "occurred_at", "status"))


def entered(events: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, events``: how many events ``contracted`` has an arc for: those of a source, or after an arrival at their sender."""
    moves = _sided(events, sources, sinks)
    first = moves.where("NOT ends").groupBy("case_id", F.col("receiver").alias("sender")).agg(F.min("t").alias("first"))
    known = moves.join(first, ["case_id", "sender"], "left")
    return known.groupBy("case_id").agg(F.count_if(F.col("begins") | F.coalesce(F.col("first") < F.col("t"), F.lit(False))).alias("events"))


def contracted(events: DataFrame, costs: DataFrame, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    """``case_id, arc, event_id, tail, tail_t, head, head_t, capacity, cuttable``: null tails are the source, null heads the sink.

    ``costs`` (``case_id, event_id, cost``) are the capacities; other events and
    waiting have more than all of them together. Events that no money from a
    source can enter by the first hop's account are left out.
    """
    moves = _sided(events, sources, sinks).join(costs.select("case_id", "event_id", "cost"), ["case_id", "event_id"], "left")
    infinite = costs.groupBy("case_id").agg((F.sum("cost") + 1).cast(WIDE).alias("infinite"))
    spot = lambda side, kind: moves.select("case_id", F.col(side).alias("account"), "t", F.lit(kind).alias("kind"))
    marks = spot("sender", 0).where(~moves["begins"]).unionByName(spot("receiver", 1).where(~moves["ends"])).distinct()
    earlier = Window.partitionBy("case_id", "account").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("before", F.last(F.when(F.col("kind") == 1, F.col("t")), ignorenulls=True).over(earlier))
    node = lambda account, t: F.when(F.col(t).isNotNull(), F.concat(F.col(account).cast("string"), F.lit(":"), F.col(t).cast("string")))
    leaving = marks.where("kind = 0").select("case_id", F.col("account").alias("sender"), "t", F.col("before").alias("tail_t"))
    hops = moves.join(leaving, ["case_id", "sender", "t"], "left").where("begins OR tail_t IS NOT NULL")
    hops = hops.withColumns({"tail_t": F.when(~F.col("begins"), F.col("tail_t")), "head_t": F.when(~F.col("ends"), F.col("t"))})
    none = F.lit(None).cast(dict(moves.dtypes)["event_id"])
    waits = marks.where("kind = 1 AND before IS NOT NULL").withColumnsRenamed({"before": "tail_t", "t": "head_t"})
    parts = [
        hops.select("case_id", F.concat(F.lit("e:"), F.col("event_id").cast("string")).alias("arc"), "event_id", node("sender", "tail_t").alias("tail"), "tail_t", node("receiver", "head_t").alias("head"), "head_t", F.col("cost").cast(WIDE).alias("capacity")),
        waits.select("case_id", F.concat(F.lit("w:"), node("account", "head_t")).alias("arc"), none.alias("event_id"), node("account", "tail_t").alias("tail"), "tail_t", node("account", "head_t").alias("head"), "head_t", F.lit(None).cast(WIDE).alias("capacity")),
    ]
    arcs = parts[0].unionByName(parts[1]).join(F.broadcast(infinite), "case_id", "left")  # a number for each case
    most = F.coalesce("infinite", F.lit(1).cast(WIDE))
    return arcs.select("case_id", "arc", "event_id", "tail", "tail_t", "head", "head_t", F.coalesce("capacity", most).alias("capacity"), F.col("capacity").isNotNull().alias("cuttable"), most.alias("infinite"))


def placed(arcs: DataFrame, region_arcs: int = REGION_ARCS) -> DataFrame:
    """``arcs`` with ``tail_region`` and ``head_region``: spans of time with about ``region_arcs`` arcs each."""
    times = arcs.select("case_id", F.coalesce("tail_t", "head_t").alias("t")).where("t IS NOT NULL")
    if times.groupBy("case_id").count().where(F.col("count") > region_arcs).isEmpty():
        one = lambda t: F.when(F.col(t).isNotNull(), 1)
        return arcs.select(*arcs.columns, one("tail_t").alias("tail_region"), one("head_t").alias("head_region"))
    case = arcs.groupBy("case_id").agg(F.min(F.least("tail_t", "head_t")).alias("first"), F.max(F.greatest("tail_t", "head_t")).alias("last"))
    span = lambda t: F.floor((t - F.col("first")) * SPANS / (F.col("last") - F.col("first") + 1)).cast("int")
    counts = times.join(F.broadcast(case), "case_id").groupBy("case_id", span(F.col("t")).alias("span")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("case_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("case_id", "span", F.floor(before / region_arcs).cast("int").alias("region")).groupBy("case_id", "region").agg(F.min("span").alias("span"))
    cuts = starts.groupBy("case_id").agg(F.array_sort(F.collect_list("span")).alias("regions"))  # SPANS entries at most
    known = arcs.join(F.broadcast(case), "case_id", "left").join(F.broadcast(cuts), "case_id", "left")
    region = lambda t: F.when(F.col(t).isNotNull(), F.size(F.filter("regions", lambda s: s <= span(F.col(t)))))
    return known.select(*arcs.columns, region("tail_t").alias("tail_region"), region("head_t").alias("head_region"))


class Region:
    """The residual arcs of one region; nodes of other regions are borders that take whatever comes."""

    def __init__(self, rows: pd.DataFrame, region: int, news: pd.DataFrame) -> None:
        self.region = region
        self.rows = [
            (arc, t, int(tr) if t is not None else None, h, int(hr) if h is not None else None, int(c), int(f))
            for arc, t, tr, h, hr, c, f in zip(rows["arc"], *(rows[c].where(rows[c].notna(), None) for c in ("tail", "tail_region", "head", "head_region")), rows["capacity"], rows["flow"])
        ]
        self.time = {}
        for side in ("tail", "head"):
            own = rows[rows[f"{side}_region"] == region]
            self.time.update(zip(own[side], own[f"{side}_t"]))
        names = ["<", ">", *self.time, *{n for r in self.rows for n in (r[1], r[3]) if n is not None and n not in self.time}]
        self.number = {n: i for i, n in enumerate(names)}
        self.names, self.own = names, len(self.time) + 2
        self.excess, self.label = {}, {}
        for what, name, value in zip(news["what"], news["name"], news["value"]):
            into = self.excess if what == "excess" else self.label
            into[name] = into.get(name, 0) + int(value)
        self.graph = FlowGraph(len(names))
        self.arcs = []  # number in the graph, row, +1 for pushing against the arc and -1 for along it, node and region across the border
        for r in self.rows:
            arc, tail, tail_region, head, head_region, capacity, flow = r
            if head is None:
                continue
            if tail is None:
                self.arcs.append((self.graph.arc(self.number[head], 1, capacity - flow), r, 1, None, None))
            elif tail_region == head_region:
                self.arcs.append((self.graph.arc(self.number[head], self.number[tail], capacity - flow, flow), r, 1, None, None))
            elif head_region == region:
                self.arcs.append((self.graph.arc(self.number[head], self.number[tail], capacity - flow), r, 1, tail, tail_region))
            else:
                self.arcs.append((self.graph.arc(self.number[tail], self.number[head], flow), r, -1, head, head_region))

    def _row(self, what: str, name: str, value: int, region: int | None = None) -> tuple:
        return self.region if region is None else region, what, name, str(value)

    def labels(self, every: bool = False) -> list[tuple]:
        """Borders between each node and the source; of border nodes, or of all."""
        g, found = self.graph, {}
        stages: dict[int, list[int]] = {0: [1]}
        for n in self.names[self.own :]:
            if n in self.label:
                stages.setdefault(self.label[n] + 1, []).append(self.number[n])
        for distance in sorted(stages):
            queue = deque(stages[distance])
            while queue:
                y = queue.popleft()
                for e in g.out[y]:
                    z = g.to[e]
                    if g.room[e ^ 1] and 2 <= z < self.own and z not in found:
                        found[z] = distance
                        queue.append(z)
        if every:
            return [self._row("side", self.names[z], d) for z, d in found.items()]
        border = {g.to[e ^ 1] for e, _, _, other, _ in self.arcs if other is not None}
        return [self._row("label", self.names[z], found[z]) for z in border if z in found]

    def discharge(self) -> list[tuple]:
        """Push the excess, nearest borders first: changed arcs, and where excess is now."""
        g = self.graph
        starts = {n: g.arc(0, self.number[n], amount) for n, amount in self.excess.items() if amount and n in self.number}
        moved = g.max_flow(0, 1)
        stages: dict[int, list[int]] = {}
        for n in self.names[self.own :]:
            if n in self.label:
                stages.setdefault(self.label[n], []).append(self.number[n])
        most = sum(self.excess.values()) + 1
        for distance in sorted(stages):
            for w in stages[distance]:
                g.arc(w, 1, most)
            moved += g.max_flow(0, 1)
        out = [self._row("excess", n, g.room[e]) for n, e in starts.items() if g.room[e]]
        for e, (arc, _, _, _, _, capacity, flow), sign, other, region in self.arcs:
            if sign > 0:
                change = capacity - flow - g.room[e]
                if other is not None and change:
                    out.append(self._row("excess", other, change, region))
            else:
                change = g.room[e] - flow
                if change:
                    out.append(self._row("excess", other, -change, region))
            if change:
                out.append(self._row("arc", arc, change))
        return [*out, self._row("moved", "", moved)] if moved else out

    def take_back(self) -> list[tuple]:
        """Move excess on to where it came from, in order of time, until none is left here."""
        leaving: dict[str, list] = {}
        flows = {}
        for e, r, sign, other, region in self.arcs:
            flow = self.graph.room[e ^ 1] if sign > 0 and other is None else r[6]
            if sign > 0 and r[1] is None:
                continue
            if r[1] in self.time:
                leaving.setdefault(r[1], []).append((r[0], r[3], r[4], flow))
            flows[r[0]] = r[6]
        for r in self.rows:
            if r[3] is None and r[1] is not None:
                leaving.setdefault(r[1], []).append((r[0], None, None, r[6]))
        out, held = [], dict(self.excess)
        for n in sorted(self.time, key=lambda n: (self.time[n], n)):
            need = held.pop(n, 0)
            for arc, head, region, flow in leaving.get(n, ()) if need else ():
                back = min(need, flow)
                if back:
                    need -= back
                    out.append(self._row("arc", arc, -back))
                    if head is not None and region == self.region:
                        held[head] = held.get(head, 0) + back
                    elif head is not None:
                        out.append(self._row("excess", head, back, region))
        return out


def solved(rows: pd.DataFrame) -> pd.DataFrame:
    """``what, name, value`` of a case that is one region: changes of its arcs' flow (``arc``), and the nodes on the source's side (``side``).

    The steps of ``Region``, of which a case takes each once, over numbers in
    place of names, which takes two thirds of the memory.
    """
    count = len(rows)
    ends = pd.concat([rows["tail"], rows["head"]], ignore_index=True)
    code, names = pd.factorize(ends)
    tail, head = (code[:count] + 2).tolist(), (code[count:] + 2).tolist()  # 1 is none: the source, or the sink
    when = np.zeros(len(names) + 2, np.int64)
    times = pd.concat([rows["tail_t"], rows["head_t"]], ignore_index=True)
    there = code >= 0
    when[code[there] + 2] = times[there].to_numpy(np.int64)
    del ends, times, code
    capacity = [int(c) for c in rows["capacity"]]
    graph, held, own = FlowGraph(len(names) + 2), {}, []
    for k, (a, b) in enumerate(zip(tail, head)):
        if b == 1:
            if a != 1:
                held[a] = held.get(a, 0) + capacity[k]
        else:
            own.append(k)
            graph.arc(b, a, capacity[k])  # arcs from the source end at it
    starts = {u: graph.arc(0, u, amount) for u, amount in held.items() if amount}
    graph.max_flow(0, 1)
    room = graph.room
    moved = [0] * count
    for place, k in enumerate(own):
        moved[k] = room[2 * place + 1]
    near, queue = {1}, deque([1])
    while queue:
        y = queue.popleft()
        for e in graph.out[y]:
            z = graph.to[e]
            if z > 1 and room[e ^ 1] and z not in near:
                near.add(z)
                queue.append(z)
    near.discard(1)
    left = {u: room[e] for u, e in starts.items() if room[e]}
    if left:  # what cannot reach the source goes back along the arcs that it came from, in order of time
        leaving: dict[int, list[int]] = {}
        for k, a in enumerate(tail):
            if a != 1:
                leaving.setdefault(a, []).append(k)
        for u in np.argsort(when, kind="stable").tolist():
            need = left.pop(u, 0) if u > 1 else 0
            for k in leaving.get(u, ()) if need else ():
                back = min(need, moved[k] + (capacity[k] if head[k] == 1 else 0))
                if back:
                    need -= back
                    moved[k] -= back
                    if head[k] != 1:
                        left[head[k]] = left.get(head[k], 0) + back
    changed = [k for k in range(count) if moved[k]]
    arcs = pd.DataFrame({"what": "arc", "name": rows["arc"].to_numpy()[changed], "value": [str(moved[k]) for k in changed]})
    return pd.concat([arcs, pd.DataFrame({"what": "side", "name": names[[z - 2 for z in near]], "value": "0"})])


def _halves(arcs: DataFrame) -> DataFrame:
    """A row of each arc for every region that it touches, as ``region``."""
    touched = F.array_distinct(F.array_compact(F.array("tail_region", "head_region")))
    return arcs.select(*_ARC, F.explode(touched).alias("region"))


def _rounds(halves: DataFrame, news: DataFrame, work: Callable[[Region], list[tuple]]) -> DataFrame:
    """What ``work`` says of every region, given its ``news``."""

    def run(key: tuple, rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["case_id", "region", "what", "name", "value"])
        said = work(Region(rows, int(key[1]), told))
        return pd.DataFrame([(key[0], *s) for s in said], columns=["case_id", "region", "what", "name", "value"])

    news = news.select(*(F.col(c).alias(c) for c in news.columns))  # rows of its own, where both come from one table
    return cut_lineage(halves.groupBy("case_id", "region").cogroup(news.groupBy("case_id", "region")).applyInPandas(run, _NEWS))


def _applied(arcs: DataFrame, said: DataFrame) -> DataFrame:
    changes = said.where("what = 'arc'").groupBy("case_id", F.col("name").alias("arc")).agg(F.sum(F.col("value").cast(WIDE)).alias("change"))
    known = arcs.join(changes, ["case_id", "arc"], "left")
    return cut_lineage(known.withColumn("flow", (F.col("flow") + F.coalesce("change", F.lit(0))).cast(WIDE)).drop("change"))


def _excess(said: DataFrame) -> DataFrame:
    rows = said.where("what = 'excess'").groupBy("case_id", "region", "name").agg(F.sum(F.col("value").cast(WIDE)).cast(WIDE).cast("string").alias("value"))
    return rows.select("case_id", "region", F.lit("excess").alias("what"), "name", "value")


def _distances(halves: DataFrame, borders: DataFrame) -> DataFrame:
    """News of labels for each region's borders, by rounds until no label gets smaller."""
    news, before = borders.select("case_id", "region", F.lit("label").alias("what"), "name", F.lit("").alias("value")).limit(0), None
    while True:
        labels = _rounds(halves, news, Region.labels)
        tally = tuple(labels.agg(F.count("*"), F.sum("value")).first())
        if tally == before:
            return news
        before = tally
        known = labels.select("case_id", "name", "value")
        news = cut_lineage(borders.join(known, ["case_id", "name"]).select("case_id", "region", F.lit("label").alias("what"), "name", "value"))


def max_flow(arcs: DataFrame, region_arcs: int = REGION_ARCS) -> tuple[DataFrame, DataFrame]:
    """``arcs`` (of ``contracted``) with the ``flow`` of each; and the nodes ``case_id, node`` on the sources' side of the least cut."""
    full = F.col("head").isNull()
    arcs = placed(cut_lineage(arcs), region_arcs).withColumn("flow", F.when(full, F.col("capacity")).otherwise(F.lit(0)).cast(WIDE))
    arcs = cut_lineage(arcs)
    tails = arcs.where("head IS NULL AND tail IS NOT NULL")
    excess = tails.groupBy("case_id", F.col("tail_region").alias("region"), F.lit("excess").alias("what"), F.col("tail").alias("name")).agg(F.sum("capacity").cast(WIDE).cast("string").alias("value"))
    many = cut_lineage(_halves(arcs).groupBy("case_id").agg(F.count_distinct("region").alias("regions")).where("regions > 1").select("case_id"))

    def alone(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return solved(rows).assign(case_id=key[0], region=1)[["case_id", "region", "what", "name", "value"]]

    one = arcs.join(many, "case_id", "left_anti").select("case_id", "arc", "tail", "tail_t", "head", "head_t", "capacity")
    said = cut_lineage(one.groupBy("case_id").applyInPandas(alone, _NEWS))
    sides = said.where("what = 'side'")
    arcs = _applied(arcs, said)
    if not many.isEmpty():
        excess = excess.join(many, "case_id", "left_semi")
        borders = arcs.where("tail_region <> head_region").select("case_id", F.explode(F.array(F.struct(F.col("head_region").alias("region"), F.col("tail").alias("name")), F.struct(F.col("tail_region").alias("region"), F.col("head").alias("name")))).alias("b"))
        borders = cut_lineage(borders.select("case_id", "b.region", "b.name").distinct())
        while True:
            halves = cut_lineage(_halves(arcs).join(many, "case_id", "left_semi"))
            labels = _distances(halves, borders)
            said = _rounds(halves, excess.unionByName(labels), Region.discharge)
            if said.where("what = 'moved'").isEmpty():
                break
            arcs, excess = _applied(arcs, said), cut_lineage(_excess(said))
        sides = sides.unionByName(_rounds(halves, labels, lambda region: region.labels(every=True)))
        while not excess.isEmpty():
            said = _rounds(halves, excess, Region.take_back)
            arcs, excess = _applied(arcs, said), cut_lineage(_excess(said))
            halves = cut_lineage(_halves(arcs).join(many, "case_id", "left_semi"))
    return arcs, sides.select("case_id", F.col("name").alias("node")).distinct()


def least_cut(cases: DataFrame, flowed: DataFrame, side: DataFrame) -> DataFrame:
    """``case_id, status, cost, residual_path, event_id`` of the ``cases`` from what ``max_flow`` gives: a row for each cut edge, or one with a null event.

    The cut nearest the sources, which every greatest flow gives alike. A residual
    path would be an arc from the sources' side to the other that is not cut.
    """
    near = lambda end: side.select("case_id", F.col("node").alias(end), F.lit(True).alias(f"{end}_near"))
    arcs = flowed.join(near("tail"), ["case_id", "tail"], "left").join(near("head"), ["case_id", "head"], "left")
    crosses: Column = (F.col("tail").isNull() | F.col("tail_near")) & (F.col("head").isNull() | F.col("head_near").isNull())
    crosses = F.coalesce(crosses, F.lit(False))
    arcs = arcs.withColumn("crosses", crosses)
    totals = arcs.groupBy("case_id").agg(F.coalesce(F.sum(F.when(F.col("tail").isNull(), F.col("flow"))), F.lit(0)).cast(WIDE).alias("cost"), F.first("infinite").alias("infinite"), F.count_if(F.col("crosses") & ~F.col("cuttable")).alias("open"))
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    totals = cases.select("case_id").distinct().join(totals, "case_id", "left").select("case_id", zero("cost", WIDE), "infinite", zero("open", "bigint"))
    status = F.when(F.col("cost") == 0, "no_path_exists").when(F.col("cost") >= F.col("infinite"), "no_feasible_cut").otherwise("optimal_cut_found")
    totals = totals.select("case_id", status.alias("status"), "cost", F.when(status == "optimal_cut_found", F.col("open") > 0).otherwise(F.col("cost") > 0).alias("residual_path"))
    cut = arcs.where("crosses AND cuttable").select("case_id", F.lit("optimal_cut_found").alias("status"), "event_id")
    return totals.join(cut, ["case_id", "status"], "left").select("case_id", "status", "cost", "residual_path", "event_id")


def certificate(flowed: DataFrame, cut: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """A row a case that proves flow and cut: arcs whose flow is negative or above capacity, nodes where in and out differ, and cut less flow, all zero.

    No flow is greater than any cut, so equal amounts prove both. ``events`` is that of
    ``counts`` (``case_id, events``), if given: events left out of ``flowed`` carry nothing.
    """
    arcs = flowed.groupBy("case_id").agg(F.count("event_id").alias("events"), F.count_if((F.col("flow") < 0) | (F.col("flow") > F.col("capacity"))).alias("over_capacity"), F.coalesce(F.sum(F.when(F.col("tail").isNull(), F.col("flow"))), F.lit(0)).alias("value"))
    ends = flowed.select("case_id", F.explode(F.array(F.struct(F.col("tail").alias("node"), (-F.col("flow")).alias("f")), F.struct(F.col("head").alias("node"), F.col("flow").alias("f")))).alias("e")).select("case_id", "e.*").where("node IS NOT NULL")
    unequal = ends.groupBy("case_id", "node").agg(F.sum("f").alias("f")).groupBy("case_id").agg(F.count_if(F.col("f") != 0).alias("unbalanced"))
    paid = cut.where("event_id IS NOT NULL").join(flowed.where("event_id IS NOT NULL").select("case_id", "event_id", "capacity"), ["case_id", "event_id"]).groupBy("case_id").agg(F.sum("capacity").alias("paid"))
    told = cut.select("case_id", "status").distinct()
    if counts is not None:
        arcs = counts.join(arcs.drop("events"), "case_id", "left")
    out = told.join(arcs, "case_id").join(unequal, "case_id", "left").join(paid, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    gap = F.when(F.col("status") == "no_feasible_cut", F.lit(0)).otherwise(zero("paid") - zero("value"))
    return out.select("case_id", "status", "events", zero("over_capacity").alias("over_capacity"), zero("unbalanced").alias("unbalanced"), gap.cast(WIDE).alias("gap"))
