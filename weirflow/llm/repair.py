"""Conversation repair by weighted finite-state composition.

Three machines: the input acceptor reads a conversation's rows in order; the
edit transducer keeps, reroles, deletes or inserts at a cost; the grammar
acceptor allows the role initials ``(s?(ua)+)?``. They are composed lazily: a
composed state is a place in the conversation and a grammar state, and its arcs
are made when it is reached (``consuming``, ``INSERTS``). All arcs go forward in
the conversation but for insertions, which move the grammar alone, so states are
ordered topologically from the last row back, and the best way from each to the
end is found in one pass. Weights are pairs of a cost and the string of edit
initials, compared lexicographically: the cheapest edits, of equally cheap ones
the least string. A state and an edit's initial fix the next state, so strings
never have to be compared beyond the first difference at one place.

Rows that are equal in all columns are one row with a number of copies. Rows
are range-partitioned by conversation and turn, so a long conversation spreads
over tasks. For a conversation that crosses partitions, each task gives the 4 x 4
costs from grammar state to grammar state of its part; the driver, with two such
tables for each partition at most, works out what every part costs from its end
on, and in a second look which state each part begins in. Then all parts are
solved at once.

Order within a conversation: turn (nulls first), role, digest of the text. Null
roles and texts count as one space. A row's first fault counts: blank (nothing
but spaces), duplicate (role and text were there before), truncated (the last
character that is not a space does not end a sentence). Rows with a null
conversation id are one conversation. Texts are never gathered: they are joined
to the kept rows at the end. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import cut, partitions

SPACES = r"\x20\x09-\x0D"
ROLES = {"u": "user", "a": "assistant"}
#: The grammar acceptor of (s?(ua)+)?: state and role initial to the next state.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
FINAL = (0, 3)
STATES = range(4)
NEVER = 1 << 60


@dataclass(frozen=True)
class Costs:
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1

    def __post_init__(self) -> None:
        if min(self.rerole, self.delete, self.insert) < 1 or self.truncated < 0:
            raise ValueError("edits must cost at least 1")


@dataclass(frozen=True)
class Row:
    """What the machines see of a row."""

    initial: str
    gone: bool  # blank or duplicate: it must be deleted
    truncated: bool


def consuming(row: Row, state: int, costs: Costs) -> Iterator[tuple[str, int, int]]:
    """Arcs of the composition that read ``row``: edit initial, cost, next grammar state."""
    yield "D", costs.delete, state
    if row.gone:
        return
    extra = costs.truncated if row.truncated else 0
    if (state, row.initial) in GRAMMAR:
        yield "K", extra, GRAMMAR[state, row.initial]
    for initial in ROLES:
        if initial != row.initial and (state, initial) in GRAMMAR:
            yield "R", costs.rerole + extra, GRAMMAR[state, initial]


#: Arcs that insert a row: each grammar state allows one role.
INSERTS = {s: next(GRAMMAR[s, i] for i in ROLES if (s, i) in GRAMMAR) for s in STATES}


def _with_inserts(best: dict[int, tuple[int, str, int]], cost: int) -> tuple[tuple[int, str, int], ...]:
    """Each state's best way, with up to two insertions first (more only go round in a circle)."""
    out = []
    for s in STATES:
        ways, labels, at = [best[s]], "", s
        for _ in range(2):
            labels, at = labels + "I", INSERTS[at]
            ways.append((len(labels) * cost + best[at][0], labels + best[at][1], best[at][2]))
        out.append(min(ways))
    return tuple(out)


@lru_cache(maxsize=None)
def step(row: Row, after: tuple[int, ...], costs: Costs) -> tuple[tuple[int, str, int], ...]:
    """For each state before ``row``: least cost to the end, edit initials here, state after the row.

    ``after`` has the costs from each state after the row; few different ones
    occur, since only their differences are passed on.
    """
    best = {s: min((cost + after[to], label, to) for label, cost, to in consuming(row, s, costs)) for s in STATES}
    return _with_inserts(best, costs.insert)


@lru_cache(maxsize=None)
def ending(costs: Costs) -> tuple[tuple[int, str, int], ...]:
    """The same behind the last row."""
    return _with_inserts({s: (0 if s in FINAL else NEVER, "", s) for s in STATES}, costs.insert)


def solve(rows: list[Row], after: tuple[int, ...] | None, costs: Costs) -> tuple[tuple[int, ...], list]:
    """Costs from each state before ``rows``, and the ways taken at each row.

    ``after``: costs behind the rows, or None at the conversation's end.
    """
    ways = [ending(costs)] if after is None else []
    now = tuple(w[0] for w in ways[0]) if after is None else after
    total = 0
    for row in reversed(rows):
        least = min(now)
        total += least
        way = step(row, tuple(min(c - least, NEVER) for c in now), costs)
        ways.append(way)
        now = tuple(w[0] for w in way)
    return tuple(min(c + total, NEVER) for c in now), ways[::-1]


def follow(ways: list, state: int) -> tuple[list[tuple[str, int]], int]:
    """Edit initials at each row and the state before it, from ``state`` on; and the last state."""
    out = []
    for way in ways:
        out.append((way[state][1], state))
        state = way[state][2]
    return out, state


def marked(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, digest`` with nulls of role and text as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    return rows.withColumn("digest", F.unhex(F.md5(F.concat(F.length("role"), F.lit(":"), "role", "text"))))


def faulty(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, copies, fault`` of distinct rows (``fault`` is that of the first copy); no texts."""
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    truncated = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    distinct = rows.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("copies"), F.first(F.when(blank, "blank").when(truncated, "truncated")).alias("fault"))
    distinct = cut(distinct)
    again = distinct.groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min("turn").alias("first"), F.count("turn").alias("turns")).where("n > 1")
    again = again.select(F.col("conv_id").alias("__conv"), F.col("digest").alias("__digest"), F.when(F.col("turns") == F.col("n"), F.col("first")).alias("__first"))
    met = distinct.join(again, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest")), "left")
    later = F.col("__digest").isNotNull() & ~F.col("turn").eqNullSafe(F.col("__first"))
    fault = F.when(F.col("fault") == "blank", "blank").when(later, "duplicate").otherwise(F.col("fault"))
    return met.select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))


@dataclass
class Part:
    """A conversation's rows in one task, without further copies: those are all deleted, which no way can avoid."""

    number: int
    conv_id: object
    rows: list[Row]
    sources: list[tuple]  # turn, digest, copies, fault

    def ends(self, first: bool, last: bool, costs: Costs) -> dict:
        tables = [list(solve(self.rows, tuple(0 if s == e else NEVER for s in STATES), costs)[0]) for e in STATES]
        return {"part": self.number, "conv_id": self.conv_id, "first": first, "last": last, "costs": tables, "tail": list(solve(self.rows, None, costs)[0]), "initial": self.rows[-1].initial}


@lru_cache(maxsize=None)
def _row(initial: str, fault: str | None) -> Row:
    return Row(initial, fault in ("blank", "duplicate"), fault == "truncated")


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Schema | None, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return (None, iter(())) if first is None else (first.schema, chain([first], batches))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    names = ("part", "conv_id", "initial", "fault", "turn", "digest", "copies")
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names)))
    for (number, conv), some in groupby(rows, lambda r: r[:2]):
        part = Part(number, conv, [], [])
        for _, _, initial, fault, turn, digest, copies in some:
            part.rows.append(_row(initial, fault))
            part.sources.append((turn, digest, copies, fault))
        yield part


def _first_and_last(batches: Iterator[pa.RecordBatch]) -> list[Part]:
    """The first and the last conversation of a task (one, if they are the same); the others are not kept."""
    kept: list[Part] = []
    for found in _parts(batches):
        kept[1:] = [found] if kept else []
        kept = kept or [found]
    return kept


@dataclass
class Joins:
    """For each partition: costs behind its last conversation, state and role initial before its first; where these go on."""

    after: dict[int, tuple[int, ...]]
    state: dict[int, int]
    initial: dict[int, str]


def _chains(ends: list) -> list[list]:
    """Runs of parts of one conversation over several partitions; ``ends`` are sorted by partition and place."""
    runs: list[list] = []
    for e in ends:
        last = runs[-1][-1] if runs else None
        if last is not None and e.part > last.part and e.conv_id == last.conv_id and last.last and e.first:
            runs[-1].append(e)
        else:
            runs.append([e])
    return [r for r in runs if len(r) > 1]


def _join_parts(ordered: DataFrame, costs: Costs) -> Joins:
    """What tasks must know of each other; the driver sees at most two rows for each partition."""
    kind = ordered.schema["conv_id"].dataType.simpleString()
    joins = Joins({}, {}, {})

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, batches = _typed(batches)
        found = _first_and_last(batches)
        if found:
            n = pa.list_(pa.int64())
            fields = {"part": pa.int32(), "conv_id": schema.field("conv_id").type, "first": pa.bool_(), "last": pa.bool_(), "costs": pa.list_(n), "tail": n, "initial": pa.string()}
            yield pa.RecordBatch.from_pylist([p.ends(i == 0, i == len(found) - 1, costs) for i, p in enumerate(found)], schema=pa.schema(fields))

    ends = ordered.mapInArrow(tables, f"part int, conv_id {kind}, first boolean, last boolean, costs array<array<bigint>>, tail array<bigint>, initial string").collect()
    chains = _chains(sorted(ends, key=lambda e: (e.part, not e.first)))
    for parts in chains:
        after = tuple(parts[-1].tail)
        for before, e in zip(reversed(parts[:-1]), reversed(parts[1:])):
            joins.after[before.part] = after
            joins.initial[e.part] = before.initial
            after = tuple(min(NEVER, min(before.costs[to][s] + after[to] for to in STATES)) for s in STATES)
    if not chains:
        return joins
    known = ordered.sparkSession.sparkContext.broadcast(joins.after)

    def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _first_and_last(batches)
        if found and found[-1].number in known.value:
            ways = solve(found[-1].rows, known.value[found[-1].number], costs)[1]
            row = {"part": found[-1].number, "to": [follow(ways, s)[1] for s in STATES]}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema({"part": pa.int32(), "to": pa.list_(pa.int32())}))

    to = {r.part: r.to for r in ordered.mapInArrow(states, "part int, to array<int>").collect()}
    for parts in chains:
        state = 0
        for before, e in zip(parts[:-1], parts[1:]):
            state = to[before.part][state]
            joins.state[e.part] = state
    return joins


_LEGAL = {"su", "ua", "au"}


def edits(faults: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """``conv_id, place, edit, times, cost, fault, illegal, role, turn, digest``, ascending by ``place``.

    One row an edit (``K``, ``R``, ``D``, ``I``); further copies of a row are one
    deletion ``times`` over. ``role`` is the new one of ``R`` and ``I``. ``illegal``
    counts how often a row's role may not follow the one before it. Inserted
    rows have no digest.
    """
    keys = ["conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    ordered = faults.repartitionByRange(partitions(faults.sparkSession), *keys).sortWithinPartitions(*keys)
    initial = F.substring("role", 1, 1)
    ordered = cut(ordered.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "digest", "copies", "fault", initial.alias("initial")))
    joins = ordered.sparkSession.sparkContext.broadcast(_join_parts(ordered, costs))
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}

    def solve_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, batches = _typed(batches)
        long, text = pa.int64(), pa.string()
        fields = {"conv_id": None, "place": long, "edit": text, "times": long, "cost": long, "fault": text, "illegal": long, "role": text, "turn": None, "digest": None}
        known, out, place = joins.value, [], 0
        parts, first = _parts(batches), True
        now = next(parts, None)
        while now is not None:
            part, now = now, next(parts, None)
            after = known.after.get(part.number) if now is None else None
            state, before = (known.state.get(part.number, 0), known.initial.get(part.number)) if first else (0, None)
            path, first = follow(solve(part.rows, after, costs)[1], state)[0], False
            for (labels, state), row, (turn, digest, copies, fault) in zip(path, [*part.rows, None], [*part.sources, (None,) * 4]):
                for label in labels:
                    state = INSERTS[state] if label in "IR" else state
                    role = ROLES["u" if state == 2 else "a"] if label in "IR" else None
                    new, place = {"conv_id": part.conv_id, "place": (part.number << 33) + place, "edit": label, "times": 1, "cost": costs.insert, "illegal": 0, "role": role}, place + 1
                    if label != "I":
                        cost = costs.delete if label == "D" else (costs.rerole if label == "R" else 0) + (costs.truncated if row.truncated else 0)
                        new |= {"turn": turn, "digest": digest, "fault": fault, "cost": cost, "illegal": int(before is not None and before + row.initial not in _LEGAL)}
                        before = row.initial
                    out.append(new)
                if copies and copies > 1:
                    n, fault = copies - 1, "blank" if fault == "blank" else "duplicate"
                    new, place = {"conv_id": part.conv_id, "place": (part.number << 33) + place, "edit": "D", "times": n, "cost": n * costs.delete, "fault": fault, "illegal": n, "turn": turn, "digest": digest}, place + 1
                    out.append(new)
            if len(out) >= 1000 or now is None:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema({n: t or source.field(n).type for n, t in fields.items()}))
                out = []

    return cut(ordered.mapInArrow(solve_all, f"conv_id {types['conv_id']}, place bigint, edit string, times bigint, cost bigint, fault string, illegal bigint, role string, turn {types['turn']}, digest binary"))


def repaired(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` of the repaired conversations: kept, reroled and inserted rows.

    ``rows`` as given by ``marked``, ``done`` by ``edits``. A conversation's order is that of ``place``.
    """
    kept = done.where("edit IN ('K', 'R')").select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), F.col("digest").alias("__digest"), "place", F.col("role").alias("__role"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & F.col("turn").eqNullSafe(F.col("__turn")) & (F.col("digest") == F.col("__digest"))
    found = rows.join(kept, same).groupBy("conv_id", "turn", "digest").agg(F.first("place").alias("place"), F.first(F.coalesce("__role", "role")).alias("role"), F.first("text").alias("text"))
    new = done.where("edit = 'I'").select("conv_id", "place", "role", F.lit("").alias("text"))
    return found.select("conv_id", "place", "role", "text").unionByName(new)


def report(rows: DataFrame, done: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation that has rows.

    The audit is the string of edit initials, as long as the conversation.
    """
    number = lambda name: F.sum(F.when(F.col("fault") == name, F.col("times")).otherwise(0)).alias(name)
    steps = F.array_sort(F.collect_list(F.struct("place", "edit", "times")))
    audit = F.array_join(F.transform(steps, lambda s: F.repeat(s["edit"], s["times"].cast("int"))), "")
    counted = done.groupBy("conv_id").agg(number("blank"), number("duplicate"), number("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    turns = rows.select("conv_id", "turn").distinct().groupBy(F.col("conv_id").alias("__conv")).agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = counted.join(turns, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    return out.select("conv_id", F.coalesce("gaps", F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def damaged(turns: DataFrame, key: Column) -> DataFrame:
    """Rows with one of 20 kinds of damage by ``key``: 0 drops, 1 empties, 2 removes sentence ends, 3 repeats, 4 makes it the user's."""
    kind = key % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    changed = turns.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("__times"))
    return changed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).drop("__times", "__copy")
