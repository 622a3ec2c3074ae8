"""Time-respecting graph traversal by level-wise equi-joins."""

from __future__ import annotations

import tempfile
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.scan import active, as_of


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that driver and executors share, and go on from there.

    Only a local session without such a folder takes a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weirflow-"))
    return df.checkpoint(eager=True)


def components(links: DataFrame, scope: list[str]) -> DataFrame:
    """``scope, node, root`` of undirected ``links`` (``scope, a, b``): the smallest node reachable within the scope.

    Each round a node takes the smallest label around it, and then that label's
    own label; rounds grow with the logarithm of the longest way.
    """
    both = links.select(*scope, "a", "b").unionByName(links.select(*scope, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*scope, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), [*scope, "b"]).groupBy(*scope, F.col("a").alias("node")).agg(F.min("root").alias("least"))
        lower = labels.join(around, [*scope, "node"]).select(*scope, "node", "root", F.least("root", "least").alias("new"))
        lower = cut_lineage(lower)
        jump = lower.select(*scope, F.col("node").alias("new"), F.col("new").alias("jumped"))
        moved = cut_lineage(lower.join(jump, [*scope, "new"]).select(*scope, "node", "root", F.least("new", "jumped").alias("new")))
        if moved.where("root <> new").isEmpty():
            return moved.select(*scope, "node", "root")
        labels = moved.select(*scope, "node", F.col("new").alias("root"))


def ranked(rows: DataFrame, by: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 within ``by``, without bringing a group into one task.

    Rows are sorted over all tasks and counted within each; the counts, one for
    each group and task, give where a task's first row stands.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(n, by, *order).withColumn("__part", F.spark_partition_id())
    placed = cut_lineage(placed)
    counts = placed.groupBy(by, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(by, "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)) - 1
    return placed.withColumn("__inside", inside).join(counts, [by, "__part"]).withColumn(name, F.col("__before") + F.col("__inside")).drop("__part", "__inside", "__before")


def downstream(transfers: DataFrame, start: DataFrame, max_depth: int | None = None, start_time: Any = None) -> DataFrame:
    """Active edges that money can reach from ``start`` (``case_id, account``), with the least number of hops.

    The first hop may be at ``start_time``; every further hop is strictly later
    than the one before. A level keeps one row per account, its earliest
    arrival, so the frontier never outgrows the account table.
    """
    edges = active(transfers).select("case_id", "event_id", "sender", "receiver", "occurred_at")
    first = edges.join(start.select("case_id", F.col("account").alias("sender")).distinct(), ["case_id", "sender"], "left_semi")
    if start_time is not None:
        first = first.where(F.col("occurred_at") >= F.lit(start_time))
    level = cut_lineage(first.withColumn("depth", F.lit(1)))
    seen, depth = level, 1
    while (max_depth is None or depth < max_depth) and not level.isEmpty():
        depth += 1
        arrivals = level.groupBy("case_id", F.col("receiver").alias("sender")).agg(F.min("occurred_at").alias("arrived"))
        reached = edges.join(arrivals, ["case_id", "sender"]).where("occurred_at > arrived").drop("arrived")
        level = cut_lineage(reached.join(seen.select("case_id", "event_id"), ["case_id", "event_id"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(level.select(*seen.columns))  # levels are written, so this reads them and no more
    return seen


def temporal_paths(transfers: DataFrame, pairs: DataFrame, max_depth: int = 10, start_time: Any = None, end_time: Any = None) -> DataFrame:
    """All paths of strictly later hops without a repeated account between ``pairs`` (``case_id, source, target``).

    The first hop is strictly after ``start_time``, all are at or before
    ``end_time``. A path stops at its target. Partial paths are pruned to
    accounts from which the target is reachable in the hops left.
    """
    edges = active(transfers).select("case_id", "event_id", "sender", "receiver", "occurred_at")
    if end_time is not None:
        edges = edges.where(F.col("occurred_at") <= F.lit(end_time))
    pairs = pairs.where("source <> target").select("case_id", "source", "target").distinct()
    first = edges.join(pairs.withColumnRenamed("source", "sender"), ["case_id", "sender"])
    if start_time is not None:
        first = first.where(F.col("occurred_at") > F.lit(start_time))
    heads = _hops_to(edges, pairs, max_depth)
    level = first.select(
        "case_id", F.col("sender").alias("source"), "target", F.col("receiver").alias("at"), "occurred_at",
        F.array("sender", "receiver").alias("visited"), F.array("event_id").alias("events"),
    ).where("at <> source")
    found, depth = None, 1
    while True:
        level = cut_lineage(level)
        done = level.where("at = target").select("case_id", "source", "target", "events", F.col("visited").alias("accounts"))
        found = done if found is None else found.unionByName(done)
        if depth == max_depth or level.isEmpty():
            return found
        left = max_depth - depth
        going = level.where("at <> target").join(heads.where(F.col("hops") <= left).drop("hops"), ["case_id", "target", "at"], "left_semi")
        step = edges.select("case_id", F.col("sender").alias("at"), F.col("receiver").alias("to"), F.col("event_id").alias("e"), F.col("occurred_at").alias("t"))
        level = (
            going.join(step, ["case_id", "at"]).where("t > occurred_at AND NOT array_contains(visited, to)")
            .select("case_id", "source", "target", F.col("to").alias("at"), F.col("t").alias("occurred_at"), F.concat("visited", F.array("to")).alias("visited"), F.concat("events", F.array("e")).alias("events"))
        )
        depth += 1


def _hops_to(edges: DataFrame, pairs: DataFrame, max_depth: int) -> DataFrame:
    """``case_id, target, at, hops``: least hops to each target, time ignored."""
    links = edges.select("case_id", F.col("sender").alias("at"), F.col("receiver").alias("to")).distinct()
    level = cut_lineage(pairs.select("case_id", "target", F.col("target").alias("at"), F.lit(0).alias("hops")).distinct())
    seen = level
    for hops in range(1, max_depth):
        nearer = level.select("case_id", "target", F.col("at").alias("to")).join(links, ["case_id", "to"]).select("case_id", "target", "at").distinct()
        level = cut_lineage(nearer.join(seen, ["case_id", "target", "at"], "left_anti").withColumn("hops", F.lit(hops)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select(*seen.columns))
    return cut_lineage(seen)


#: Accounts of a case or connected part up to which its ancestors are bitsets of one task (50 MB then), and of a group of small parts.
BITSET_ACCOUNTS, PART_ACCOUNTS = 20_000, 4_096
#: Links of a case up to which one task finds its connected parts.
TASK_LINKS = 4_000_000


def upstream(transfers: DataFrame, of: DataFrame, time: Any = None, bitset_accounts: int = BITSET_ACCOUNTS, task_links: int = TASK_LINKS) -> DataFrame:
    """``case_id, account, ancestor``: accounts with a chain of active edges up to ``time`` into ``account``; order of times ignored.

    A case of up to ``bitset_accounts`` accounts is closed by bitsets, and only
    the accounts asked for become rows. A larger case is taken apart into accounts
    that no edge connects; groups of such parts are closed by bitsets, and only a
    part that is still too large goes level by level.
    """
    known = as_of(transfers, time) if time is not None else active(transfers)
    links = cut_lineage(known.select("case_id", F.col("sender").alias("ancestor"), F.col("receiver").alias("via")).where("ancestor <> via").distinct())
    of = of.select("case_id", "account").distinct()
    ends = links.select("case_id", F.explode(F.array("ancestor", "via")).alias("account"))
    sizes = ends.groupBy("case_id").agg(F.count_distinct("account").alias("accounts"), (F.count("*") / 2).alias("links"))
    large = cut_lineage(sizes.where(F.col("accounts") > bitset_accounts).select("case_id", (F.col("links") > task_links).alias("huge")))
    if large.isEmpty():
        return _by_bitsets(links, of)
    whole = _by_bitsets(links.join(large, "case_id", "left_anti"), of.join(large, "case_id", "left_anti"))
    links, of = links.join(large, "case_id"), of.join(large, "case_id")
    plain, asked = links.where("NOT huge").drop("huge"), of.where("NOT huge").drop("huge")
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))
    kind = dict(links.dtypes)["via"]

    def parts(links_: pa.Table, asked_: pa.Table) -> pa.Table:
        return _parts(links_, asked_, bitset_accounts)

    placed = plain.groupBy("case_id").cogroup(asked.groupBy("case_id")).applyInArrow(parts, f"case_id string, part bigint, ancestor {kind}, via {kind}")
    if not large.where("huge").isEmpty():
        placed = placed.unionByName(_parts_by_joins(links.where("huge").drop("huge"), of.where("huge").drop("huge"), bitset_accounts))
    placed = cut_lineage(placed)
    found = whole.unionByName(placed.where("part IS NOT NULL").groupBy("case_id", "part").applyInArrow(_part_ancestors, f"case_id string, account {kind}, ancestor {kind}"))
    rest = placed.where("part IS NULL").drop("part")
    if rest.isEmpty():
        return found
    return found.unionByName(_upstream_by_levels(rest.where("ancestor IS NOT NULL"), rest.where("ancestor IS NULL").select("case_id", F.col("via").alias("account"))))


def _by_bitsets(links: DataFrame, of: DataFrame) -> DataFrame:
    of = of.select(*(F.col(c).alias(c) for c in of.columns))
    kind = dict(links.dtypes)["via"]
    return links.groupBy("case_id").cogroup(of.groupBy("case_id")).applyInArrow(_ancestors, f"case_id string, account {kind}, ancestor {kind}")


def _parts(links: pa.Table, asked: pa.Table, most: int) -> pa.Table:
    """Links and accounts asked for (no ancestor) of one case, with the group of connected parts that they belong to; none for a part of more than ``most`` accounts."""
    kind = links.schema.field("via").type
    schema = pa.schema([("case_id", links.schema.field("case_id").type), ("part", pa.int64()), ("ancestor", kind), ("via", kind)])
    if not links.num_rows or not asked.num_rows:
        return schema.empty_table()
    ends = pa.chunked_array([*links.column("ancestor").chunks, *links.column("via").chunks]).combine_chunks().dictionary_encode()
    code = ends.indices.to_numpy(zero_copy_only=False)
    a, b = code[: links.num_rows], code[links.num_rows :]
    label = np.arange(len(ends.dictionary))
    while not np.array_equal(label[a], label[b]):  # roots hook on to the least root around them
        least = np.minimum(label[a], label[b])
        hooked = label.copy()
        np.minimum.at(hooked, label[a], least)
        np.minimum.at(hooked, label[b], least)
        while not np.array_equal(hooked[hooked], hooked):
            hooked = hooked[hooked]
        label = hooked[label]
    size = np.bincount(label)
    small = np.where(size <= most, size, 0)
    part = (np.cumsum(small) - small) // min(PART_ACCOUNTS, most)
    part = pa.array(part[label], mask=size[label] > most)
    own = pc.index_in(asked.column("account").combine_chunks(), value_set=ends.dictionary)
    known = pc.is_valid(own)
    own, account = own.filter(known), asked.column("account").combine_chunks().filter(known)
    rows = len(a) + len(own)
    case = pa.array([links.column("case_id")[0].as_py()], schema.field("case_id").type).take(pa.array(np.zeros(rows, np.int64)))
    return pa.table([
        case, pa.chunked_array([part.take(pa.array(a)), part.take(own)]), pa.chunked_array([*links.column("ancestor").chunks, pa.nulls(len(own), kind)]), pa.chunked_array([*links.column("via").chunks, account]),
    ], schema=schema)


def _parts_by_joins(links: DataFrame, of: DataFrame, most: int) -> DataFrame:
    """As ``_parts``, for cases with too many links for a task."""
    roots = components(links.select("case_id", F.col("ancestor").alias("a"), F.col("via").alias("b")), ["case_id"])
    sizes = roots.groupBy("case_id", "root").agg(F.count("*").alias("n"))
    before = F.sum(F.when(F.col("n") <= most, F.col("n"))).over(Window.partitionBy("case_id").orderBy("root").rowsBetween(Window.unboundedPreceding, -1))
    part = F.when(F.col("n") <= most, F.floor(F.coalesce(before, F.lit(0)) / min(PART_ACCOUNTS, most)))
    parts = cut_lineage(roots.join(sizes.withColumn("part", part), ["case_id", "root"]).select("case_id", F.col("node").alias("via"), "part"))
    columns = ["case_id", "part", "ancestor", "via"]
    asked = of.select("case_id", F.col("account").alias("via"), F.lit(None).cast(dict(links.dtypes)["via"]).alias("ancestor"))
    return links.join(parts, ["case_id", "via"]).select(columns).unionByName(asked.join(parts, ["case_id", "via"]).select(columns))


def _part_ancestors(rows: pa.Table) -> pa.Table:
    link = pc.is_valid(rows.column("ancestor"))
    asked = rows.filter(pc.invert(link))
    return _ancestors(rows.filter(link), asked.select(["case_id", "via"]).rename_columns(["case_id", "account"]))


def _ancestors(links: pa.Table, asked: pa.Table) -> pa.Table:
    """All ancestors of the accounts asked for, in one case."""
    schema = pa.schema([("case_id", asked.schema.field("case_id").type), ("account", asked.schema.field("account").type), ("ancestor", asked.schema.field("account").type)])
    if not links.num_rows or not asked.num_rows:
        return schema.empty_table()
    ends = pa.chunked_array([*links.column("ancestor").chunks, *links.column("via").chunks]).combine_chunks().dictionary_encode()
    names, code = ends.dictionary, ends.indices.to_numpy(zero_copy_only=False)
    source, via = code[: links.num_rows], code[links.num_rows :]
    order = np.argsort(via, kind="stable")
    source, via = source[order], via[order]
    first = np.flatnonzero(np.append(True, via[1:] != via[:-1]))
    reach = np.zeros((len(names), -(-len(names) // 64)), np.uint64)
    np.bitwise_or.at(reach, (via, source // 64), np.uint64(1) << (source % 64).astype(np.uint64))
    while True:  # a step follows one edge; each account takes what its predecessors have by now
        new = reach.copy()
        for at in range(0, len(via), 1 << 14):
            part = slice(int(np.searchsorted(first, at)), int(np.searchsorted(first, at + (1 << 14))))
            starts = first[part]
            if len(starts):
                end = first[part.stop] if part.stop < len(first) else len(via)
                new[via[starts]] |= np.bitwise_or.reduceat(reach[source[starts[0] : end]], starts - starts[0], axis=0)
        if np.array_equal(new, reach):
            break
        reach = new
    where = pc.index_in(asked.column("account").combine_chunks(), value_set=names).to_numpy(zero_copy_only=False)
    out = []
    for at in np.flatnonzero(~np.isnan(where.astype(float))).tolist():
        own = int(where[at])
        held = np.flatnonzero(np.unpackbits(reach[own].view(np.uint8), bitorder="little"))
        held = held[held != own]
        if len(held):
            out.append((own, held))
    if not out:
        return schema.empty_table()
    account = np.repeat([o for o, _ in out], [len(h) for _, h in out])
    case = pa.array([asked.column("case_id")[0].as_py()], schema.field("case_id").type).take(pa.array(np.zeros(len(account), np.int64)))
    return pa.table([case, names.take(pa.array(account)), names.take(pa.array(np.concatenate([h for _, h in out])))], schema=schema)


def _upstream_by_levels(links: DataFrame, of: DataFrame) -> DataFrame:
    level = cut_lineage(of.select("case_id", "account", F.col("account").alias("ancestor")))
    seen = level
    while not level.isEmpty():
        back = level.withColumnRenamed("ancestor", "via").join(links, ["case_id", "via"]).select("case_id", "account", "ancestor").distinct()
        level = cut_lineage(back.join(seen, ["case_id", "account", "ancestor"], "left_anti"))
        seen = seen.unionByName(level)  # levels are written, so this reads them and no more
    return seen.where("ancestor <> account")
