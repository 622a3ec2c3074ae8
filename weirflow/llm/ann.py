"""Approximate nearest neighbours by inner product over shifted Hilbert curves.

Vectors gain one component that makes all norms equal (queries get zero there),
so the largest inner product is the smallest distance. The few longest rows are
compared with every query, so one long vector does not move the rest. Each
curve projects on a few random orthogonal directions, maps them to quantiles of
a sample of lifted rows and queries, shifts the grid at random and orders rows
by Hilbert key. Rows are range-partitioned by (curve, key) in Spark, get a rank
from partition counts, and form blocks. A row is sent to its own block only, a
query to the blocks that hold the ``window`` rows on either side of its place.
Queries of a block are dealt to groups of bounded size. Blocks score in double
precision, windows of all curves merge, and the best are ranked.

Number of curves and window come from the data: for a bounded sample of queries
the true neighbours are found by one scan, and the cheapest pair is taken that
holds the share ``recall`` of them. Vectors without any structure need windows
as long as the table and then cost as much as comparing all; ``recall=1`` does
that on one curve and is exact.

Equal vectors are one class with their smallest ids: no more than ``k + 1`` of
them can appear in a result. Vectors that are null, empty, zero or hold null or
non-finite components take no part, nor do rows with a null id or of another
length than most (ties: the longer). Fully repeated rows count once. Equal
scores go to the smaller id, whatever part of a block they come from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm._shared import cut, partitions

#: Rows that fix the grid.
FIT_ROWS = 4096
#: Queries whose true neighbours fix the window.
ASKED = 128
#: Rows of a block, and queries of a group in it, at most.
BLOCK = 8192
#: The longest rows, which every query meets.
LONGEST = 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of grid cells (Skilling's transform), as signed 64-bit numbers."""
    x = cells.T.astype(np.int64)
    n, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[n - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def pack(vectors: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Which vectors are usable, and length and bytes of those."""
    there = pc.fill_null(pc.greater(pc.list_value_length(vectors), 0), False).to_numpy(zero_copy_only=False)
    vectors = vectors.filter(pa.array(there))
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(size) - size
    good = np.zeros(len(size), bool)
    if len(size):
        good = np.logical_and.reduceat(np.isfinite(flat), first) & np.logical_or.reduceat(flat != 0, first)
    data = (flat[np.repeat(good, size)] + 0.0).astype(kind)  # no negative zeros: equal vectors have equal bytes
    ends = np.concatenate([[0], np.cumsum(size[good])]) * data.itemsize
    packed = pa.Array.from_buffers(pa.large_binary(), int(good.sum()), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    there[np.flatnonzero(there)] = good
    return there, size[good].astype(np.int32), packed.cast(pa.binary())


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int, kind: str) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        return np.concatenate([np.zeros((0, width)), *(_matrix(c, width, kind) for c in vectors.chunks)])
    if not len(vectors):
        return np.zeros((0, width))
    vectors = vectors.cast(pa.binary())
    offsets = np.frombuffer(vectors.buffers()[1], np.int32)[vectors.offset : vectors.offset + len(vectors) + 1]
    return np.frombuffer(vectors.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(-1, width).astype(np.float64)


def _ordered_sums(products: np.ndarray) -> np.ndarray:
    """Row sums added from first to last, so equal vectors score equally anywhere."""
    return np.cumsum(products, axis=1)[:, -1] if products.shape[1] else np.zeros(len(products))


def best_of(queries: np.ndarray, rows: np.ndarray, order: np.ndarray, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query number, row number and score of each query's ``keep`` best rows; equal scores by ``order``, smaller first.

    Products by matrix are only near: all within their error of the last one
    kept are summed in order, and those sums decide.
    """
    keep = min(keep, len(rows))
    if not keep:
        return
    longest = np.sqrt(np.einsum("ij,ij->i", rows, rows).max())
    step = max(1, min(256, (1 << 21) // len(rows)))
    for s in range(0, len(queries), step):
        some = queries[s : s + step]
        near = some @ rows.T
        last = np.partition(near, len(rows) - keep, axis=1)[:, len(rows) - keep]
        error = 4e-16 * (rows.shape[1] + 2) * longest * np.sqrt(np.einsum("ij,ij->i", some, some))
        by, at = np.nonzero(near >= (last - 2 * error)[:, None])
        value = np.concatenate([_ordered_sums(some[by[c : c + 16384]] * rows[at[c : c + 16384]]) for c in range(0, len(by), 16384)])
        best = np.lexsort((order[at], -value, by))
        by, at, value = by[best], at[best], value[best]
        first = np.flatnonzero(np.append(True, by[1:] != by[:-1]))
        place = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
        kept = place < keep
        yield by[kept] + s, at[kept], value[kept]


def _ranks(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Place of each value in ascending order."""
    out = np.empty(len(values), np.int64)
    out[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
    return out


def choose(need: np.ndarray, rows: int, asked: int, recall: float) -> tuple[int, int]:
    """Number of curves and window of least cost that hold the share ``recall`` of the sampled neighbours.

    ``need``: rows between a query and a true neighbour, by pair and curve.
    """
    if recall >= 1 or not need.size:
        return 1, max(1, rows)
    best = None
    for curves in range(1, need.shape[1] + 1):
        least = np.sort(need[:, :curves].min(axis=1))
        window = max(256, int(least[min(len(least) - 1, int(np.ceil(recall * len(least))) - 1)]) + 1)
        block = block_rows(window)
        visits = min(2 * window / block + 1, rows / block + 1)
        # a row sent to a block costs about a hundred times as much as one comparison
        cost = curves * (100 * (rows * max(1.0, asked * visits * block / max(1, rows) / BLOCK) + asked * visits) + asked * visits * block)
        if best is None or cost < best[0]:
            best = (cost, curves, window)
    return best[1], best[2]


def block_rows(window: int) -> int:
    return min(BLOCK, max(1024, 1 << (window - 1).bit_length()))


def search(
    base: DataFrame,
    is_query: Column,
    k: int = 20,
    recall: float = 0.98,
    curves: int = 12,
    window: int | None = None,
    dims: int = 8,
    bits: int = 7,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query row's ``k`` best found, its own row left out.

    ``curves`` is the largest number of curves. A ``window`` of the caller's own
    is used with all of them; else both follow from ``recall``.
    """
    spark = base.sparkSession
    element = base.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    id_type = base.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, size, data = pack(batch.column("v"), kind)
            rest = batch.select(["id", "q"]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(size), data], ["id", "q", "d", "v"])

    source = base.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.col(vector_col).alias("v")).where("id is not null and v is not null")
    rows = cut(source.mapInArrow(packed, f"id {id_type}, q boolean, d int, v binary"))
    widths = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    width = widths[0].d if widths else 1
    rows = rows.where(F.col("d") == width).drop("d").dropDuplicates(["id", "v"])

    of_vector = Window.partitionBy("v").orderBy("id")
    members = rows.select("id", "v").withColumn("n", F.row_number().over(of_vector)).where(F.col("n") <= k + 1)
    members = cut(members.groupBy("v").agg(F.min("id").alias("class"), F.collect_list("id").alias("ids")))  # k + 1 at most
    classes, ids = members.select("class", "v"), members.select("class", "ids")
    queries = cut(rows.where("q").select("id", "v").join(classes, "v").select(F.col("id").alias("query_id"), "class"))
    asked = queries.select("class").distinct().withColumn("asked", F.lit(True))

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), width, kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.einsum("ij,ij->i", x, x))], [*batch.schema.names, "square"])

    points = classes.join(asked, "class", "left").select("class", "v", F.coalesce("asked", F.lit(False)).alias("asked"))
    points = cut(points.mapInArrow(squares, f"class {id_type}, v binary, asked boolean, square double"))
    total = points.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()

    def bounded(df: DataFrame, n: int, *order: Column) -> pa.Table:
        return df.orderBy(*order).limit(n).select("class", "v", "square").toArrow()

    heavy = bounded(points, LONGEST, F.desc("square"), F.col("class"))
    least = heavy.column("square")[-1].as_py() if heavy.num_rows == LONGEST else 0.0
    fit = _matrix(bounded(points, FIT_ROWS, F.xxhash64("class")).column("v"), width, kind)
    probes = bounded(points.where("asked"), ASKED, F.xxhash64("class", F.lit("probe")))

    def lifted(x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, least - np.einsum("ij,ij->i", x, x)))
        return np.column_stack([x, extra])

    rng = np.random.default_rng(seed)
    used = min(dims, width + 1)
    seen = np.concatenate([lifted(fit, False), lifted(fit, True)])
    frames = []
    for _ in range(curves):
        axes, _ = np.linalg.qr(rng.standard_normal((width + 1, used)))
        marks = np.quantile(seen @ axes, (np.arange(1024) + 0.5) / 1024, axis=0) if len(seen) else np.zeros((1024, used))
        frames.append((axes, marks, rng.uniform(0, 1, used)))
    sent = spark.sparkContext.broadcast(frames)  # curves * dims * (width + 1024) numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["curve", "key", "class", "query"]
        for batch in batches:
            x = _matrix(batch.column("v"), width, kind)
            asked_ = batch.column("asked").to_numpy(zero_copy_only=False)
            for query, mine in ((False, np.arange(len(x))), (True, np.flatnonzero(asked_))):
                if not len(mine):
                    continue
                lift, who = lifted(x[mine], query), batch.column("class").take(pa.array(mine))
                for c, (axes, marks, shift) in enumerate(sent.value):
                    at = lift @ axes
                    part = np.column_stack([np.searchsorted(marks[:, d], at[:, d]) for d in range(used)]) / 1025
                    cells = ((part + shift) / 2 * (1 << bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), c, np.int32)), pa.array(hilbert_keys(cells, bits)), who, pa.array(np.full(len(mine), query))], names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            curve, is_base = batch.column("curve").to_numpy(), ~batch.column("query").to_numpy(zero_copy_only=False)
            n = np.cumsum(is_base)
            index = at + n - is_base  # base rows before this one
            at += int(n[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(curve), batch.column("class"), batch.column("query"), pa.array(np.full(len(n), part, np.int32)), pa.array(index)],
                ["curve", "class", "query", "part", "index"],
            )

    exact = recall >= 1 and window is None
    keys = cut(points.mapInArrow(place, f"curve int, key bigint, class {id_type}, query boolean").where(F.col("curve") < (1 if exact else curves)))
    keys = keys.repartitionByRange(partitions(spark), "curve", "key", "class").sortWithinPartitions("curve", "key", "class", "query")
    ranked = cut(keys.mapInArrow(number, f"curve int, class {id_type}, query boolean, part int, index bigint"))
    # a curve's first rank in each partition: counts of (partition, curve), summed in order
    counts = ranked.groupBy("part", "curve").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("n"), F.min("index").alias("first"))
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut(counts.select("part", "curve", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("base")))
    ranked = ranked.join(F.broadcast(counts), ["part", "curve"]).select("curve", "class", "query", (F.col("base") + F.col("index")).alias("rank"))  # partitions * curves rows

    def against(table: pa.Table, column: str):  # noqa: ANN202
        """A task that compares the queries ``column`` of ``table`` with all rows it is given."""
        held = spark.sparkContext.broadcast(table.select(["class", "v"]))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            other = held.value
            x = _matrix(other.column("v"), width, kind)
            for batch in batches:
                mine = _matrix(batch.column("v"), width, kind)
                q, r, asking, rows_ = (mine, x, batch, other) if column == "batch" else (x, mine, other, batch)
                for by, at, value in best_of(q, r, _ranks(rows_.column("class")), k + 1):
                    yield pa.RecordBatch.from_arrays([_taken(asking, by), _taken(rows_, at), pa.array(value)], ["asker", "class", "score"])

        return scan

    found_type = f"asker {id_type}, class {id_type}, score double"
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "class")
    if window is None:
        need = np.zeros((0, curves), np.int64)
        if not exact and probes.num_rows:
            near = points.select("class", "v").mapInArrow(against(probes, "table"), found_type)
            near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).where("asker <> class")
            near = near.select("asker", "class").toArrow()  # at most ASKED * (k + 1) rows
            heavy_ids = set(heavy.column("class").to_pylist())
            pairs = [(a, c) for a, c in zip(near.column("asker").to_pylist(), near.column("class").to_pylist())]
            wanted = spark.createDataFrame([(x,) for x in {x for p in pairs for x in p}] or [], T.StructType([T.StructField("class", base.schema[id_col].dataType)]))
            at: dict[tuple, int] = {(r["class"], r.query, r.curve): r["rank"] for r in ranked.join(F.broadcast(wanted), "class").collect()}
            need = np.array([[0 if c in heavy_ids else abs(at[a, True, v] - at[c, False, v]) for v in range(curves)] for a, c in pairs], np.int64).reshape(-1, curves)
        curves, window = choose(need, total.n, total.q, recall)
    block = block_rows(window)
    ranked = ranked.where(F.col("curve") < curves)
    last = max(0, (total.n - 1) // block)
    home = F.floor(F.col("rank") / block).cast("int")
    low, high = (F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col("rank") + d) / block))).cast("int") for d in (-window, window))
    visits = ranked.where("query").select("curve", "class", F.explode(F.sequence(low, high)).alias("block"))
    groups = visits.groupBy("curve", "block").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("groups"))
    groups = cut(groups)
    visits = visits.join(groups, ["curve", "block"]).select("curve", "block", F.pmod(F.xxhash64("class"), F.col("groups")).cast("int").alias("group"), "class", F.lit(True).alias("query"))
    hosts = ranked.where("not query").select("curve", home.alias("block"), "class").join(groups, ["curve", "block"])
    hosts = hosts.select("curve", "block", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), "class", F.lit(False).alias("query"))
    dealt = visits.unionByName(hosts).join(points.select("class", "v"), "class")

    def score(table: pa.Table) -> pa.Table:
        query = table.column("query").combine_chunks()
        asking, rows_ = table.filter(query), table.filter(pc.invert(query))
        found = best_of(_matrix(asking.column("v"), width, kind), _matrix(rows_.column("v"), width, kind), _ranks(rows_.column("class")), k + 1)
        parts = [pa.table([_taken(asking, by), _taken(rows_, at), pa.array(value)], ["asker", "class", "score"]) for by, at, value in found]
        empty = pa.table([_taken(asking, np.zeros(0, np.int64)), _taken(rows_, np.zeros(0, np.int64)), pa.array([], pa.float64())], ["asker", "class", "score"])
        return pa.concat_tables([empty, *parts])

    scored = dealt.groupBy("curve", "block", "group").applyInArrow(score, found_type)
    scored = scored.unionByName(points.where("asked").select("class", "v").mapInArrow(against(heavy, "batch"), found_type))
    merged = scored.groupBy("asker", "class").agg(F.max("score").alias("score"))
    merged = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    listed = merged.join(ids, "class").groupBy("asker").agg(F.collect_list(F.struct("score", "ids")).alias("found"))
    pairs = queries.join(listed.withColumnRenamed("asker", "class"), "class")
    pairs = pairs.select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.score").alias("score"), F.explode("f.ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    final = pairs.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return final.select("query_id", "rank", "vec_id", "score")


def _taken(table: pa.Table | pa.RecordBatch, rows: np.ndarray) -> pa.Array:
    column = table.column("class")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.take(pa.array(rows, pa.int64()))
