"""Shards of near-equal bytes from sampled splitters.

Rows are ordered by (hash of the text, id), so equal texts are neighbours and a
very large group of copies can still be cut between two of its ids. A
size-weighted sample of keys gives quantile boundaries; rows fall into ranges
by binary search; ranges that come out overfull get splitters of their own.
Sums per range place every range exactly, and a running sum inside a range
places every row, so shard sizes differ by about one document. A group of
copies smaller than ``group_share`` of a shard is not cut; a larger one is, since
whole it would leave its shard longer than the others by as much.

Null texts have no bytes. Null ids sort first, ids that are no integers by their
hash. Repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm._shared import cut

_LOWEST = -(1 << 63)


def _splitters(sample: list, wanted: int) -> np.ndarray:
    """Up to ``wanted - 1`` keys that cut the sampled weight evenly: (hash, id) rows in order."""
    if not sample:
        return np.zeros((0, 2), np.int64)
    rows = np.array(sorted((r.key, r.tie, r.weight) for r in sample), dtype=object)
    weight = np.cumsum(rows[:, 2].astype(np.float64))
    at = np.searchsorted(weight, weight[-1] * np.arange(1, wanted) / wanted)
    keys = np.unique(rows[at, :2].astype(np.int64), axis=0) if len(at) else np.zeros((0, 2), np.int64)
    # a text that only one splitter falls on is not cut: the boundary goes before all its copies
    _, group, n = np.unique(keys[:, 0], return_inverse=True, return_counts=True)
    keys[n[group] == 1, 1] = _LOWEST
    return keys


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    """``rows`` plus ``range``: the number of splitters at or before (key, tie)."""
    sent = rows.sparkSession.sparkContext.broadcast(splitters)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = sent.value
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            tie = batch.column("tie").to_numpy(zero_copy_only=False)
            low, out = np.searchsorted(cuts[:, 0], key, "left"), np.searchsorted(cuts[:, 0], key, "right")
            tied = np.flatnonzero(low < out)
            for first in np.unique(low[tied]):
                mine = tied[low[tied] == first]
                out[mine] = first + np.searchsorted(cuts[first : out[mine[0]], 1], tie[mine], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int32))], [*batch.schema.names, "range"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(search, f"{fields}, range int")


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 16,
    ranges_per_shard: int = 64,
    sample_per_range: int = 20,
    group_share: float = 0.01,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; sizes of shards are near equal.

    The sample has about ``shards * ranges_per_shard * sample_per_range`` keys at
    any input size, and as many range sums as there are ranges reach the driver.
    """
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")
    tie = F.col(id_col).cast("bigint") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else F.xxhash64(F.when(F.col(id_col).isNotNull(), F.col(id_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("key"),
        F.coalesce(tie, F.lit(_LOWEST)).alias("tie"),
    )
    rows = cut(rows)
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = shards * ranges_per_shard

    def sampled(source: DataFrame, bytes_: int, keys: int) -> list:
        share = F.col("size") * F.lit(keys / max(1, bytes_))
        chance = F.pmod(F.xxhash64("key", "tie", F.lit("splitters")), F.lit(1 << 30)) / F.lit(float(1 << 30))
        weight = F.greatest(F.col("size").cast("double"), F.lit(bytes_ / keys))
        return source.where(chance < share).select("key", "tie", weight.alias("weight")).collect()

    splitters = _splitters(sampled(rows, total, ranges * sample_per_range), ranges)
    target = total / ranges
    while True:
        sums = {r.range: r for r in _ranged(rows, splitters).groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        overfull = [r for r in sums.values() if r.bytes > 2 * target and r.n > 1]
        parts = _ranged(rows, splitters).where(F.col("range").isin([r.range for r in overfull])) if overfull else None
        found = []
        if parts is not None:
            by_range: dict[int, list] = {}
            share = F.col("size") * sample_per_range / F.lit(max(1.0, target))
            chance = F.pmod(F.xxhash64("key", "tie", F.lit("subdivide")), F.lit(1 << 30)) / F.lit(float(1 << 30))
            weight = F.greatest(F.col("size").cast("double"), F.lit(target / sample_per_range))
            for r in parts.where(chance < share).select("range", "key", "tie", weight.alias("weight")).collect():
                by_range.setdefault(r["range"], []).append(r)
            for r in overfull:
                found.append(_splitters(by_range.get(r.range, []), int(-(-r.bytes // max(1.0, target)))))
        more = np.unique(np.concatenate([splitters, *found]), axis=0)
        if len(more) == len(splitters):
            break  # what is overfull now is one row or rows that no key tells apart
        splitters = more
    order = sorted(sums)
    bytes_before = dict(zip(order, np.concatenate([[0], np.cumsum([sums[r].bytes for r in order])]).tolist()))
    rows_before = dict(zip(order, np.concatenate([[0], np.cumsum([sums[r].n for r in order])]).tolist()))
    spark = rows.sparkSession
    bases = spark.createDataFrame([(r, bytes_before[r], rows_before[r]) for r in order], "range int, bytes_before bigint, rows_before bigint")
    within = Window.partitionBy("range").orderBy("key", "tie", "size")
    group = Window.partitionBy("range", "key")
    placed = (
        _ranged(rows, splitters)
        .join(F.broadcast(bases), "range")  # one row per range
        .withColumn("row", F.col("rows_before") + F.row_number().over(within) - 1)
        .withColumn("at", F.col("bytes_before") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("group_bytes", F.sum("size").over(group))
        .withColumn("group_at", F.min("at").over(group))
    )
    small = F.col("group_bytes") <= F.lit(group_share * total / shards)
    start = F.when(small, F.col("group_at")).otherwise(F.col("at"))
    shard = F.least(F.lit(shards - 1), F.floor(start * F.lit(shards) / F.lit(max(1, total)))).cast("int")
    placed = cut(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), "row"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
