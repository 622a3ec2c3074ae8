"""Connected components of a link table: in one task while it is small, by alternating star contraction beyond."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import cut

#: Links up to this number (16 bytes each, if ids are longs) are joined in one task; rounds of shuffles over so few rows are mostly tasks without any.
FEW = 1_000_000


class Forest:
    """Labels of some rows; hooks roots together in bulk."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            np.minimum.at(self.label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while True:
                jumped = self.label[self.label]
                if np.array_equal(jumped, self.label):
                    break
                self.label = jumped


def _joined(links: DataFrame) -> DataFrame:
    """``node, root`` of few links (``lo, hi``)."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            ends = pa.chunked_array([b.column(c) for c in ("lo", "hi") for b in held])
            nodes = ends.unique()
            nodes = nodes.take(pc.sort_indices(nodes))
            lo, hi = np.split(pc.index_in(ends, nodes).to_numpy(), 2)
            forest = Forest(len(nodes))
            forest.link(lo, hi)
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(forest.label))], ["node", "root"])

    kind = dict(links.dtypes)["lo"]
    return links.coalesce(1).mapInArrow(join, f"node {kind}, root {kind}")


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``u``, ``v``); root is the smallest node reachable.

    Up to ``few`` links are one task. Beyond, large-star and small-star steps (Kiveris et al., 2014) alternate until the
    table of links is a set of stars. Each step is an aggregate with map-side
    combine and an equi-join; each round is written to the shared folder, so
    lineage stays short. Rounds grow with the logarithm of the node count.
    """
    now = cut(edges.select(F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi")).where("lo < hi"))
    if now.count() <= few:
        return _joined(now)
    now = cut(now.distinct())
    before = _fingerprint(now)
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("lo < hi")
            .distinct()
        )
        now = cut(small)
        after = _fingerprint(now)
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct()
    )
