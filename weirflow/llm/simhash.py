"""SimHash near-duplicate detection over a byte-position inverted index.

A fingerprint has eight positional bytes. Two fingerprints that differ in at
most ``k`` bits share at least ``8 - k`` of them: the guaranteed minimum, at
least five for ``k`` up to three. A posting list per single byte would pair
rows quadratically, so a posting key is four positions with their bytes, and the
positions are the 14 planes of a three-dimensional binary space: any five
positions hold exactly one of them, so a pair that reaches the minimum meets.

In a list, each pair's shared positional bytes are tallied, pairs below the
minimum are dropped, a pair that meets in several lists is tallied in the first,
and the rest is verified by bit distance; only a spanning forest of the links is
emitted. Lists too long for all pairs go by a fifth shared byte, and those by
flipping up to ``k`` of the bits left, which takes time linear in the list. Keys
that a sample shows to be very frequent are dealt out by the fifth byte before
the shuffle, so no task holds such a list.

Null texts count as empty. A text without words has fingerprint zero. Null ids
are kept and never become a component id unless a group has nothing else.
Extra columns are ignored; repeated rows are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import cut, partitions, without
from weirflow.llm._words import LOWER, chunks
from weirflow.llm.components import Forest, connected_components

BYTES = 8
SEED = 42
_LANES = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)


def _shingle_hashes(text: bytes, n: int) -> list[int]:
    words = text.translate(LOWER).split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(joined, SEED)]
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[n - 1 :])]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``counts`` hashes: bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    blocks = -(-n // 255)  # a lane of eight bits holds a sum of 255 rows
    block_first = np.cumsum(blocks) - blocks
    inner = np.arange(blocks.sum()) - np.repeat(block_first, blocks)
    cuts = np.repeat(first, blocks) + inner * 255
    lanes = np.add.reduceat(_LANES[hashes.view(np.uint8).reshape(-1, BYTES)], cuts, axis=0)
    sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 64).astype(np.int64), block_first, axis=0)
    out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a signed long) of every text; one scan, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                hashes: list[np.ndarray] = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    hashes.append(np.array(_shingle_hashes(text or b"", n), np.uint64))
                counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
                prints = majority(np.concatenate(hashes), counts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(scan, f"doc_id {kind}, fingerprint bigint")


#: Positions of a posting key: any five of the eight hold exactly one of these.
PLANES = [c for c in combinations(range(BYTES), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]
#: Byte orders that put a key's positions highest: the planes, then each plane with a fifth position.
ORDERS = np.array(
    [[*sorted(set(range(BYTES)) - set(c)), *c] for c in PLANES] + [[*sorted(set(range(BYTES)) - {*c, p}), p, *c] for c in PLANES for p in sorted(set(range(BYTES)) - set(c))]
)
#: Bits below the key in each order, and the first plane inside each set of shared positions (a bit each).
LOW_BITS = np.array([32] * len(PLANES) + [24] * (4 * len(PLANES)), np.uint64)
_FIRST = np.array([next((i for i, c in enumerate(PLANES) if all(m >> p & 1 for p in c)), len(PLANES)) for m in range(256)], np.uint8)
#: Lists up to this length are compared pair by pair.
SHORT = 2048
#: One of so many fingerprints is sampled for frequent keys, and a key is frequent with so many of them.
SAMPLED, FREQUENT = 1024, 64


def shared_bytes(difference: np.ndarray) -> np.ndarray:
    """Which of the eight bytes are equal, as a bit each, from the exclusive or of two fingerprints."""
    equal = np.ascontiguousarray(difference).view(np.uint8).reshape(-1, BYTES) == 0
    return np.packbits(equal, axis=1, bitorder="little").ravel()


def _reorder(prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.ascontiguousarray(prints).view(np.uint8).reshape(-1, BYTES)[:, order]).view(np.uint64).ravel()


def _restore(packed: np.ndarray, orders: np.ndarray) -> np.ndarray:
    out = np.empty((len(packed), BYTES), np.uint8)
    np.put_along_axis(out, ORDERS[orders], np.ascontiguousarray(packed).view(np.uint8).reshape(-1, BYTES), axis=1)
    return out.view(np.uint64).ravel()


def _flip(low: np.ndarray, k: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at most ``k`` bits apart by flipping bits: the list's length times a constant; ``low`` ascends."""
    for mask in (sum(1 << b for b in c) for r in range(1, k + 1) for c in combinations(range(bits), r)):
        want = low ^ np.uint64(mask)
        i = np.flatnonzero(want > low)
        j = np.minimum(np.searchsorted(low, want[i]), len(low) - 1)
        hit = low[j] == want[i]
        yield i[hit], j[hit]


def _pairs(prints: np.ndarray, k: int, lists: np.ndarray | None, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (i, j): tally shared bytes, keep those with the minimum, here first, within the distance."""
    difference = prints[i] ^ prints[j]
    shared = shared_bytes(difference)
    good = np.bitwise_count(shared) >= BYTES - k
    if lists is not None:
        good &= _FIRST[shared] == lists[i]
    good &= np.bitwise_count(difference) <= k
    return i[good], j[good]


def _link_list(prints: np.ndarray, k: int, forest: Forest, at: np.ndarray) -> None:
    """Link the members (rows ``at``) of one list."""
    m = len(at)
    if m <= SHORT:
        for shift in range(1, m):
            forest.link(*_pairs(prints, k, None, at[:-shift], at[shift:]))
        return
    difference = prints[at] ^ prints[at[0]]
    raw = np.ascontiguousarray(difference).view(np.uint8).reshape(-1, BYTES)
    free = np.flatnonzero(raw.any(axis=0))
    if len(free) > BYTES - 5:  # links share one of these bytes too
        for p in free:
            order = np.argsort(raw[:, p], kind="stable")
            for part in np.split(at[order], np.flatnonzero(np.diff(raw[order, p])) + 1):
                _link_list(prints, k, forest, part)
        return
    low = _reorder(difference, np.array([*free, *(p for p in range(BYTES) if p not in free)]))
    sort = np.argsort(low)
    for i, j in _flip(low[sort], k, 8 * len(free)):
        forest.link(at[sort[i]], at[sort[j]])


def link_lists(orders: np.ndarray, packed: np.ndarray, k: int, across: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (member, root) that span the links of all lists; rows are sorted and distinct."""
    key = packed >> LOW_BITS[orders]
    prints = _restore(packed, orders)
    new = np.ones(len(packed), bool)
    new[1:] = (orders[1:] != orders[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(packed)))
    forest, run = Forest(len(packed)), np.repeat(np.arange(len(first)), size)
    few = np.repeat(size <= across, size)
    lists = np.where(orders < len(PLANES), orders, 0)
    for shift in range(1, min(across, int(size.max(initial=1)))):
        i = np.flatnonzero((run[shift:] == run[:-shift]) & few[shift:])
        plain = orders[i] < len(PLANES)
        for some, which in ((i[plain], lists), (i[~plain], None)):
            forest.link(*_pairs(prints, k, which, some, some + shift))
    for r in np.flatnonzero(size > across):
        _link_list(prints, k, forest, np.arange(first[r], first[r] + size[r]))
    member = np.flatnonzero(forest.label != np.arange(len(packed)))
    return member, forest.label[member]


def fingerprint_links(prints: DataFrame, k: int = 3, col: str = "fingerprint", sampled: int = SAMPLED, frequent: int = FREQUENT) -> DataFrame:
    """``u, v``: links that connect all distinct fingerprints at most ``k`` bits apart."""
    if not 0 <= k <= 3:
        raise ValueError("k must lie between 0 and 3")

    def post(orders: range) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                for o in orders:
                    packed = _reorder(own, ORDERS[o])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(packed), o, np.int8)), pa.array(packed.view(np.int64)), pa.array((packed >> LOW_BITS[o]).view(np.int64))], ["list", "packed", "key"])

        return run

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(orders: np.ndarray, packed: np.ndarray) -> pa.RecordBatch:
            rows = link_lists(orders, packed, k)
            return pa.RecordBatch.from_arrays([pa.array(_restore(packed[r], orders[r]).view(np.int64)) for r in rows], ["u", "v"])

        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
            last = held[-1]
            if sum(len(h[0]) for h in held) < 1 << 16 or (held[0][0][0], held[0][2][0]) == (last[0][-1], last[2][-1]):
                continue  # few rows, or one long list so far
            orders, packed, key = (np.concatenate(x) for x in zip(*held))
            whole = int(np.flatnonzero((orders != orders[-1]) | (key != key[-1]))[-1]) + 1
            yield links(orders[:whole], packed[:whole])
            held = [(orders[whole:], packed[whole:], key[whole:])]
        if held:
            yield links(*(np.concatenate(x) for x in list(zip(*held))[:2]))

    spark = prints.sparkSession
    posting, plain, fine = "list tinyint, packed bigint, key bigint", range(len(PLANES)), range(len(PLANES), len(ORDERS))
    own = prints.select(col).where(F.col(col).isNotNull())
    posted = own.mapInArrow(post(plain), posting)
    some = own.where(F.pmod(F.xxhash64(col, F.lit("sample")), F.lit(sampled)) == 0).mapInArrow(post(plain), posting)
    hot = cut(some.groupBy("list", "key").count().where(F.col("count") >= frequent).select("list", "key"))
    if not hot.isEmpty():
        wanted = hot.select(F.col("list").cast("int").alias("__plane"), F.col("key").alias("__key"))
        plane = F.floor((F.col("list") - len(PLANES)) / 4).cast("int")
        split = own.mapInArrow(post(fine), posting)
        split = split.join(wanted, (plane == F.col("__plane")) & (F.shiftrightunsigned("packed", 32) == F.col("__key")), "left_semi")
        posted = posted.join(hot, ["list", "key"], "left_anti").unionByName(split)
    dealt = posted.select("list", "packed", "key").repartition(partitions(spark), "list", "key").sortWithinPartitions("list", "packed")
    return dealt.mapInArrow(verify, "u bigint, v bigint").distinct()


def near_duplicates(docs: DataFrame, n: int = 3, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (long), ``component_id``.

    ``component_id`` is the smallest id among documents reachable over links of
    at most ``k`` differing bits. Equal fingerprints are folded to one row
    before the index, so copies are never paired with each other.
    """
    prints = cut(fingerprints(docs, n, id_col, text_col))
    distinct = cut(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(distinct, k))
    placed = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    placed = cut(placed.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(ids, "root").select("fingerprint", "component_id")
    return prints.join(of, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_first(docs: DataFrame, n: int = 3, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest id.

    Rows with a null id are kept. Rows that repeat the smallest id are all kept.
    """
    groups = near_duplicates(docs, n, k, id_col, text_col)
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"), id_col)
