"""Near copies by HyperMinHash sketches, banded and verified on whole shingle sets.

A text is the set of its distinct shingles, hashed to 64 bits. Texts with the
same set are one node, named by the smallest id. A node's sketch has ``BUCKETS``
registers: the leading bits of a hash pick the bucket, the least hash of a
bucket is kept as its number of leading zeros (6 bits) and the ``MANTISSA`` bits
after the leading one. A bucket without a hash copies the register of the first
full one in an order of its own, the same for all nodes.

Bands of ``ROWS`` registers are list keys, so a pair of similarity 0.8 shares no
list with probability (1 - 0.8**4)**32, under 0.0000001. A pair's similarity is
estimated from its equal registers, less those expected to be equal by chance
for sets of these sizes; pairs whose estimate is six deviations below the
threshold are dropped and the rest is verified on the whole sets.

A group of m copies would make m * m pairs. What is asked for are groups, so:

1. In each list of a quarter of the bands two leaders are found by an aggregate,
   with different labels (a node's label is its group so far). Each node keeps the
   leader of another label with whom it shares most lists. These pairs, as many
   as nodes at most, are estimated, verified and joined to groups. Done ``ROUNDS``
   times, each with other bands.
2. Lists of all bands whose members are still in different groups are looked at
   pair by pair in tasks, a pair in the list of the first band that it shares and in no
   other. A list longer than ``LONG`` is cut into blocks of half as many rows, and each
   two blocks are a task: every pair is still looked at, once, by tasks of bounded size.
   Rows are sent with their registers first; rows with a partner of another
   group that could reach the threshold come again with their texts, are
   verified inside the task, and links that join groups leave it.

Words are lower-cased (A-Z only). Fewer words than a shingle: the whole sequence
is one shingle. Null texts and texts without words have an empty set, which is
linked with nothing unless ``link_empty``, when all of them are one group. Rows
with a null id take no part and have a null component. Repeated rows are kept; an
id whose rows have different texts is one document that is linked by either.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import SENT_IDS, cut, partitions, without
from weirflow.llm._words import chunks, gram_hashes, mix, split, word_hashes
from weirflow.llm.components import connected_components

BUCKET_BITS, MANTISSA, ROWS, SEED = 7, 10, 4, 42
BUCKETS = 1 << BUCKET_BITS
BANDS = BUCKETS // ROWS
ROUNDS, LONG = 2, 2048
#: Bands of a round that looks for leaders.
LED = BANDS // 4
#: For each bucket, the order in which an empty one looks for a full one.
_ORDER = np.stack([np.random.default_rng([SEED, i]).permutation(BUCKETS) for i in range(BUCKETS)]).astype(np.int16)
_SALT = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LEVELS = np.exp2(-np.arange(0, 41, dtype=float))


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after another, and where each text's begin and the last ends."""
    words = split(texts, lower=True)
    hashes, per = word_hashes(words), words.per_doc()
    first = np.cumsum(per) - per
    grams, at = gram_hashes(hashes, words.doc, n)
    doc = words.doc[at]
    for d in np.flatnonzero((per > 0) & (per < n)).tolist():
        short = gram_hashes(hashes[first[d] : first[d] + per[d]], np.zeros(per[d], np.int8), int(per[d]))[0]
        grams, doc = np.append(grams, short), np.append(doc, d)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def _bit_length(x: np.ndarray) -> np.ndarray:
    for shift in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(shift))
    return np.bitwise_count(x).astype(np.uint64)


def sketches(items: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``BUCKETS`` registers of each set (rows of uint16); zeros for an empty set."""
    count = len(bounds) - 1
    out, full = np.zeros((count, BUCKETS), np.uint16), np.zeros((count, BUCKETS), bool)
    doc = np.repeat(np.arange(count), np.diff(bounds))
    bucket = (items >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    new = np.ones(len(items), bool)  # sets ascend, so a bucket's first is its least
    new[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    doc, bucket, rest = doc[new], bucket[new], items[new] << np.uint64(BUCKET_BITS)
    zeros = np.minimum(np.uint64(64) - _bit_length(rest), np.uint64(62))
    mantissa = (rest << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    out[doc, bucket] = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    full[doc, bucket] = True
    d, b = np.nonzero(~full & (np.diff(bounds) > 0)[:, None])
    for step in range(BUCKETS):
        if not len(d):
            break
        source = _ORDER[b, step]
        hit = full[d, source]
        out[d[hit], b[hit]] = out[d[hit], source[hit]]
        d, b = d[~hit], b[~hit]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A key for each band of each row."""
    return mix(np.ascontiguousarray(registers).view(np.uint64) ^ _SALT[None, :])


def _levels(n: np.ndarray) -> np.ndarray:
    """For sets of ``n`` members: probability that a register has each number of leading zeros."""
    inside = np.maximum(1.0, np.asarray(n, float) / BUCKETS)[:, None]
    above = (1 - _LEVELS) ** inside  # the least of a bucket is above that bound
    return above[:, 1:] - above[:, :-1]


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Probability that registers of two sets without a common member are equal."""
    return (_levels(n) * _levels(m)).sum(axis=1) / (1 << MANTISSA)


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal registers, corrected for collisions."""
    c = chance(n, m)
    return (equal / BUCKETS - c) / (1 - c)


def lowest(threshold: float) -> float:
    """Least estimate of a pair that is verified: six deviations below the threshold."""
    return threshold - 6 * (threshold * (1 - threshold) / BUCKETS) ** 0.5


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes(), SEED)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def prints(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, digest, registers`` of every text; one scan. An empty set has null registers."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                items, bounds = shingle_sets(part.column("text"), n)
                rows, size = sketches(items, bounds), np.diff(bounds)
                digests = [_digest(items[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
                registers = pa.array([r.tobytes() if s else None for r, s in zip(rows, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(digests, pa.binary()), registers], ["doc_id", "n_shingles", "digest", "registers"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _source(docs, id_col, text_col).mapInArrow(scan, f"doc_id {kind}, n_shingles bigint, digest binary, registers binary")


def _rows_of(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _posted(nodes: DataFrame, bands: range = range(BANDS)) -> DataFrame:
    """``key, node, label``: a row for each of the ``bands`` of each node."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = band_keys(_rows_of(part.column("registers"), np.uint16, BUCKETS)).view(np.int64)
                for b in bands:
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, b])), part.column("node"), part.column("label")], ["key", "node", "label"])

    kind = dict(nodes.dtypes)["node"]
    return nodes.select("node", "label", "registers").mapInArrow(post, f"key bigint, node {kind}, label {kind}")


def _led(posts: DataFrame) -> DataFrame:
    """``v, u``: each node's most frequent leader of another label, over its lists (``key, node, label``)."""
    leaders = posts.groupBy("key").agg(F.min("label").alias("a"), F.min_by("node", "label").alias("a_node"), F.max("label").alias("b"), F.max_by("node", "label").alias("b_node")).where("a <> b")
    other = F.when(F.col("label") == F.col("a"), F.col("b_node")).otherwise(F.col("a_node"))
    met = posts.join(leaders, "key").select(F.col("node").alias("v"), other.alias("u"))
    return met.groupBy("v", "u").agg(F.count("*").alias("n")).groupBy("v").agg(F.max_by("u", "n").alias("u"))


def _promising(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` (``u, v``) whose estimate does not rule them out."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_rows_of(batch.column(c), np.uint16, BUCKETS) for c in ("a", "b"))
                n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
                good = estimate(np.count_nonzero(a == b, axis=1), n, m) >= lowest(threshold)
                yield batch.select(["u", "v"]).filter(pa.array(good))

    kind = dict(nodes.dtypes)["node"]
    of = lambda node, size, registers: nodes.select(F.col("node").alias(node), F.col("n_shingles").alias(size), F.col("registers").alias(registers))
    both = pairs.join(of("u", "n", "a"), "u").join(of("v", "m", "b"), "v")
    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(check, f"u {kind}, v {kind}")


def _texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, small: bool) -> DataFrame:
    """The columns of ``wanted`` (with ``node``) and the node's ``text``; texts stay where they are if ``wanted`` is ``small``."""
    source = _source(docs, id_col, text_col)
    return source.join(F.broadcast(wanted) if small else wanted, F.col("doc_id") == F.col("node")).drop("doc_id")


def _verified(docs: DataFrame, links: DataFrame, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """The ``links`` (``u, v``) whose shingle sets have the similarity; a ``v`` has one ``u``, so its text is sent once."""
    links = cut(links)
    small = links.count() <= SENT_IDS
    led = _texts(docs, links.select("u", F.col("v").alias("node")), id_col, text_col, small).select("u", F.col("node").alias("v"), F.col("text").alias("b"))
    leaders = _texts(docs, links.select(F.col("u").alias("node")).distinct(), id_col, text_col, small).select(F.col("node").alias("u"), F.col("text").alias("a"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "b"):
                mine, ends = shingle_sets(part.column("b"), n)
                leader, at = np.unique(np.array(part.column("u").to_pylist()), return_inverse=True)
                spot = np.zeros(len(leader), np.int64)
                spot[at] = np.arange(len(at))
                theirs, their_ends = shingle_sets(part.column("a").take(pa.array(spot)), n)
                good = np.zeros(part.num_rows, bool)
                for i, k in enumerate(at.tolist()):
                    x, y = mine[ends[i] : ends[i + 1]], theirs[their_ends[k] : their_ends[k + 1]]
                    good[i] = similar(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)
                yield part.select(["u", "v"]).filter(pa.array(good))

    kind = dict(links.dtypes)["u"]
    # repeated ids with unequal texts give a pair several rows; any that reaches the threshold counts
    return cut(led.join(leaders, "u").select("u", "v", "a", "b").mapInArrow(check, f"u {kind}, v {kind}").distinct())


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` members with ``both`` in common reach the threshold, without rounding below a millionth."""
    return both * 1_000_000 >= round(threshold * 1_000_000) * (n + m - both)


def _lists(rows: DataFrame, links: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``links`` finds in the rows of each ``key`` (two at least), one key at a time; a key has a bounded number of rows."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each(rows_: pa.Table) -> Iterator[pa.RecordBatch]:
            key = rows_.column("key").to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(first, len(key)))
            for r in np.flatnonzero(size > 1):
                yield from links(rows_.slice(int(first[r]), int(size[r])).combine_chunks())

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column("key")[0] == batch.column("key")[-1]:
                continue  # one list so far
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1
            yield from each(table.slice(0, whole))
            held = table.slice(whole).to_batches()
        if held:
            yield from each(pa.Table.from_batches(held))

    return rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(find, schema)


class _Rows:
    """The rows of one task of a list: registers, sizes of their sets, groups, and which pairs the task looks at."""

    def __init__(self, rows: pa.Table, sizes: np.ndarray | None = None) -> None:
        self.registers = _rows_of(rows.column("registers"), np.uint16, BUCKETS)
        self.sizes = rows.column("n_shingles").to_numpy() if sizes is None else sizes
        self.group = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        self.outside = np.flatnonzero(self.group != np.bincount(self.group).argmax())
        self.side = rows.column("side").to_numpy()
        keys = band_keys(self.registers)
        #: Keys of the bands before the list's own: a pair that shares one of them meets in that list.
        self.earlier = keys[:, : int((keys == rows.column("list").to_numpy().view(np.uint64)[0]).any(axis=0).argmax())]
        size, self._kind = np.unique(self.sizes, return_inverse=True)
        levels = _levels(size)
        self._chance = levels @ levels.T / (1 << MANTISSA)

    def candidates(self, i: int, group: np.ndarray, threshold: float) -> np.ndarray:
        """Rows of another ``group`` that row ``i`` could be linked with and meets here, most similar first."""
        least = lowest(threshold)
        equal = np.add.reduce((self.registers == self.registers[i]).view(np.uint8), axis=1, dtype=np.uint8)
        # chance only lowers an estimate, and a similarity is no greater than the lesser size over the greater one
        j = np.flatnonzero((equal >= least * BUCKETS) & (group != group[i]))
        j = j[(self.side[j] == 0) | (self.side[j] != self.side[i])]
        low, high = np.minimum(self.sizes[j], self.sizes[i]), np.maximum(self.sizes[j], self.sizes[i])
        j = j[similar(low, low, high, threshold)]
        j = j[~(self.earlier[j] == self.earlier[i]).any(axis=1)]
        c = self._chance[self._kind[i], self._kind[j]]
        value = (equal[j] / BUCKETS - c) / (1 - c)
        order = np.argsort(-value, kind="stable")
        return j[order[value[order] >= least]]


def list_links(rows: _Rows, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Verified links that join the groups of one list; every pair of different groups is looked at or made needless by another link."""
    group, links = rows.group.copy(), []
    # numbers in place of hashes, so that one row's set is a mask and its common part with others is a sum of looked-up bits
    names, number = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(rows.sizes)
    numbers = [number[e - n : e] for e, n in zip(ends.tolist(), rows.sizes.tolist())]
    mask = np.zeros(len(names), bool)
    for i in rows.outside.tolist():
        j = rows.candidates(i, group, threshold)
        if not len(j) or not len(numbers[i]):
            continue
        mask[numbers[i]] = True
        while len(j):
            some, j = j[:64], j[64:]
            some = some[rows.sizes[some] > 0]
            if len(some):
                size = rows.sizes[some]
                both = np.add.reduceat(mask[np.concatenate([numbers[x] for x in some.tolist()])], np.cumsum(size) - size, dtype=np.int64)
                for x in some[similar(both, rows.sizes[i], size, threshold)].tolist():
                    if group[x] != group[i]:
                        links.append((i, x))
                        group[group == group[x]] = group[i]
            j = j[group[j] != group[i]]
        mask[numbers[i]] = False
    return links


def _dealt(posts: DataFrame, long: int) -> DataFrame:
    """``key, list, node, label, side`` of the rows of lists that hold different labels: a ``key`` is a task's share of a ``list``.

    A list of over ``long`` rows is cut into blocks of about half of that, and each
    two blocks are a share, in which rows of ``side`` 1 meet those of 2; within a block (0) all meet.
    """
    keys = posts.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.count("*").alias("rows")).where("a <> b")
    rows = posts.join(keys.select("key", "rows"), "key").withColumn("list", F.col("key"))
    rows = cut(rows.select("key", "list", "node", "label", "rows"))
    columns = ("key", "list", "node", "label", "side")
    done = rows.where(F.col("rows") <= long).withColumn("side", F.lit(0)).select(*columns)
    over = rows.where(F.col("rows") > long)
    if over.isEmpty():
        return done
    blocks = F.ceil(F.col("rows") / max(1, long // 2)).cast("int")
    over = over.withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("node"), blocks).cast("int")})
    over = over.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    share = F.xxhash64("list", F.least("own", "other"), F.greatest("own", "other"))
    return done.unionByName(over.withColumns({"key": share, "side": side}).select(*columns))


def _joined(docs: DataFrame, nodes: DataFrame, posts: DataFrame, n: int, threshold: float, long: int, id_col: str, text_col: str) -> DataFrame:
    """``u, v``: verified links between nodes of different labels that share a list."""
    kind = dict(nodes.dtypes)["node"]
    rows = cut(_dealt(posts, long))

    def possible(rows_: pa.Table) -> Iterator[pa.RecordBatch]:
        here = _Rows(rows_)
        wanted = np.zeros(rows_.num_rows, bool)
        for i in here.outside.tolist():
            j = here.candidates(i, here.group, threshold)
            wanted[j] = True
            wanted[i] |= len(j) > 0
        kept = rows_.select(["key", "list", "node", "label", "side"]).filter(pa.array(wanted))
        if kept.num_rows:
            yield from kept.to_batches()

    sketch = nodes.select("node", "n_shingles", "registers")
    members = rows.join(sketch, "node").select("key", "list", "node", "label", "side", "n_shingles", "registers")
    members = cut(_lists(members, possible, f"key bigint, list bigint, node {kind}, label {kind}, side int"))
    wanted = cut(members.select("node").distinct())
    texts = _texts(docs, wanted, id_col, text_col, wanted.count() <= SENT_IDS).dropDuplicates(["node"])
    full = members.join(sketch, "node").join(texts, "node")

    def links(rows_: pa.Table) -> Iterator[pa.RecordBatch]:
        sets_: list[np.ndarray] = []
        for part in chunks(rows_.to_batches()[0]):
            items, bounds = shingle_sets(part.column("text"), n)
            sets_ += [items[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
        found = list_links(_Rows(rows_, np.fromiter(map(len, sets_), np.int64, len(sets_))), sets_, threshold)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        node = rows_.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([node.take(pa.array(np.ascontiguousarray(pairs[:, c]))) for c in range(2)], ["u", "v"])

    return cut(_lists(full.select("key", "list", "node", "label", "side", "n_shingles", "registers", "text"), links, f"u {kind}, v {kind}"))


def near_duplicates(
    docs: DataFrame, n: int = 4, threshold: float = 0.8, rounds: int = ROUNDS, long: int = LONG, link_empty: bool = False, id_col: str = "doc_id", text_col: str = "text", pairs: DataFrame | None = None,
) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest id among documents reachable over links of
    at least that Jaccard similarity of their ``n``-word shingle sets. ``pairs``
    (``u, v``, one ``u`` for each ``v``) are verified first; the lists then look for
    links between the groups that those make.
    """
    all_ = cut(prints(docs, n, id_col, text_col))
    known = all_.where("doc_id IS NOT NULL")
    nodes = cut(known.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")))
    full = nodes.where("n_shingles > 0").select("node", "n_shingles", "registers")
    roots = None

    def joined(new: DataFrame) -> DataFrame:
        """Groups that ``new`` links make of those so far."""
        return cut(connected_components(new if roots is None else new.unionByName(roots.toDF("u", "v"))))

    if pairs is not None:
        of = lambda end: full.select(F.col("node").alias(end))
        known = pairs.join(of("u"), "u", "left_semi").join(of("v"), "v", "left_semi")
        roots = joined(_verified(docs, _promising(known, full, threshold), n, threshold, id_col, text_col))
    for step in range(rounds + 1):
        labelled = full.withColumn("label", F.col("node")) if roots is None else full.join(roots, "node", "left").withColumn("label", F.coalesce("root", "node"))
        if step < rounds:
            at = step * LED % BANDS
            new = _verified(docs, _promising(_led(_posted(labelled, range(at, at + LED))), full, threshold), n, threshold, id_col, text_col)
        else:
            new = _joined(docs, full, _posted(labelled), n, threshold, long, id_col, text_col)
        if roots is not None and new.isEmpty():
            continue
        roots = joined(new)
    placed = nodes.join(roots, "node", "left").select("digest", "node", F.coalesce("root", "node").alias("component_id"))
    own = F.col("n_shingles") == 0
    return all_.join(placed, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNull(), None).when(own & F.lit(not link_empty), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 4, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """``docs`` with one document of each group: that with the smallest id. Rows with a null id stay."""
    groups = near_duplicates(docs, n, threshold, id_col=id_col, text_col=text_col, **options)
    return without(docs, groups.where("component_id <> doc_id").select("doc_id"), id_col)
