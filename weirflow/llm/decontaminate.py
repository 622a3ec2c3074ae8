"""Benchmark decontamination by SimHash windows of each item's size.

A scan finds the shingles of any item in each text. An item is looked for where
the text holds enough of its shingles for the similarity asked for, in windows
of the item's size that do: neither leaves out a match. Those windows get
fingerprints. Item fingerprints are indexed in blocks of 16 bits: fingerprints
at most ``radius`` bits apart have a block at most ``radius // 4`` bits apart,
so the multi-index finds all within the radius. Its tables have a fixed size;
items share their columns. Windows within the radius are verified by the exact
weighted Jaccard similarity of their shingles (weights are multiplicities).

At a weighted similarity of 0.8 a bit differs with probability 0.15, about 10 of
64 with deviation 2.9; the default radius of 26 is over five deviations beyond
that. Items of fewer than ``few`` shingles, whose fingerprints vary more, are
verified at every distance.

Items reach the tasks in slices of bounded size, one scan each; ``slice_bytes``
of item text are some 50 000 items.

Words are lower-cased (A-Z). Fewer words than a shingle: the whole sequence is
one shingle. A document shorter than an item is compared as one window. Null
or empty texts and items match nothing; null ids are kept; repeated rows give
repeated results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm._shared import without
from weirflow.llm._words import Words, chunks, gram_hashes, split, word_hashes

BLOCKS, BLOCK_BITS = 4, 16
#: Columns of a block table; item number modulo this is an item's column.
COLUMNS = 512
_FILTER = 1 << 22


@dataclass
class Grams:
    """Shingles of one width, sorted, and the items that hold each (``first[g] : first[g + 1]`` of the lists)."""

    hashes: np.ndarray
    first: np.ndarray
    items: np.ndarray
    counts: np.ndarray


@dataclass
class Index:
    """One slice of items: texts, fingerprints, block tables, and shingles by width."""

    ids: list
    texts: list[str]
    size: np.ndarray
    shingles: np.ndarray
    prints: np.ndarray
    tables: list[np.ndarray]
    grams: dict[int, Grams]


def _shingles(words: list[bytes], n: int) -> Counter:
    n = min(n, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _prints(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def build_index(items: list[tuple], n: int, radius: int) -> Index:
    ids, texts, size, shingles, prints = [], [], [], [], []
    rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    tables = [np.zeros((1 << BLOCK_BITS, COLUMNS // 64), np.uint64) for _ in range(BLOCKS)]
    near = np.flatnonzero(np.bitwise_count(np.arange(1 << BLOCK_BITS, dtype=np.uint64)) <= radius // BLOCKS)
    for item_id, text in items:
        words = split(pa.array([text or ""]), lower=True)
        count = len(words.start)
        if not count:
            continue
        hashes, _ = gram_hashes(word_hashes(words), words.doc, min(n, count))
        rows.setdefault(min(n, count), []).append((hashes, np.full(len(hashes), len(ids), np.int32)))
        mark = _prints(_bits(hashes).sum(axis=0, dtype=np.int64)[None], np.array([len(hashes)]))[0]
        for b, table in enumerate(tables):
            block = int(mark >> np.uint64(BLOCK_BITS * b)) & ((1 << BLOCK_BITS) - 1)
            table[near ^ block, len(ids) % COLUMNS // 64] |= np.uint64(1 << len(ids) % 64)
        ids.append(item_id)
        texts.append(text)
        size.append(count)
        shingles.append(len(hashes))
        prints.append(mark)
    grams = {}
    for width, parts in rows.items():
        hashes, owner = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        new = np.flatnonzero(np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])))
        counts = np.diff(np.append(new, len(hashes)))
        hashes, owner = hashes[new], owner[new]
        first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        grams[width] = Grams(hashes[first], np.append(first, len(hashes)), owner, counts)
    return Index(ids, texts, np.array(size, np.int64), np.array(shingles, np.int64), np.array(prints, np.uint64), tables, grams)


def _word_list(words: Words, a: int = 0, b: int | None = None) -> list[bytes]:
    return [words.data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b])]


def _hits(hashes: np.ndarray, doc: np.ndarray, grams: Grams, width: int, filter_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words at which a shingle of some item starts, and which shingle."""
    found, at = gram_hashes(hashes, doc, width)
    maybe = np.flatnonzero(filter_[found & np.uint64(_FILTER - 1)])
    where = np.minimum(np.searchsorted(grams.hashes, found[maybe]), len(grams.hashes) - 1)
    hit = grams.hashes[where] == found[maybe]
    return at[maybe[hit]], where[hit]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum(min(c, b[x]) for x, c in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _least_shared(span: int, item: np.ndarray | int, threshold: float) -> np.ndarray | int:
    """Shingles that a window of ``span`` must share with an item of ``item`` to reach the threshold."""
    return np.ceil(threshold * (span + item) / (1 + threshold) - 1e-9).astype(np.int64)


def _wanted(gram: np.ndarray, grams: Grams, index: Index, words: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Items of which a text with these shingles (and so many words) may hold enough, with their shingles found and the counts of those."""
    held, times = np.unique(gram, return_counts=True)
    n = grams.first[held + 1] - grams.first[held]
    at = np.repeat(grams.first[held], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    items, back = np.unique(grams.items[at], return_inverse=True)
    shared = np.bincount(back, np.minimum(grams.counts[at], np.repeat(times, n)))
    width = index.size[items] - index.shingles[items] + 1
    span = np.minimum(index.size[items], words)
    enough = (span >= width) & (shared >= _least_shared(span - width + 1, index.shingles[items], threshold))
    order = np.argsort(back, kind="stable")
    cuts = np.searchsorted(back[order], np.arange(len(items) + 1))
    own, counts = np.repeat(held, n)[order], grams.counts[at][order]
    for i in np.flatnonzero(enough).tolist():
        yield int(items[i]), own[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]


def _window_prints(grams: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Fingerprints of the windows of ``count`` shingles that begin at ``starts`` (ascending)."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        to = int(np.searchsorted(starts, starts[k] + 4096, "right"))
        part = starts[k:to]
        base, end = int(part[0]), int(part[-1]) + count
        sums = np.zeros((end - base + 1, 64), np.int32)
        np.cumsum(_bits(np.ascontiguousarray(grams[base:end])), axis=0, out=sums[1:], dtype=np.int32)
        out[k:to] = _prints(sums[part - base + count] - sums[part - base], np.full(len(part), count))
        k = to
    return out


def _overlaps(places: np.ndarray, gram: np.ndarray, own: np.ndarray, counts: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """Shingles, with multiplicity, that each window shares with an item that holds ``own`` so many times."""
    out = np.zeros(len(starts), np.int64)
    order = np.argsort(gram, kind="stable")
    gram, places = gram[order], places[order]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    for a, b in zip(first, np.append(first[1:], len(gram))):
        inside = np.searchsorted(places[a:b], starts + count) - np.searchsorted(places[a:b], starts)
        out += np.minimum(inside, counts[np.searchsorted(own, gram[a])])
    return out


def _search(text: tuple, index: Index, n: int, radius: int, few: int, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window of each item that one text holds.

    ``text``: word hashes, a function from a range to its words, and by width the places and numbers of item shingles.
    """
    hashes, words_of, hits = text
    m = len(hashes)
    for width, (places, gram) in hits.items():
        grams = index.grams[width]
        windows: dict[int, dict[int, tuple]] = {}  # by item size
        for j, own, counts in _wanted(gram, grams, index, m, threshold):
            span = min(int(index.size[j]), m)
            count = span - width + 1
            held = np.isin(gram, own)
            at, what = places[held], gram[held]
            start = np.arange(max(0, int(at[0]) - count + 1), min(m - span, int(at[-1])) + 1)
            start = start[np.searchsorted(at, start + count) - np.searchsorted(at, start) >= _least_shared(count, int(index.shingles[j]), threshold)]
            if len(start):
                windows.setdefault(span, {})[j] = (start, at, what, own, counts)
        for span, items in windows.items():
            count = span - width + 1
            starts = np.unique(np.concatenate([w[0] for w in items.values()]))
            prints = _window_prints(gram_hashes(hashes, np.zeros(m, np.int8), width)[0], starts, count)
            for j, (start, at, what, own, counts) in items.items():
                marks = prints[np.searchsorted(starts, start)]
                listed = np.zeros(len(start), bool)
                for b, table in enumerate(index.tables):
                    block = (marks >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)
                    listed |= (table[block, j % COLUMNS // 64] >> np.uint64(j % 64)) & np.uint64(1) == 1
                near = listed & (np.bitwise_count(marks ^ index.prints[j]) <= radius)
                start = start if index.shingles[j] < few else start[near]
                shared = _overlaps(at, what, own, counts, start, count)
                value = shared / (count + int(index.shingles[j]) - shared)
                good = np.flatnonzero(value >= threshold - 1e-12)
                if not len(good):
                    continue
                best = int(start[good[np.lexsort((start[good], -value[good]))[0]]])
                bag = _shingles(_word_list(split(pa.array([index.texts[j]]), lower=True)), n)
                exact = similarity(_shingles(words_of(best, best + span), n), bag)
                if abs(exact - value.max()) > 1e-9:  # two words with one hash
                    exact, best = max((similarity(_shingles(words_of(s, s + span), n), bag), -s) for s in start.tolist())
                    best = -best
                if exact >= threshold:
                    yield j, exact, best, span


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 5,
    threshold: float = 0.8,
    radius: int = 26,
    few: int = 16,
    slice_items: int = 1 << 16,
    slice_bytes: int = 16 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_words`` of the best window of every matching pair.

    At most ``slice_items`` items or ``slice_bytes`` of their text (one item, if
    longer) are sent to the tasks at once.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    item_kind = benchmark.schema[item_col].dataType.simpleString()
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    slices = max(1, -(-size.n // slice_items), -(-size.bytes // slice_bytes))
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, start_word bigint, n_words bigint"
    item_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(item_kind)

    def one(sent) -> DataFrame:  # noqa: ANN001
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = sent.value
            filters = {}
            for width, grams in index.grams.items():
                filters[width] = np.zeros(_FILTER, bool)
                filters[width][grams.hashes & np.uint64(_FILTER - 1)] = True
            for batch in batches:
                for part in chunks(batch):
                    words = split(part.column("text"), lower=True)
                    hashes, per = word_hashes(words), words.per_doc()
                    first = np.cumsum(per) - per
                    hits = {w: _hits(hashes, words.doc, g, w, filters[w]) for w, g in index.grams.items()}
                    rows = []
                    for d in np.unique(np.concatenate([np.zeros(0, np.int64), *(words.doc[at] for at, _ in hits.values())])).tolist():
                        a, b = int(first[d]), int(first[d] + per[d])
                        cuts = {w: np.searchsorted(at, [a, b]) for w, (at, _) in hits.items()}
                        own = {w: (hits[w][0][x:y] - a, hits[w][1][x:y]) for w, (x, y) in cuts.items() if x < y}
                        text = hashes[a:b], lambda s, e, a=a: _word_list(words, a + s, a + e), own
                        rows += [(d, *found) for found in _search(text, index, n, radius, few, threshold)]
                    rows.sort()
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())),
                            pa.array([index.ids[r[1]] for r in rows], item_type),
                            pa.array([r[2] for r in rows], pa.float64()),
                            pa.array([r[3] for r in rows], pa.int64()),
                            pa.array([r[4] for r in rows], pa.int64()),
                        ],
                        ["doc_id", "item_id", "similarity", "start_word", "n_words"],
                    )

        return source.mapInArrow(scan, schema)

    out = None
    for s in range(slices):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == s) if slices > 1 else items
        rows = [(r.item_id, r.text) for r in mine.collect()]
        found = one(spark.sparkContext.broadcast(build_index(rows, n, radius)))
        out = found if out is None else out.unionByName(found)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:  # noqa: ANN003
    """``docs`` without the documents that hold a benchmark item; rows with a null id are kept."""
    return without(docs, contaminated(docs, benchmark, id_col=id_col, **options).select("doc_id"), id_col)
