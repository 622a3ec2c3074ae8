"""Removal of repeated word windows with a count-min prefilter.

A window is ``n`` consecutive words of one text. Every window has an anchor: the
smallest hash among its word runs of ``gram`` words. Equal windows have equal
anchors at different places, so the number of places an anchor occurs at is at
least the count of any window it stands for, and a count-min sketch of anchor
places overestimates window counts while holding about a seventh of the
entries. The sketch is one sparse row whose width follows the text: about 64
cells for each expected anchor, so its selectivity is alike at every size. Tasks
sketch their own partition, and partition sketches merge as a sum by cell, dealt
over the cluster. Only cells of two or more go back to the tasks, as a bitmap
with two positions for each, which follows their number up to ``max_bits``. The
second pass groups exactly (by 128-bit hashes of the word sequence) the windows
whose estimate is two or more; a window that occurs twice is never missed.

Null texts have no words and stay null. Rows with a null id are kept whole and
count for nothing. Rows of one id are one document: none of them is earlier
than another, and what is found in one is cut from each. Texts shorter than a
window are unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.llm._shared import cut, partitions
from weirflow.llm._words import chunks, gram_hashes, mix, split, word_hashes

BLOCK_BITS = 22
#: Windows held back in a task before they are folded and emitted.
HELD = 1 << 20
_SALTS = np.array([0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _sliding(x: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The best of each ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        x = better(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return better(x[: len(x) - rest], x[rest:]) if rest else x


def _anchors(hashes: np.ndarray, doc: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word run, least of each window (over text borders too), and which windows lie in one text."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams, _ = gram_hashes(hashes, np.zeros(len(hashes), np.int8), gram)
    return grams, _sliding(grams, n - gram + 1, np.minimum), doc[: len(doc) - n + 1] == doc[n - 1 :]


def sketch_bits(text_bytes: int) -> int:
    """Cells of the sketch, as a power of two: 64 for each expected anchor (one in about 45 bytes)."""
    return min(62, max(BLOCK_BITS, int(text_bytes * 64 // 45).bit_length()))


def bitmap_bits(cells: int, max_bits: int) -> int:
    """Bits of the bitmap, as a power of two: 16 for each repeated cell."""
    return min(max_bits, max(BLOCK_BITS, (16 * cells).bit_length()))


def _places(cells: np.ndarray, bits: int, which: int) -> np.ndarray:
    return mix(cells ^ _SALTS[which]) >> np.uint64(64 - bits)


def repeated_cells(docs: DataFrame, n: int, gram: int, bits: int) -> DataFrame:
    """``cell``: the cells of the merged sketch that count two or more."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(found: list[np.ndarray]) -> pa.RecordBatch:
            cells = np.sort(np.concatenate(found) >> np.uint64(64 - bits))
            twice = np.ones(len(cells), bool)  # two of a cell say all that more would
            twice[2:] = cells[2:] != cells[:-2]
            return pa.RecordBatch.from_arrays([pa.array(cells[twice].view(np.int64))], ["cell"])

        found: list[np.ndarray] = []
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"))
                grams, least, inside = _anchors(word_hashes(words), words.doc, n, gram)
                if not inside.any():
                    continue
                # a run is an anchor if some window that holds it has no smaller one
                width = n - gram + 1
                padded = np.zeros(len(least) + 2 * (width - 1), np.uint64)
                padded[width - 1 : width - 1 + len(least)] = np.where(inside, least, 0)
                found.append(grams[_sliding(padded, width, np.maximum) == grams])
                if sum(map(len, found)) >= HELD:
                    yield emit(found)
                    found = []
        if found:
            yield emit(found)

    return docs.mapInArrow(sketch, "cell bigint").groupBy("cell").agg(F.count("*").alias("n")).where("n >= 2").select("cell")


def cell_bitmap(cells: DataFrame, bits: int) -> bytes:
    """``cells`` as a bitmap of ``2**bits`` bits, put together block by block."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells_ = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.concatenate([_places(cells_, bits, which) for which in range(2)])
            low = (at & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(BLOCK_BITS)).astype(np.int32)), pa.array(low)], ["block", "low"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(block: int, seen: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(seen, bitorder="little").tobytes()])], ["block", "bits"])

        now, seen = -1, np.zeros(1 << BLOCK_BITS, bool)
        for batch in batches:
            blocks, low = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for block in np.unique(blocks).tolist():  # ascending, as the rows are
                if block != now:
                    if now >= 0:
                        yield done(now, seen)
                    now, seen = block, np.zeros(1 << BLOCK_BITS, bool)
                seen[low[blocks == block]] = True
        if now >= 0:
            yield done(now, seen)

    out = bytearray(1 << (bits - 3))
    size = 1 << (BLOCK_BITS - 3)
    placed = cells.mapInArrow(place, "block int, low int").repartition(partitions(cells.sparkSession), "block").sortWithinPartitions("block")
    for row in placed.mapInArrow(merge, "block int, bits binary").toLocalIterator():
        out[row.block * size : (row.block + 1) * size] = row.bits
    return bytes(out)


def _fold(w0: np.ndarray, w1: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (hash, doc, start), and which rows of that order come after the first of their hash."""
    order = np.lexsort((start, doc, w1, w0))
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (w0[a] != w0[b]) | (w1[a] != w1[b])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return order, (doc[order] != doc[head]) | (start[order] != start[head])


def _runs(doc: np.ndarray, start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows merged to word ranges: doc, first word, number of words."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + n)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    return doc[at], start[at], start[last] - start[at] + n if len(at) else start[at]


_OUT = "w0 bigint, w1 bigint, doc bigint, start int, run int"


def _batch(w0: np.ndarray, w1: np.ndarray, doc: np.ndarray, start: np.ndarray, run: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(w0.view(np.int64)), pa.array(w1.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(run.astype(np.int32))],
        ["w0", "w1", "doc", "start", "run"],
    )


def repeated_ranges(docs: DataFrame, n: int = 20, gram: int = 8, max_bits: int = 29) -> DataFrame:
    """``doc, start, run``: word ranges of ``docs`` (``doc`` bigint, ``text``) that windows seen earlier cover."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits(total)
    cells = cut(repeated_cells(docs, n, gram, bits))
    wide = bitmap_bits(cells.count(), max_bits)
    seen = spark.sparkContext.broadcast(cell_bitmap(cells, wide))  # at most 2**max_bits / 8 bytes

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(seen.value, np.uint8)

        def twice(anchor: np.ndarray) -> np.ndarray:
            out = np.ones(len(anchor), bool)
            for which in range(2):
                at = _places(anchor >> np.uint64(64 - bits), wide, which)
                out &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            return out

        def emit(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            w0, w1, doc, start = (np.concatenate(x) for x in zip(*held))
            order, later = _fold(w0, w1, doc, start)
            first = order[~later]
            yield _batch(w0[first], w1[first], doc[first], start[first], np.zeros(len(first)))
            again = order[later]
            if len(again):  # these are settled here and only need dealing out evenly
                d, s, r = _runs(doc[again], start[again], n)
                spread = mix(d.view(np.uint64) + s.astype(np.uint64))
                yield _batch(spread, spread, d, s, r)

        held: list[tuple] = []
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"))
                h0 = word_hashes(words)
                _, least, inside = _anchors(h0, words.doc, n, gram)
                at = np.flatnonzero(inside)
                if len(at):
                    at = at[twice(least[at])]
                if not len(at):
                    continue
                zero = np.zeros(len(h0), np.int8)
                w0 = gram_hashes(h0, zero, n)[0][at]
                w1 = gram_hashes(word_hashes(words, 1), zero, n, 1)[0][at]
                per = words.per_doc()
                first_word = np.cumsum(per) - per
                ids = part.column("doc").to_numpy(zero_copy_only=False)
                held.append((w0, w1, ids[words.doc[at]], at - first_word[words.doc[at]]))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield from emit(held)
                    held = []
        if held:
            yield from emit(held)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None  # first row of the window that the last batch ended in
        for batch in batches:
            w0, w1, doc, start, run = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(w0):
                continue
            new = np.ones(len(w0), bool)
            new[1:] = (w0[1:] != w0[:-1]) | (w1[1:] != w1[:-1])
            goes_on = head is not None and head[:2] == (w0[0], w1[0])
            new[0] = not goes_on
            at = np.maximum.accumulate(np.where(new, np.arange(len(w0)), -1))
            head_doc, head_start = doc[at], start[at]
            if goes_on:
                head_doc[at < 0], head_start[at < 0] = head[2], head[3]
            head = (w0[-1], w1[-1], head_doc[-1], head_start[-1])
            windows_, ranges = (run == 0) & ((doc != head_doc) | (start != head_start)), run > 0
            d, s, r = _runs(doc[windows_], start[windows_].astype(np.int64), n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([d, doc[ranges]])), pa.array(np.concatenate([s, start[ranges]]).astype(np.int32)), pa.array(np.concatenate([r, run[ranges]]).astype(np.int32))],
                ["doc", "start", "run"],
            )

    found = docs.mapInArrow(windows, _OUT).repartition(partitions(spark), "w0").sortWithinPartitions("w0", "w1", "doc", "start")
    return found.mapInArrow(settle, "doc bigint, start int, run int")


def dedup_substrings(docs: DataFrame, n: int = 20, gram: int = 8, max_bits: int = 29, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words that repeated windows cover, plus ``n_words`` and ``n_removed``.

    A word goes if a window of ``n`` words over it has an equal that starts
    earlier (smaller id, or the same document and an earlier word). What stays
    of a changed text is its kept stretches, joined by one space; other texts
    are unchanged. Columns of those two names are replaced. ``max_bits`` bounds the bitmap of
    repeated cells (29: 64 MB, full at 33 million of them); beyond that more
    windows pass the prefilter and results are the same.
    """
    docs = docs.drop("n_words", "n_removed")
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        source = docs.withColumn("__doc", F.col(id_col).cast("bigint"))
    else:  # numbers in the order of the ids
        ids = docs.select(F.col(id_col).alias("__id")).where("__id IS NOT NULL").distinct().orderBy("__id")
        numbers = cut(ids.withColumn("__doc", F.monotonically_increasing_id()))
        source = docs.join(numbers, docs[id_col] == F.col("__id"), "left").drop("__id")
    narrow = source.where("__doc IS NOT NULL").select(F.col("__doc").alias("doc"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_ranges(narrow, n, gram, max_bits).withColumnRenamed("doc", "__key")
    ranges = ranges.groupBy("__key").agg(F.collect_list("start").alias("__starts"), F.collect_list("run").alias("__runs"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    place = docs.columns.index(text_col)
    joined = source.join(ranges, F.col("__doc") == F.col("__key"), "left").drop("__key", "__doc")

    def cut_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col):
                texts = part.column(place)
                words = split(texts)
                per = words.per_doc()
                first = np.cumsum(per) - per
                cover = np.zeros(len(words.start) + 1, np.int64)
                starts, runs = part.column("__starts"), part.column("__runs")
                row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(starts), 0).to_numpy(zero_copy_only=False))
                at = first[row] + starts.flatten().to_numpy(zero_copy_only=False)
                to = np.minimum(at + runs.flatten().to_numpy(zero_copy_only=False), (first + per)[row])
                fits = at < to
                np.add.at(cover, at[fits], 1)
                np.add.at(cover, to[fits], -1)
                gone = np.cumsum(cover)[:-1] > 0
                removed = np.bincount(words.doc[gone], minlength=part.num_rows)
                changed = np.flatnonzero(removed)
                fresh = []
                for i in changed:
                    kept = np.flatnonzero(~gone[first[i] : first[i] + per[i]]) + first[i]
                    breaks = np.flatnonzero(np.diff(kept) > 1)
                    heads, tails = np.append(kept[:1], kept[breaks + 1]), np.append(kept[breaks], kept[-1:])
                    fresh.append(b" ".join(words.data[words.start[a] : words.end[b]].tobytes() for a, b in zip(heads, tails)).decode())
                if len(changed):
                    mask = np.zeros(part.num_rows, bool)
                    mask[changed] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(fresh, texts.type))
                columns = [*part.columns[:-2]]
                columns[place] = texts
                yield pa.RecordBatch.from_arrays([*columns, pa.array(per.astype(np.int64)), pa.array(removed.astype(np.int64))], schema.names)

    return joined.mapInArrow(cut_texts, schema)
