"""Best-fit packing of token pieces, planned over the histogram of lengths.

The plan sees only how many pieces have each length: at most ``max_len`` numbers
reach the driver, whatever the corpus holds. Pieces then take planned slots by
their rank within their length. Ranks come from a count per (length, bucket)
plus a row number inside each bucket, so no length is gathered in one task.

Null texts count as empty; an empty text is one piece that holds the end id.
Rows with a null id and repeated rows are packed like any other.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import cut, partitions
from weirflow.llm._words import chunks

#: Characters for which lower-casing and splitting a word at a time gives the
#: tokenizer's own result: ASCII, Latin letters with marks, dashes and quotes.
_ODD = re.compile("[^\t\n\r -~¡-įı-ɏ‐-‧‰-⁞]|<\\|")
#: Words whose ids a Python worker remembers, in two halves: as one fills up, the older one goes.
CACHED = 1_200_000
LONG_WORD = 64
#: A word of one token that stands between words encoded together, and how many are.
BETWEEN, TOGETHER = "~", 512
_loaded: dict[str, list] = {}
_cut_alike: dict[str, bool | None] = {}
#: How ``word_bpe_49k.json`` cuts lower-case words, in its own terms and for the characters of ``_ODD``; its bytes as characters.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LOWER = sorted({c for x in range(0x21, 0x2060) for c in chr(x).lower()})  # two of them lie beyond
_KINDS = {k: "".join(re.escape(c) for c in _LOWER if unicodedata.category(c)[0] == k) for k in "LN"}
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_KINDS['L']}]+|[{_KINDS['N']}]|[^\\s{_KINDS['L']}{_KINDS['N']}]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARACTERS = {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


def _tokenizer(path: str) -> list:
    """Tokenizer, newer and older half of the words' ids."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = [Tokenizer.from_file(path), {}, {}]
    return _loaded[path]


def forget_words() -> None:
    """Free the remembered words of this Python worker; the tokenizers stay."""
    for loaded in _loaded.values():
        loaded[1:] = {}, {}
    pa.default_memory_pool().release_unused()


def _ids(tokenizer, texts: list[str]) -> list[bytes]:  # noqa: ANN001
    return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def cuts_alike(tokenizer) -> bool:  # noqa: ANN001
    """Whether the tokenizer cuts words by ``SPLIT`` into runs of bytes that its model takes one by one."""
    how = json.loads(tokenizer.to_str())
    steps = (how["pre_tokenizer"] or {}).get("pretokenizers") or []
    split = [(s["type"], s.get("pattern"), s.get("invert"), s.get("add_prefix_space"), s.get("use_regex")) for s in steps]
    return split == [("Split", {"Regex": SPLIT}, True, None, None), ("ByteLevel", None, None, False, False)] and how["model"]["type"] == "BPE" and not how["model"]["dropout"]


def piece_ids(tokenizer, words: Iterable[str], *known: dict[str, bytes]) -> dict[str, bytes]:  # noqa: ANN001
    """The ids of each word from those of its pieces, each of which goes to the model once; pieces that are ``known`` words do not."""
    model, out, made = tokenizer.model.tokenize, {}, {}
    for word in words:
        pieces = _PIECES.findall(word)
        for piece in pieces:
            if piece in made:
                continue
            for k in known:
                if piece in k:
                    made[piece] = k[piece]
                    break
            else:
                shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_AS_CHARACTERS)
                made[piece] = array("I", [t.id for t in model(shown)]).tobytes()
        out[word] = made[pieces[0]] if len(pieces) == 1 else b"".join([made[p] for p in pieces])
    return out


def word_ids(tokenizer, words: list[str]) -> dict[str, bytes]:  # noqa: ANN001
    """The ids of each word, many words to a text, cut where the word between them is."""
    mark, out = tokenizer.encode(BETWEEN, add_special_tokens=False).ids, {}
    alone = [w for w in words if BETWEEN in w]
    words = [w for w in words if BETWEEN not in w]
    for i in range(0, len(words), TOGETHER):
        part = words[i : i + TOGETHER]
        joined = _ids(tokenizer, [f" {BETWEEN} ".join(part)])[0]
        ids = np.frombuffer(joined, "<u4")
        cuts = 4 * np.flatnonzero(ids == mark[0]) if len(mark) == 1 else ids[:0]
        if len(cuts) != len(part) - 1:
            alone += part
            continue
        out |= {w: joined[a:b] for w, a, b in zip(part, [0, *(cuts + 4).tolist()], [*cuts.tolist(), len(joined)])}
    return out | dict(zip(alone, _ids(tokenizer, alone)))


def encode(texts: list[str], path: str, by_word: bool, cached: int = CACHED) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    ``by_word``: the tokenizer lower-cases and never joins across white space
    (as ``word_bpe_49k.json`` does), so ids of plain texts come from a cache of words.
    """
    loaded = _tokenizer(path)
    plain = [by_word and not _ODD.search(t) for t in texts]
    words = [t.lower().split() if p else None for t, p in zip(texts, plain)]
    odd = iter(_ids(loaded[0], [t for t, p in zip(texts, plain) if not p]))
    if len(loaded[1]) > cached // 2:
        loaded[1:] = {}, loaded[1]
    tokenizer, newer, older = loaded
    missing = set().union(*(w for w in words if w)).difference(newer)
    known = missing.intersection(older)
    newer.update(zip(known, map(older.__getitem__, known)))
    if _cut_alike.setdefault(path, None) is None:
        _cut_alike[path] = cuts_alike(tokenizer)
    newer.update(piece_ids(tokenizer, missing - known, newer, older) if _cut_alike[path] else word_ids(tokenizer, list(missing - known)))
    out = [b"".join(map(newer.__getitem__, w)) if w is not None else next(odd) for w in words]
    for w in missing:
        if len(w) > LONG_WORD:
            del newer[w]
    return out


def tokenize_pieces(
    docs: DataFrame,
    tokenizer: str,
    max_len: int = 2048,
    end_id: int = 0,
    by_word: bool = False,
    keep_ids: bool = True,
    cached: int = CACHED,
    id_col: str = "doc_id",
    text_col: str = "text",
    forget: bool = False,
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` of every piece.

    A document is its ids and ``end_id``; one longer than ``max_len`` is cut
    into pieces of that length, the last of which may be shorter. ``by_word`` is
    for tokenizers that lower-case and split at white space (see ``encode``); a
    Python worker then remembers the ids of up to ``cached`` words, some 200 bytes each,
    from task to task or, with ``forget``, to the end of its task: whatever runs
    in the executor afterwards then has that memory.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for part in chunks(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                encoded = [x + end for x in encode(texts, tokenizer, by_word, cached)]
                size = np.fromiter((len(x) // 4 for x in encoded), np.int64, len(encoded))
                n = -(-size // max_len)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * max_len
                length = np.minimum(max_len, size[row] - start)
                crc = [zlib.crc32(encoded[r][4 * s : 4 * (s + k)]) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if keep_ids:
                    offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(encoded), "<u4").astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from pieces_of(batches)
        finally:
            if forget:
                forget_words()

    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)


def plan_slots(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, count, first sequence, pieces a sequence, offset).

    Sequences with equal room are kept as ranges of numbers. The length at hand
    fills the sequences with the least sufficient room, as many as needed at a
    time; a range is split only where the pieces run out.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    plan, opened = [], 0

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                insort(order, space)
            room[space].append((first, n))

    for length, left in sorted(histogram, reverse=True):
        rank = 0
        while left:
            at = bisect_left(order, length)
            if at == len(order):
                n = -(-left // (capacity // length))
                put(capacity, opened, n)
                opened += n
                at = bisect_left(order, length)
            space = order[at]
            first, n = room[space].pop()
            if not room[space]:
                del room[space], order[at]
            per = space // length
            full = min(n, left // per)
            if full:
                plan.append((length, rank, full * per, first, per, capacity - space))
                rank, left = rank + full * per, left - full * per
                put(space - per * length, first, full)
            if full < n and left:
                plan.append((length, rank, left, first + full, per, capacity - space))
                put(space - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(space, first + full, n - full)
    return plan


def pack(pieces: DataFrame, max_len: int = 2048, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` (with a ``length`` of 1 to ``max_len``) plus ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    buckets = max(64, partitions(spark))
    dealt = cut(pieces.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")))
    counts = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    histogram = [(r.length, r.n) for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()]  # at most max_len rows
    table = np.array(sorted(plan_slots(histogram, max_len)), np.int64).reshape(-1, 6)
    sent = spark.sparkContext.broadcast(table)
    within = Window.partitionBy("length", "__bucket").orderBy(*order)
    ranked = dealt.withColumn("__rank", F.row_number().over(within)).join(counts.drop("__n"), ["length", "__bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("__base") + F.col("__rank") - 1).alias("__rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, rank, _, first, per, offset = sent.value.T
        starts = (length << 48) + rank
        for batch in batches:
            mine = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            r = batch.column("__rank").to_numpy(zero_copy_only=False)
            row = np.searchsorted(starts, (mine << 48) + r, "right") - 1
            k = r - rank[row]
            columns = [*batch.columns[:-1], pa.array(first[row] + k // per[row]), pa.array(offset[row] + k % per[row] * mine)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
