"""Vectorised word splitting and hashing over Arrow string batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All separators
are ASCII, so splitting the UTF-8 bytes equals splitting the characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text forms a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Words longer than this are hashed one by one with BLAKE2b.
LONG_WORD = 256
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_ROLLS = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: For tokens without punctuation: every ASCII byte but letters and digits separates.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, and maybe more; one table a base is kept, the longest short of 8 MB."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = _make_powers(base, 1 << max(16, (n - 1).bit_length()))
        if len(known) <= 1 << 20:
            _powers[base] = known
    return known


def _make_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some texts: byte ranges in ``data`` and the text's number."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray

    def per_doc(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=len(self.offsets) - 1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array and the offsets of its values; nulls are empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    large = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with at most ``limit`` text bytes, or one row."""
    if not batch.num_rows:
        return
    _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def split(texts: pa.Array, lower: bool = False, separator: np.ndarray = _SEPARATOR) -> Words:
    data, off = text_bytes(texts)
    if lower:
        data = np.frombuffer(data.tobytes().translate(LOWER), np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~separator[data]
    word = inside[1:-1]
    first, last = word & ~inside[:-2], word & ~inside[2:]
    if len(data):
        bounds = off[1:-1]
        bounds = bounds[(bounds > 0) & (bounds < len(data))]
        first[bounds] = word[bounds]
        last[bounds - 1] = word[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(data, off, start, end, np.searchsorted(off, start, "right") - 1)


def word_hashes(words: Words, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``which`` picks one of two independent ones."""
    out = np.empty(len(words.start), np.uint64)
    base = _BASES[which]
    inverse = pow(base, -1, 1 << 64)
    length = words.end - words.start
    at = 0
    while at < len(out):
        to = max(at + 1, int(np.searchsorted(words.end, words.start[at] + CHUNK_BYTES, "right")))
        a, b = int(words.start[at]), int(words.end[to - 1])
        if b - a <= CHUNK_BYTES:  # else one very long word, hashed below
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum((words.data[a:b].astype(np.uint64) + np.uint64(1)) * powers(base, b - a)[: b - a], out=sums[1:])
            s, e = words.start[at:to] - a, words.end[at:to] - a
            out[at:to] = (sums[e] - sums[s]) * powers(inverse, b - a)[s]
        at = to
    out = mix(out + length.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    for i in np.flatnonzero(length > LONG_WORD):
        digest = hashlib.blake2b(words.data[words.start[i] : words.end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest()
        out[i] = int.from_bytes(digest, "little")
    return out


def gram_hashes(hashes: np.ndarray, doc: np.ndarray, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words inside one text, and each run's first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    roll = _ROLLS[which]
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(roll, len(hashes))[: len(hashes)], out=sums[1:])
    at = np.flatnonzero(doc[:count] == doc[n - 1 :])
    inverse = powers(pow(roll, -1, 1 << 64), len(hashes))
    return mix((sums[at + n] - sums[at]) * inverse[at] + np.uint64(n)), at
