"""Quality score by compression with dictionaries of good and bad text.

Two zstandard dictionaries are built from labelled good and bad documents;
lines that both hold teach nothing and are left out. A text is compressed with
either, in independent blocks so that the dictionary matters throughout. The
difference of the sizes, divided by their sum (plus a constant, since short
texts say little), is calibrated to a probability by logistic regression on
further labelled rows. How far the text shrinks at all is a second input of the
calibration: text that repeats itself shrinks to almost nothing with either
dictionary, so their difference cannot tell it.

The dictionaries and the calibration see at most ``per_class`` labelled rows
of either kind and ``dictionary_bytes`` of their text; every document is scored
whole. Null and empty texts get the score of a difference of zero. Without
labels of both kinds every score is the share of good labels (0.5 if none).
Repeated rows and null ids are scored like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.llm._labels import labelled_sample
from weirflow.llm._words import chunks

BLOCK = 4096
#: Bytes added to the sum of both sizes.
SHORT = 512


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # intercept, slope of the difference, slope of the shrinkage
    level: int = 3


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on ``samples``, or their bytes where there are too few."""
    parts = [s[i : i + BLOCK] for s in samples for i in range(0, len(s), BLOCK)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-size:]


class Compressor:
    """Compressed size of texts with one dictionary."""

    def __init__(self, dictionary: bytes, level: int) -> None:
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if data is not None:
            data.precompute_compress(level=level)
        self._zstd = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)

    def size(self, text: bytes) -> int:
        view, compress = memoryview(text), self._zstd.compress
        return sum(len(compress(view[i : i + BLOCK])) for i in range(0, len(text), BLOCK))


def sizes(texts: list[bytes], good: Compressor, bad: Compressor) -> tuple[np.ndarray, np.ndarray]:
    """Normalised difference (above zero where good text explains it better), and the log of the shrinkage."""
    a = np.array([good.size(t) for t in texts], np.float64)
    b = np.array([bad.size(t) for t in texts], np.float64)
    raw = np.fromiter(map(len, texts), np.float64, len(texts))
    return (b - a) / (a + b + SHORT), np.log((raw + SHORT) / ((a + b) / 2 + SHORT))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Intercept and slopes (``x``: one row per observation) by Newton's method with a little shrinkage."""
    x = x.reshape(len(x), -1)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    design = np.column_stack([np.ones(len(x)), x / scale])
    w, ridge = np.zeros(design.shape[1]), np.diag([1e-6, *[1e-2] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (weight * (y - p)) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), *(w[1:] / scale).tolist())


def fit(
    docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 3000, dictionary_bytes: int = 4 << 20, dictionary_size: int = 65_536,
    level: int = 3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Model:
    """Half of the sample, up to ``dictionary_bytes`` a kind, builds the dictionaries; the rest calibrates.

    One text gives at most a 64th of ``dictionary_bytes``: a longer one, blocks spread over all of it.
    """
    counts = {r[0]: r[1] for r in labels.where(usable).groupBy(F.col(label_col).cast("int")).count().collect()}
    shares = {y: counts.get(y, 0) for y in (0, 1)}
    if not all(shares.values()):
        rate = (shares[1] / sum(shares.values())) if sum(shares.values()) else 0.5
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return Model(b"", b"", (float(np.log(rate / (1 - rate))), 0.0, 0.0), level)
    sample = labelled_sample(docs, labels, label_col, usable, per_class, id_col, text_col).where("text is not null")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    running = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    excerpts = _excerpts(sample.where(half == 0).select("doc_id", "y", "text"), max(BLOCK, dictionary_bytes // 64))
    for_dictionary = excerpts.withColumn("sum", F.sum(F.octet_length("text")).over(running)).where(F.col("sum") <= dictionary_bytes)
    texts: dict[int, list[bytes]] = {0: [], 1: []}
    for r in for_dictionary.orderBy("y", F.xxhash64("doc_id"), "doc_id").collect():
        texts[r.y].append(bytes(r.text))
    lines = {y: {line for t in texts[y] for line in t.split(b"\n")} for y in texts}
    own = {y: [b"\n".join(line for line in t.split(b"\n") if line not in lines[1 - y]) for t in texts[y]] for y in texts}
    model = Model(train_dictionary(own[1], dictionary_size), train_dictionary(own[0], dictionary_size), (0.0, 0.0, 0.0), level)
    rest = [(r.x, r.shrinkage, r.y) for r in _sizes(sample.where(half == 1), model, "text", ["y"]).select("x", "shrinkage", "y").collect()]
    if len({r[2] for r in rest}) == 2:
        x, y = np.array([r[:2] for r in rest]), np.array([r[2] for r in rest], np.float64)
        prior = np.array([shares[0], shares[1]], np.float64) / sum(shares.values())
        weight = prior[y.astype(int)] / np.array([np.mean(y == 0), np.mean(y == 1)])[y.astype(int)]
        model.weights = fit_logistic(x, y, weight)
    return model


def _excerpts(docs: DataFrame, most: int) -> DataFrame:
    """Texts as bytes; of one longer than ``most``, blocks spread evenly over it, so that none takes the whole budget."""

    def cut_(text: bytes) -> bytes:
        blocks, wanted = -(-len(text) // BLOCK), max(1, most // BLOCK)
        if len(text) <= most:
            return text
        return b"".join(text[BLOCK * at : BLOCK * (at + 1)] for at in (i * blocks // wanted for i in range(wanted)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [cut_(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(texts, pa.binary())], ["doc_id", "y", "text"])

    return docs.mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, text binary")


def _sizes(docs: DataFrame, model: Model, text_col: str, keep: list[str]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        good, bad = Compressor(m.good, m.level), Compressor(m.bad, m.level)
        for batch in batches:
            for part in chunks(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                x, shrinkage = sizes(texts, good, bad)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), pa.array(x), pa.array(shrinkage)], [*keep, "x", "shrinkage"])

    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col(text_col).cast("string").alias("text")).mapInArrow(scan, f"{fields}, x double, shrinkage double")


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, difference, score`` of every document in one scan."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = _sizes(narrow, model, "text", ["doc_id"])
    a, b, c = model.weights
    odds = F.lit(a) + F.lit(b) * F.col("x") + F.lit(c) * F.col("shrinkage")
    return found.select("doc_id", F.col("x").alias("difference"), (1 / (1 + F.exp(-odds))).alias("score"))
