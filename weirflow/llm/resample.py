"""Importance resampling towards a target distribution over a persisted sparse count matrix.

Features are all runs of 1 to ``max_n`` consecutive words of a text (lower-cased
A-Z; letters, digits and non-ASCII characters make words), joined by one space;
a feature's column is the unsigned crc32 of its UTF-8 bytes modulo ``buckets``.

1. One scan counts features and writes the document-by-bucket matrix as CSR
   blocks: a row of the table holds some documents' ids, word counts, row
   bounds, column numbers and counts. Row groups are a few blocks, so what a task
   holds does not follow from how much it reads. Nothing reads the texts again.
2. Column sums of the blocks, summed up within each task before the shuffle, give
   the corpus' and the target's distributions; ``buckets`` sums reach the driver.
   A bucket's gain is floor(1000 ln(p_target / p_corpus)) with add-one smoothing.
3. The matrix times the gains gives each document's sum, and its weight is the
   mean over its features, rounded down (0 without features).

Documents are drawn without replacement by adding Gumbel noise from a hash of
the id to the weight and taking the highest scores: a tenth of those with at
least ``min_words`` words. Scores are integers between bounds that a logarithm
sets, so a table of their counts is small however many documents there are. It
gives each score's first rank; ranks of equal scores follow the ids.

Null and empty texts have no features. Rows with a null id get no score and are
not drawn or counted as candidates. Repeated rows are ranked one after another.
Texts are read whole; extra columns are ignored. An empty target or corpus is
smoothed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import cut, new_folder
from weirflow.llm._words import PUNCTUATION, Words, chunks, split

#: Blocks of a row group of the matrix. A reader holds a whole row group of up to 4096 rows at once, and a block is up to a million cells.
GROUP_BLOCKS = 4
#: Bytes of a word that go through the table in step with other words'; the rest of longer ones is done alone.
IN_STEP = 24


def _crc_table(polynomial: int = 0xEDB88320) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(polynomial), out >> 1)
    return out


_TABLE = _crc_table()


def _fed(state: np.ndarray, words: Words, which: np.ndarray) -> np.ndarray:
    """crc states after the bytes of the words ``which``."""
    state, start, size = state.copy(), words.start[which], (words.end - words.start)[which]
    going = np.arange(len(which))
    for k in range(IN_STEP):
        going = going[size[going] > k]
        if not len(going):
            break
        now = state[going]
        state[going] = _TABLE[(now ^ words.data[start[going] + k]) & 255] ^ (now >> 8)
    for i in np.flatnonzero(size > IN_STEP).tolist():
        rest = words.data[start[i] + IN_STEP : start[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(~state[i])) ^ 0xFFFFFFFF
    return state


def features(words: Words, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and unsigned crc32 of every feature."""
    at = np.arange(len(words.doc))
    state = _fed(np.full(len(at), 0xFFFFFFFF, np.uint32), words, at)
    docs, crcs = [words.doc], [~state]
    for n in range(1, max_n):
        inside = np.flatnonzero(words.doc[at[: len(at)]] == words.doc[np.minimum(at + n, len(words.doc) - 1)]) if len(at) else at
        inside = inside[at[inside] + n < len(words.doc)]
        at, state = at[inside], state[inside]
        state = _TABLE[(state ^ np.uint32(32)) & 255] ^ (state >> 8)
        state = _fed(state, words, at + n)
        docs.append(words.doc[at])
        crcs.append(~state)
    return np.concatenate(docs), np.concatenate(crcs)


def write_matrix(docs: DataFrame, folder: str, buckets: int = 10_000, max_n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The count matrix of ``docs`` as CSR blocks in ``folder``, read back."""
    if not 1 <= buckets <= 1 << 31 or max_n < 1:
        raise ValueError("buckets and max_n must be positive")

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                words = split(part.column("text"), lower=True, separator=PUNCTUATION)
                doc, crc = features(words, max_n)
                cells, counts = np.unique(doc * buckets + (crc % np.uint32(buckets)).astype(np.int64), return_counts=True)
                bounds = np.searchsorted(cells // buckets, np.arange(part.num_rows + 1))
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                columns = [part.column("doc_id"), pa.array(words.per_doc().astype(np.int64)), pa.array(bounds.astype(np.int32)), pa.array((cells % buckets).astype(np.int32)), pa.array(counts.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([one(c) for c in columns], ["ids", "n_words", "bounds", "buckets", "counts"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source.mapInArrow(block, f"ids array<{kind}>, n_words array<bigint>, bounds array<int>, buckets array<int>, counts array<bigint>").write.option("parquet.block.row.count.limit", GROUP_BLOCKS).parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def column_sums(matrix: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Features in each bucket; a task gives at most one number a bucket to the shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("buckets").flatten().to_numpy(), batch.column("counts").flatten().to_numpy())
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = matrix.select("buckets", "counts").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # buckets rows at most
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, a bucket each."""
    many, t, s = len(target), int(target.sum()), int(corpus.sum())
    ratio = (target + 1.0) * float(s + many) / ((corpus + 1.0) * float(t + many))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the matrix times ``gain``, as a floored mean over features."""
    sent = matrix.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, bounds, cols, counts = (batch.column(c).slice(i, 1).flatten() for c in ("ids", "n_words", "bounds", "buckets", "counts"))
                bounds, counts = bounds.to_numpy(), counts.to_numpy()
                summed = lambda x: np.diff(np.append(0, np.cumsum(x))[bounds])
                n, total = summed(counts), summed(counts * sent.value[cols.to_numpy()])
                yield pa.RecordBatch.from_arrays([ids, words, pa.array(n), pa.array(total // np.maximum(n, 1))], ["doc_id", "n_words", "n_features", "weight"])

    kind = matrix.schema["ids"].dataType.elementType.simpleString()
    return matrix.mapInArrow(multiply, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_: Column, salt: str = "2024") -> Column:
    """floor(1000 g) with g from the standard Gumbel distribution, by a hash of the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), id_.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def draw(scored: DataFrame, percent: int = 10, min_words: int = 20) -> DataFrame:
    """``scored`` (``doc_id, n_words, score``, ...) with ``rank``: 1, 2, ... of the highest scores, null for the rest."""
    open_ = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    tally = scored.where(open_).groupBy("score").agg(F.count("*").alias("here"))
    # as many rows as integers between the least and the greatest score
    running = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    tally = cut(tally.withColumn("before", F.coalesce(F.sum("here").over(running), F.lit(0))))
    most = (tally.agg(F.sum("here")).first()[0] or 0) * percent // 100
    first = tally.where(F.col("before") < most).select(F.col("score").alias("__score"), F.col("before").alias("__before"))
    placed = scored.join(F.broadcast(first), open_ & (F.col("score") == F.col("__score")), "left")
    drawn, rest = placed.where("__before IS NOT NULL"), placed.where("__before IS NULL")
    place = F.col("__before") + F.row_number().over(Window.partitionBy("__score").orderBy("doc_id"))
    drawn = drawn.withColumn("rank", F.when(place <= most, place))
    return drawn.unionByName(rest.withColumn("rank", F.lit(None).cast("bigint"))).drop("__score", "__before")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, buckets: int = 10_000, max_n: int = 1, salt: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """Every document's ``doc_id, n_words, n_features, weight, score, rank``; drawn documents have a rank."""
    spark: SparkSession = docs.sparkSession
    matrix = write_matrix(docs, new_folder(spark, "resample-corpus"), buckets, max_n, id_col, text_col)
    wanted = write_matrix(target.select(F.lit(None).cast("bigint").alias("doc_id"), F.col(target_text_col).alias("text")), new_folder(spark, "resample-target"), buckets, max_n)
    gain = gains(column_sums(wanted, buckets), column_sums(matrix, buckets))
    scored = cut(weights(matrix, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt)))
    return draw(scored, percent, min_words)
