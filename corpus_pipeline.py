"""A training corpus from ``documents``: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import packing, toxicity
from weirflow.llm._shared import new_folder
from weirflow.llm.decontaminate import remove_contaminated
from weirflow.llm.near import keep_first
from weirflow.llm.queries import tokenizer_path
from weirflow.llm.substring import dedup_substrings
from weirflow.session import ship


#: Words that a task of the packing stage remembers: less than alone, as the stages before share its executor.
CACHED_WORDS = 800_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on all labels, scores below one half."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels, F.lit(True)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by a five-word similarity of 0.8; the byte-position index of ``op2`` proposes first."""
    ship(spark)
    return keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 20 words that occur earlier; a document left without a word goes."""
    ship(spark)
    own = {c: f"__own_{c}" for c in ("n_words", "n_removed") if c in docs.columns}
    kept = dedup_substrings(docs.withColumnsRenamed(own))
    kept = kept.where("n_removed = 0 OR n_removed < n_words")
    changed = F.col("n_removed") > 0
    size = F.when(changed, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    ship(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token piece's place in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(packing.tokenize_pieces(docs, tokenizer_path(), by_word=True, keep_ids=False, cached=CACHED_WORDS, forget=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

#: Tokens, fingerprints and a fitted model have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
