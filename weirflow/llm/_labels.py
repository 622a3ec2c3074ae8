"""Bounded samples of labelled rows, joined to their texts without moving the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text, y`` of at most ``per_class`` rows of either label, picked by a hash of the id.

    The sample of ids has a proven bound, so it is broadcast and texts stay where they are.
    """
    order = Window.partitionBy("y").orderBy(F.xxhash64("__id"), "__id")
    some = (
        labels.where(usable).where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
        .select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y")).distinct()
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class).drop("n")
    )
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.join(F.broadcast(some), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "y")


def logistic(x: float) -> float:
    import math

    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
