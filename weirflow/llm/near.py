"""Near copies by the exact Jaccard similarity of five-word shingles.

The first links come from :mod:`weirflow.llm.simhash`: texts whose fingerprints meet
in the byte-position index and differ in at most three bits, verified on whole
shingle sets. What fingerprints cannot reach comes from the sketches, lists and verification of
:mod:`weirflow.llm.hyperminhash`, with shingles of five words and with all texts
without words as one group. A pair of similarity 0.8 shares no list with
probability (1 - 0.8**4)**32, under 0.0000001; every link is verified on whole
sets, and no list of more than a stated number of rows is one task.

Words are lower-cased (A-Z). Fewer words than a shingle: the whole sequence is
one shingle. Null texts and texts without words are equal to each other. Rows
with a null id are kept and link nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm import hyperminhash, simhash
from weirflow.llm._shared import cut


def _alike(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``u, v``: each document with the first of its group by fingerprints."""
    groups = simhash.near_duplicates(docs, id_col=id_col, text_col=text_col).where("component_id <> doc_id")
    return cut(groups.groupBy(F.col("doc_id").alias("v")).agg(F.min("component_id").alias("u")).select("u", "v"))


def near_copies(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id``: the smallest id among documents reachable over links of that similarity."""
    found = hyperminhash.near_duplicates(docs, n, threshold, link_empty=True, id_col=id_col, text_col=text_col, pairs=_alike(docs, id_col, text_col))
    return found.select("doc_id", "component_id")


def keep_first(docs: DataFrame, threshold: float = 0.8, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near copies: that with the smallest id."""
    return hyperminhash.keep_first(docs, n, threshold, id_col, text_col, link_empty=True, pairs=_alike(docs, id_col, text_col))
