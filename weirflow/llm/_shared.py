"""Session helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids up to this number are sent to the tasks whole (8 bytes each); more are joined by a shuffle.
SENT_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Read from ``spark.checkpoint.dir`` (or a checkpoint folder that the caller
    has set). Where neither is set, a local session takes a temporary folder, as
    in tests; on a cluster executors would each write to a disk of their own, so
    that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weirflow-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", sent_ids: int = SENT_IDS) -> DataFrame:
    """``docs`` but for the rows whose id is in the one column of ``ids``; rows with a null id stay.

    Texts stay where they are unless there are more than ``sent_ids`` ids.
    """
    drop = cut(ids.toDF("__drop").where("__drop IS NOT NULL").distinct())
    if drop.count() <= sent_ids:
        drop = F.broadcast(drop)
    return docs.join(drop, docs[id_col] == F.col("__drop"), "left_anti")
