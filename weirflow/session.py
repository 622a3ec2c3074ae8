"""Sessions for local use, and shipping the package to executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session with the settings that the tests and the bench use."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("weirflow")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Bytes of an Arrow batch between the JVM and Python: long texts make batches of many rows very large.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Shuffle files go at the end of the query that made them; else they stay until the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python tasks can import it.

    Arrow batches of the session are bounded too, unless it has bounds of its own,
    and so is the life of shuffle files.
    """
    if spark.sparkContext.getConf().get(_CLEANUP) is None:
        spark.conf.set(_CLEANUP, "true")
    if spark.sparkContext.getConf().get(_BATCH) is None and spark.sparkContext.getConf().get(_ROWS) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
        spark.conf.set(_ROWS, "2000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weirflow-")) / "weirflow-package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
