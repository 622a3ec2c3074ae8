"""Ingestion of JSON events and cases, and JSON or Parquet tables by case."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirflow.schema import CASE, EVENT, flatten, violations


class Rejected(ValueError):
    """A batch broke a rule; ``rows`` lists index and reasons."""

    def __init__(self, rows: list) -> None:
        super().__init__(f"{len(rows)} rejected, first: {rows[0]}")
        self.rows = rows


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text, an object or an array of them per row, to ``index`` (place in its row), ``event`` and ``problems``.

    Fields outside the contract are a problem, as are rows that are no JSON.
    """
    text = F.col(column)
    many = F.when(F.ltrim(text).startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    parsed = lines.select(F.from_json(many, T.ArrayType(EVENT)).alias("events"), F.from_json(many, "array<map<string,string>>").alias("raw"))
    broken = parsed.where("raw IS NULL").select(F.lit(-1).alias("index"), F.lit(None).cast(EVENT).alias("event"), F.array(F.lit("json")).alias("problems"))
    rows = parsed.where("raw IS NOT NULL").select(F.posexplode(F.arrays_zip("events", "raw")).alias("index", "z"))
    known = F.array(*(F.lit(f.name) for f in EVENT.fields))
    extra = F.transform(F.array_except(F.map_keys(F.col("z.raw")), known), lambda k: F.concat(F.lit("unknown field "), k))
    return rows.select("index", F.col("z.events").alias("event"), F.concat(violations(F.col("z.events")), extra).alias("problems")).unionByName(broken)


def ingest(lines: DataFrame, table: DataFrame | None, case_id: str, column: str = "value") -> DataFrame:
    """The new transfers of a batch, or :class:`Rejected` for the whole batch.

    ``table``: transfers of the case so far; event ids must be new to it and
    within the batch. ``ingest_seq`` goes on from the table's.
    """
    rows = parse_events(lines, column).withColumn("batch", F.monotonically_increasing_id())
    twice = F.count("*").over(Window.partitionBy("event.event_id"))
    rows = rows.withColumn("problems", F.when(twice > 1, F.array_append("problems", F.lit("duplicate event_id"))).otherwise(F.col("problems")))
    start = 0
    if table is not None:
        known = table.where(F.col("case_id") == case_id).select(F.col("event_id").cast("string").alias("known")).distinct()
        rows = rows.join(known, F.col("event.event_id") == F.col("known"), "left")
        rows = rows.withColumn("problems", F.when(F.col("known").isNotNull(), F.array_append("problems", F.lit("event exists"))).otherwise(F.col("problems"))).drop("known")
        last = table.where(F.col("case_id") == case_id).agg(F.max("ingest_seq")).first()[0]
        start = 0 if last is None else last + 1
    bad = rows.where(F.size("problems") > 0).orderBy("index").limit(20).select("index", "problems").collect()
    if bad:
        raise Rejected([(r["index"], list(r["problems"])) for r in bad])
    order = F.row_number().over(Window.partitionBy(F.lit(case_id)).orderBy("batch", "index")) - 1 + start  # one request body
    return flatten(rows.select("event.*", order.cast("bigint").alias("ingest_seq"))).withColumn("case_id", F.lit(case_id))


def append(transfers: DataFrame, path: str) -> None:
    """Add transfers to a table laid out by case."""
    transfers.write.mode("append").partitionBy("case_id").parquet(path)


def read(spark: SparkSession, path: str, case_id: str | None = None) -> DataFrame:
    """Transfers of all cases, or of one (only its folder is read)."""
    out = spark.read.parquet(path).withColumn("case_id", F.col("case_id").cast("string"))
    return out if case_id is None else out.where(F.col("case_id") == case_id)


def exists(table: DataFrame, event_id: str) -> bool:
    return not table.where(F.col("event_id") == event_id).isEmpty()


def deduplicated(transfers: DataFrame) -> DataFrame:
    """One row per (case, event): the first ingested."""
    order = Window.partitionBy("case_id", "event_id").orderBy("ingest_seq")
    return transfers.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def new_cases(cases: DataFrame, known: DataFrame) -> DataFrame:
    """``cases`` to append; a case that exists, or comes twice, is an error."""
    clash = cases.groupBy("case_id").count().where("count > 1").select("case_id").unionByName(cases.join(known.select("case_id"), "case_id", "left_semi").select("case_id"))
    bad = clash.limit(5).collect()
    if bad:
        raise Rejected([(0, [f"case {r.case_id} exists"]) for r in bad])
    return cases


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASE).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document a line; decimals as text so that no digit is lost."""
    exact = [F.col(f.name).cast("string").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name) for f in df.schema]
    df.select(*exact).write.mode("overwrite").json(path)
