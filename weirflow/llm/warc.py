"""WARC archives: writing with revisits, reading with boundary-chain verification.

Writing is a text sink whose row separator is the record separator, so Spark's
own committer places the files and a lost task is simply run again. Reading
splits files at every ``CRLF CRLF WARC/1.0 CRLF``: a candidate record start,
which may as well be bytes of a payload. Each candidate gives the offset its
record would end at (its successor). Candidates that follow one another
directly are folded to runs, and pointer jumping over runs from each file's
start keeps only what the chain of true records reaches. Payloads cut by such
bytes are put together again from their segments.

Null payloads are empty, null URLs empty, null page ids a record id without a
number. A record's length may have up to 18 digits; one of 2 GiB or more is
stepped over like any other, but its payload is more than a Spark value holds
and reading it fails. Of records with equal payloads of at least ``revisit_bytes`` that with
the smallest page id is the response and the others revisit it; repeated rows
of that page id are all responses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm._shared import cut

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_ID = "urn:weirflow:page:"


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def _record(refers: Column) -> Column:
    revisit = refers.isNotNull()
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), page, F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.when(
            revisit,
            F.concat(
                F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"),
                line("WARC-Refers-To", F.concat(F.lit(f"<{_ID}"), refers.cast("string"), F.lit(">"))),
            ),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: application/http;msgtype=response\r\n"),
        line("Content-Length", _bytes(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


#: Revisits up to this number go to the writing tasks whole (about 100 bytes each); more are joined by a shuffle.
SENT_REVISITS = 200_000


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 100, sent_revisits: int = SENT_REVISITS, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """One WARC record per row of ``pages`` in the files of ``folder``.

    Payloads stay where they are read, unless there are more than ``sent_revisits`` revisits.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumns({"bytes": _bytes(F.col("payload")), "digest": F.sha2("payload", 256)})
    known = cut(base.where(F.col("bytes") >= revisit_bytes).select("page_id", "digest"))
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = cut(known.join(firsts, "digest").where("page_id <> refers_to").distinct())
    if revisits.count() <= sent_revisits:
        revisits = F.broadcast(revisits)
    records = base.join(revisits, ["page_id", "digest"], "left").select(_record(F.col("refers_to")).alias("value"))
    records.write.option("lineSep", END).text(folder)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    """Stretches between candidate starts, with the place each was read at."""
    rows = spark.read.option("lineSep", END + MAGIC).text(folder)
    return rows.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"), "value",
    )


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate start: file, offset, successor, header fields, and digests where the record lies in one segment."""
    seg = _segments(spark, folder)
    step = len(END + MAGIC)
    sizes = seg.select("file", "split", "at", (_bytes(F.col("value")) + step).alias("size"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    splits = sizes.groupBy("file", "split").agg(F.sum("size").alias("total"))
    splits = splits.withColumn("base", F.coalesce(F.sum("total").over(before("file", "split")), F.lit(0)))
    ends = splits.groupBy("file").agg((F.sum("total") - step).alias("file_end"))
    first = F.col("value").startswith(MAGIC)
    rest = F.when(first & (F.col("split") == 0), F.substr(F.col("value"), F.lit(len(MAGIC) + 1))).otherwise(F.col("value"))
    head = F.substring_index(F.col("rest"), END, 1)
    field = lambda name, form: F.regexp_extract("header", rf"(?im)^{name}:[ \t]*{form}[ \t]*\r?$", 1)
    parsed = (
        seg.withColumn("rest", rest)
        .withColumn("header", head)
        .withColumn("head_bytes", _bytes(F.col("header")) + len(END))
        .withColumn("has_head", F.instr("rest", END) > 0)
        .withColumn("length", F.when(F.col("has_head"), field("Content-Length", "([0-9]{1,18})").try_cast("bigint")))
        .withColumn("kind", field("WARC-Type", r"([\w-]+)"))
        .withColumn("block", F.expr("substring(cast(rest as binary), cast(head_bytes + 1 as int), cast(least(coalesce(length, 0), 2147483647) as int))"))
        .withColumn("whole", F.col("has_head") & F.col("length").isNotNull() & (F.length("block") == F.col("length")))
    )
    rows = parsed.select(
        "file", "split", "at", (_bytes(F.col("value")) + step).alias("size"), "head_bytes", "length", "kind", "whole",
        field("WARC-Record-ID", f"<{_ID}(-?[0-9]*)>").alias("page"), field("WARC-Refers-To", f"<{_ID}(-?[0-9]+)>").alias("refers"),
        field("WARC-Target-URI", "(.*?)").alias("url"), field("WARC-Payload-Digest", "sha256:([0-9a-f]+)").alias("said_digest"),
        field("WARC-Payload-Length", "([0-9]+)").alias("said_bytes"),
        *_digests(F.col("block"), F.col("whole")),
    )
    rows = rows.join(splits.select("file", "split", "base"), ["file", "split"]).join(ends, "file")
    inside = F.coalesce(F.sum("size").over(before("file", "split", "at")), F.lit(0))
    rows = rows.withColumn("content", F.col("base") + inside)
    offset = F.when(F.col("content") == 0, F.lit(0)).otherwise(F.col("content") - len(MAGIC))
    rows = rows.withColumn("offset", offset.cast("bigint"))
    succ = F.col("offset") + len(MAGIC) + F.col("head_bytes") + F.col("length") + len(END)
    return rows.withColumn("succ", F.when(F.col("length").isNotNull() & (F.col("kind") != ""), succ)).drop("content", "base", "size")


def _digests(block: Column, where: Column) -> list[Column]:
    """Bytes and SHA-256 of the payload, which follows the block's HTTP header."""
    http = F.octet_length(F.substring_index(block.cast("string"), END, 1)) + len(END)
    payload = F.substr(block, http + 1, F.greatest(F.length(block) - http, F.lit(0)))
    return [F.when(where, F.length(payload).cast("bigint")).alias("payload_bytes"), F.when(where, F.sha2(payload, 256)).alias("payload_digest")]


def reachable(found: DataFrame) -> DataFrame:
    """``file, offset`` of candidates on the chain from their file's start."""
    in_split = Window.partitionBy("file", "split").orderBy("offset")
    links = found.select("file", "split", "offset", "succ")
    links = links.withColumn("straight", F.coalesce(F.col("succ") == F.lead("offset").over(in_split), F.lit(False)))
    targets = links.where("not straight and succ is not null").select("file", F.col("succ").alias("offset")).distinct().withColumn("target", F.lit(True))
    marked = links.join(targets, ["file", "offset"], "left")
    begins = ~F.coalesce(F.lag("straight").over(in_split), F.lit(False)) | F.coalesce("target", F.lit(False))
    marked = marked.withColumn("entry", F.when(begins, F.col("offset")))
    so_far = in_split.rowsBetween(Window.unboundedPreceding, 0)
    marked = cut(marked.withColumn("entry", F.last("entry", True).over(so_far)).select("file", "offset", "entry", "succ"))
    runs = marked.groupBy("file", "entry").agg(F.max_by("succ", "offset").alias("to"))
    jump = cut(runs.where("to is not null").select("file", "entry", "to"))
    reached = cut(runs.where("entry = 0").select("file", "entry"))
    n = reached.count()
    while True:
        steps = reached.join(jump, ["file", "entry"]).select("file", F.col("to").alias("entry"))
        grown = cut(reached.unionByName(steps.join(runs.select("file", "entry"), ["file", "entry"], "left_semi")).distinct())
        now = grown.count()
        if now == n:
            break
        reached, n = grown, now
        there = jump.select("file", F.col("entry").alias("to"), F.col("to").alias("beyond"))
        jump = cut(jump.join(there, ["file", "to"]).select("file", "entry", F.col("beyond").alias("to")))
    return marked.join(reached, ["file", "entry"], "left_semi").select("file", "offset")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """The true records of ``folder``: page_id, url, record_type, refers_to, payload_bytes, payload_digest (and payload).

    Size and digest are taken from the payload read; a revisit, which has none,
    gives those of its header. A record that runs past its file's end is left out.
    """
    found = cut(candidates(spark, folder))
    true = found.join(reachable(found), ["file", "offset"]).where(F.col("succ") <= F.col("file_end"))
    whole = true.where("whole")
    columns = ["file", "offset", "page", "url", "kind", "refers", "said_digest", "said_bytes", "payload_bytes", "payload_digest"]
    seg = _segments(spark, folder).select("file", "split", "at", "value")
    out = whole.select(*columns, "split", "at")
    if with_payload:
        rest = F.when((F.col("split") == 0) & F.col("value").startswith(MAGIC), F.substr("value", F.lit(len(MAGIC) + 1))).otherwise(F.col("value"))
        block = F.expr("substring(cast(rest as binary), cast(head_bytes + 1 as int), cast(least(length, 2147483647) as int))")
        http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
        out = (
            whole.join(seg, ["file", "split", "at"]).withColumn("rest", rest).withColumn("block", block)
            .withColumn("payload", F.substr("block", http + 1).cast("string")).select(*columns, "payload")
        )
    else:
        out = out.select(*columns)
    if not found.where("not whole").isEmpty() and not true.where("not whole").isEmpty():
        # segments of a payload that holds record starts: the owner is the last true record before them
        owners = true.select("file", "offset", F.col("offset").alias("owner"), F.col("whole").alias("own_whole"))
        rows = found.select("file", "offset", "split", "at").join(owners, ["file", "offset"], "left")
        rows = rows.where("not coalesce(own_whole, false)")  # true records in pieces, and what no chain reaches
        back = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("owner", F.last("owner", True).over(back)).where("owner is not null").drop("own_whole")
        parts = rows.join(seg, ["file", "split", "at"]).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("offset", "value"))).alias("parts"))
        text = F.array_join(F.transform("parts", lambda p: p["value"]), END + MAGIC)
        rest = F.when((F.col("offset") == 0) & F.col("text").startswith(MAGIC), F.substr("text", F.lit(len(MAGIC) + 1))).otherwise(F.col("text"))
        joined = true.where("not whole").drop("payload_bytes", "payload_digest").join(parts.withColumnRenamed("owner", "offset"), ["file", "offset"])
        joined = joined.withColumn("text", text).withColumn("rest", rest)
        joined = joined.withColumn("block", F.expr("substring(cast(rest as binary), cast(head_bytes + 1 as int), cast(least(length, 2147483647) as int))"))
        size, digest = _digests(F.col("block"), F.lit(True))
        joined = joined.withColumns({"payload_bytes": size, "payload_digest": digest})
        if with_payload:
            http = F.octet_length(F.substring_index(F.col("block").cast("string"), END, 1)) + len(END)
            joined = joined.withColumn("payload", F.substr("block", http + 1).cast("string"))
        out = out.unionByName(joined.select(*out.columns))
    revisit = F.col("kind") == "revisit"
    return out.select(
        F.when(F.col("page") != "", F.col("page").cast("bigint")).alias("page_id"),
        "url",
        F.col("kind").alias("record_type"),
        F.when(revisit, F.col("refers").cast("bigint")).alias("refers_to"),
        F.when(revisit, F.col("said_bytes").cast("bigint")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        *(["payload"] if with_payload else []),
    )
