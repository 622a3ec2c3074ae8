"""Labelled synthetic worlds: ten scenario families, any number of worlds, made on the executors.

A family is a short list of hops between roles. A world is every hop of every
family with account ids, times and amounts that depend on (seed, world, family)
only through hashes, so rows are the same however they are partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HISTORY_DAYS = 10


def _hops(family: str) -> list[tuple[str, str, int, float, str]]:
    """(sender role, receiver role, minute, share of the injected amount, mark): mark is seed, fraud or legit."""
    chain = lambda roles, start, gap, keep=0.99: [
        (a, b, start + i * gap, keep**i, "seed" if i == 0 else "fraud") for i, (a, b) in enumerate(zip(roles, roles[1:]))
    ]
    fan = lambda hub, spokes, start, mark="fraud": [(hub, s, start + i, 0.97 / len(spokes), mark) for i, s in enumerate(spokes)]
    meet = lambda spokes, hub, start: [(s, hub, start + i, 0.96 / len(spokes), "fraud") for i, s in enumerate(spokes)]
    past = lambda role, n: [("shop" + str(i % 2), role, -1440 * (i + 1), 0.02 + 0.005 * i, "legit") for i in range(n)]
    mules = [f"mule{i}" for i in range(4)]
    if family == "simple_chain":
        return past("mule0", 4) + chain(["victim", "mule0", "mule1", "exit"], 0, 12)
    if family == "fan_out":
        return past("mule0", 3) + chain(["victim", "mule0"], 0, 1) + fan("mule0", mules[1:], 6)
    if family == "fan_in":
        return [(f"victim{i}", f"mule{i}", i, 1 / 3, "seed") for i in range(3)] + meet(mules[:3], "exit", 20)
    if family == "fan_out_fan_in":
        return chain(["victim", "mule0"], 0, 1) + fan("mule0", mules[1:], 5) + meet(mules[1:], "exit", 25)
    if family == "commingling":
        return past("mule0", 5) + [("employer", "mule0", -60, 1.0, "legit"), ("victim", "mule0", 0, 1.0, "seed"), ("mule0", "exit", 15, 1.2, "fraud"), ("mule0", "landlord", 18, 0.3, "legit")]
    if family == "cold_start":
        return chain(["victim", "fresh0", "fresh1"], 0, 4)
    if family == "cross_bank":
        return past("mule1", 3) + chain(["victim", "mule0", "mule1", "mule2", "exit"], 0, 9)
    if family == "smurfing":
        return [("victim", m, i * 7, 0.25, "seed" if i == 0 else "fraud") for i, m in enumerate(mules)]
    if family == "rapid_pass_through":
        return past("mule0", 2) + chain(["victim", "mule0", "mule1"], 0, 1)
    if family == "benign_high_volume_merchant":
        return [(f"buyer{i % 6}", "merchant", i * 11, 0.03 + 0.002 * i, "legit") for i in range(18)] + [("merchant", "supplier", 240, 0.2, "legit")]
    raise ValueError(f"unknown family {family}")


FAMILIES = ("simple_chain", "fan_out", "fan_in", "fan_out_fan_in", "commingling", "cold_start", "cross_bank", "smurfing", "rapid_pass_through", "benign_high_volume_merchant")


def synthetic_world(spark: SparkSession, seed: int = 42, worlds: int = 1, families: tuple[str, ...] = FAMILIES, base_time: str = "2026-01-01 09:00:00", partitions: int | None = None) -> DataFrame:
    """Transfers with ``family``, ``mark`` and ``world``; one case per (world, family).

    Account ids are ``family-bank-role-number`` text; fraud legs keep a fee at every hop.
    """
    template = spark.createDataFrame(
        [(f, n, i, *h) for n, f in enumerate(families) for i, h in enumerate(_hops(f))], "family string, n int, hop int, s string, r string, minute int, share double, mark string"
    )
    rows = spark.range(0, worlds, 1, partitions or max(1, min(worlds, spark.sparkContext.defaultParallelism))).withColumnRenamed("id", "world")
    rows = rows.join(F.broadcast(template))  # a fixed list of about a hundred hops
    noise = lambda name, *c: F.pmod(F.xxhash64(F.lit(seed), "world", "family", F.lit(name), *c), F.lit(1_000_000)) / 1e6
    bank = lambda role: F.substr(F.lit("ABCD"), (F.pmod(F.xxhash64(F.lit(seed), "world", "family", role), F.lit(4)) + 1).cast("int"), F.lit(1))
    account = lambda role: F.concat(F.lit("acc-"), bank(role), F.lit("-"), F.col("family"), F.lit("-"), F.col(role), F.lit("-"), F.lpad(F.col("world").cast("string"), 4, "0"))
    injected = F.lit(5_000_000) + F.floor(noise("amount") * 95_000_000)
    start = F.timestamp_add("SECOND", F.col("world") * 86_400 + F.floor(noise("start") * 3_600) + F.col("n") * 7_200, F.to_timestamp_ntz(F.lit(base_time)))
    when = F.timestamp_add("SECOND", (F.col("minute") * 60 + F.floor(noise("jitter", "hop") * 30)).cast("bigint"), start)
    case = F.concat(F.lit("case-"), "family", F.lit("-"), F.lpad(F.col("world").cast("string"), 4, "0"))
    made = rows.select(
        case.alias("case_id"), "world", "family", "mark", "hop",
        (F.col("world") * 10_000 + F.col("n") * 100 + F.col("hop")).cast("bigint").alias("event_id"),
        account("s").alias("sender"), account("r").alias("receiver"), F.greatest(F.lit(1_000), F.floor(injected * F.col("share"))).cast("bigint").alias("amount_minor_units"),
        F.lit("INR").alias("currency"), when.alias("occurred_at"), F.lit("completed").alias("status"), F.lit("upi").alias("channel"), F.lit("synthetic").alias("origin"),
        bank("s").alias("sender_bank"), bank("r").alias("receiver_bank"),
    )
    return made.select(
        "*", F.concat(F.lit("txn-"), F.col("event_id")).alias("transaction_id"), F.col("event_id").alias("ingest_seq"), F.timestamp_add("SECOND", F.lit(2), F.col("occurred_at")).alias("observed_at"),
        F.concat(F.lit("BANK_"), "sender_bank").alias("sender_inst"), F.concat(F.lit("BANK_"), "receiver_bank").alias("receiver_inst"),
    ).drop("sender_bank", "receiver_bank")


def world_seeds(world: DataFrame) -> DataFrame:
    """The marked seeds, wholly tainted."""
    return world.where("mark = 'seed'").select("case_id", "transaction_id", F.col("amount_minor_units").alias("tainted_amount"), F.concat_ws(":", "case_id", "transaction_id").alias("source_id"))


def world_truth(world: DataFrame) -> DataFrame:
    """Per case: family, seed and fraud transactions, fraud accounts, next hops and injected amount."""
    bad = F.col("mark") != "legit"
    ids = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("transaction_id"))))
    return world.groupBy("case_id", "family").agg(
        ids(F.col("mark") == "seed").alias("seed_transaction_ids"), ids(bad).alias("fraud_transaction_ids"),
        F.array_sort(F.collect_set(F.when(bad, F.col("receiver")))).alias("fraud_accounts"),
        F.array_sort(F.collect_set(F.when(bad, F.struct("sender", "receiver")))).alias("branches"),
        F.coalesce(F.sum(F.when(F.col("mark") == "seed", F.col("amount_minor_units"))), F.lit(0)).alias("injected_amount"),
    )


def world_times(world: DataFrame) -> DataFrame:
    """Each case's decision time: its first seed, else its first event."""
    seed = F.min(F.when(F.col("mark") == "seed", F.col("occurred_at")))
    return world.groupBy("case_id").agg(F.coalesce(seed, F.min("occurred_at")).alias("as_of"))
