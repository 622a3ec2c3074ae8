"""Plausible future paths, the worlds they make, and holds judged across those worlds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import RATIO, intervention_id, iso
from weirflow.operators import counterfactual, taint
from weirflow.operators.scan import active, seeds_in
from weirflow.operators.traverse import cut_lineage, upstream


def history(transfers: DataFrame, times: DataFrame) -> DataFrame:
    """What is known at each case's time."""
    return active(transfers).join(times.select("case_id", "as_of"), "case_id").where("occurred_at <= as_of").drop("as_of")


def active_sources(transfers: DataFrame, seeds: DataFrame, times: DataFrame) -> DataFrame:
    """``case_id, account, amount``: accounts that hold taint at the time, from seeds that have happened."""
    known = history(transfers, times)
    held = taint.tainted_accounts(taint.allocations(known, seeds_in(seeds, known)))
    return held.select("case_id", "account", F.col("tainted").alias("amount"))


def beam_paths(hops: DataFrame | Callable[[DataFrame], DataFrame], sources: DataFrame, ancestors: DataFrame, times: DataFrame, top_k: int = 3, max_depth: int = 3, hop_seconds: int = 300, min_probability: float = 0.01) -> DataFrame:
    """Likely paths of each case: ``path_rank, path_id, source, amount, accounts, probabilities, cumulative, hops``.

    ``hops``: ``case_id, source, candidate, rank, probability`` of at least
    ``2 * top_k`` ranks, or a function that gives them for the accounts
    (``case_id, account``) that a level has reached. Every source keeps ``top_k`` partial paths a level and
    never returns to an account it came from or money came through. A path ends
    at a dead end or at ``max_depth``; paths that leave the beam are dropped.
    """
    likely = lambda h: cut_lineage(h.where((F.col("rank") <= 2 * top_k) & (F.col("probability") >= min_probability)).select("case_id", F.col("source").alias("at"), "candidate", "probability"))
    step = None if callable(hops) else likely(hops)
    behind = ancestors.groupBy("case_id", "account").agg(F.collect_set("ancestor").alias("behind"))
    start = sources.where("amount > 0").join(behind, ["case_id", "account"], "left")
    kind = dict(sources.dtypes)["account"]
    beam = start.select(
        "case_id", F.col("account").alias("source"), "amount", F.col("account").alias("at"), F.lit(1.0).alias("cumulative"),
        F.array("account").alias("accounts"), F.array().cast("array<double>").alias("probabilities"),
        F.array_append(F.coalesce("behind", F.array().cast(f"array<{kind}>")), F.col("account")).alias("visited"),
    )
    done = None
    for depth in range(1, max_depth + 1):
        beam = cut_lineage(beam)
        if callable(hops):
            step = likely(hops(beam.select("case_id", F.col("at").alias("account")).distinct()))
        grown = beam.join(step, ["case_id", "at"]).where("NOT array_contains(visited, candidate)")
        expand = Window.partitionBy("case_id", "accounts").orderBy(F.desc("probability"), "candidate")
        grown = grown.withColumn("n", F.row_number().over(expand)).where(F.col("n") <= top_k).drop("n")
        grown = cut_lineage(
            grown.select(
                "case_id", "source", "amount", F.col("candidate").alias("at"), (F.col("cumulative") * F.col("probability")).alias("cumulative"),
                F.array_append("accounts", F.col("candidate")).alias("accounts"), F.array_append("probabilities", F.col("probability")).alias("probabilities"),
                F.array_append("visited", F.col("candidate")).alias("visited"),
            )
        )
        prefix = grown.select("case_id", F.slice("accounts", 1, depth).alias("accounts")).distinct()
        dead = beam.join(prefix, ["case_id", "accounts"], "left_anti").where(F.size("probabilities") > 0)
        keep = Window.partitionBy("case_id", "source").orderBy(F.desc("cumulative"), "accounts")
        beam = grown.withColumn("n", F.row_number().over(keep)).where(F.col("n") <= top_k).drop("n")
        ended = dead if depth < max_depth else dead.unionByName(beam)
        done = ended if done is None else done.unionByName(ended)
    best = Window.partitionBy("case_id").orderBy(F.desc("cumulative"), F.size("probabilities"), "accounts")
    found = done.withColumn("path_rank", F.row_number().over(best)).where(F.col("path_rank") <= top_k).join(times.select("case_id", "as_of"), "case_id")
    sequence = F.array_join(F.transform("accounts", lambda a: a.cast("string")), "->")
    digest = F.sha2(F.concat_ws(":", F.col("source").cast("string"), sequence, iso(F.col("as_of"))), 256)
    later = lambda i: F.timestamp_add("SECOND", (i + 1) * hop_seconds, F.col("as_of"))
    hop = F.transform(
        "probabilities",
        lambda p, i: F.struct(F.element_at("accounts", (i + 1).cast("int")).alias("sender"), F.element_at("accounts", (i + 2).cast("int")).alias("receiver"), p.alias("probability"), later(i).alias("occurred_at")),
    )
    return found.select("case_id", "path_rank", F.concat(F.lit("path-"), F.substring(digest, 1, 12)).alias("path_id"), "source", "amount", "accounts", "probabilities", "cumulative", hop.alias("hops"))


def path_events(paths: DataFrame, first_event_id: int = 1 << 40) -> DataFrame:
    """The hops of ``paths`` as forecast transfers of their worlds.

    Event ids are numbers above every observed one; ``event_key`` is a name from
    the path's digest that is the same in every run.
    """
    hops = paths.select("case_id", "path_rank", "path_id", "amount", F.posexplode("hops").alias("i", "h"))
    key = F.substring(F.sha2(F.concat_ws(":", "path_id", (F.col("i") + 1).cast("string"), F.col("h.sender").cast("string"), F.col("h.receiver").cast("string")), 256), 1, 8)
    number = (F.lit(first_event_id) + F.col("path_rank") * 1000 + F.col("i")).cast("bigint")
    return hops.select(
        "case_id", "path_rank", number.alias("event_id"), F.concat_ws("-", F.lit("fc-txn"), F.substring("path_id", 6, 12), F.col("i") + 1).alias("transaction_id"),
        number.alias("ingest_seq"), F.col("h.sender").alias("sender"), F.col("h.receiver").alias("receiver"), F.col("amount").alias("amount_minor_units"),
        F.col("h.occurred_at").alias("occurred_at"), F.lit("completed").alias("status"), F.col("h.probability").alias("probability"),
        F.concat(F.lit("fc-evt-"), key).alias("event_key"),
    )


def scenarios(transfers: DataFrame, paths: DataFrame, seeds: DataFrame, times: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Worlds of history and one path each: their transfers, seeds, times and weights; a world is a case ``case#rank``."""
    known = history(transfers, times)
    world = F.concat_ws("#", "case_id", F.col("path_rank").cast("string"))
    columns = ["case_id", "event_id", "transaction_id", "ingest_seq", "sender", "receiver", "amount_minor_units", "occurred_at", "status"]
    ranks = paths.select("case_id", "path_rank")
    past = known.join(ranks, "case_id").withColumn("case_id", world).select(*columns)
    hops = path_events(paths).withColumn("case_id", world).select(*columns)
    in_world = lambda d: d.join(ranks, "case_id").withColumn("case_id", world).drop("path_rank")
    total = Window.partitionBy("case_id")
    weight = F.when(F.sum("cumulative").over(total) > 0, F.try_divide(F.col("cumulative"), F.sum("cumulative").over(total))).otherwise(1.0 / F.count("*").over(total))
    weights = paths.select(F.col("case_id").alias("of_case"), "path_rank", weight.alias("weight"), F.size("hops").alias("horizon")).withColumn("case_id", F.concat_ws("#", "of_case", F.col("path_rank").cast("string")))
    return past.unionByName(hops), in_world(seeds_in(seeds, known)), in_world(times), weights


def forecast_candidates(sources: DataFrame, paths: DataFrame, event_type: str = "bigint", edge_holds: bool = False) -> DataFrame:
    """Account holds on accounts tainted now or on a path, and, if asked for, edge holds on forecast hops."""
    on_path = paths.select("case_id", F.explode("accounts").alias("account"))
    accounts = sources.where("amount > 0").select("case_id", "account").unionByName(on_path).distinct()
    out = accounts.select("case_id", F.lit("account_hold").alias("kind"), F.col("account").alias("target_account"), F.lit(None).cast(event_type).alias("target_event"))
    if edge_holds:
        kind = dict(sources.dtypes)["account"]
        out = out.unionByName(path_events(paths).select("case_id", F.lit("edge_hold").alias("kind"), F.lit(None).cast(kind).alias("target_account"), F.col("event_id").alias("target_event")))
    return out


def evaluate(transfers: DataFrame, seeds: DataFrame, paths: DataFrame, candidates: DataFrame, times: DataFrame) -> DataFrame:
    """One row per candidate over its case's worlds: expected, worst and best figures.

    Expectations are exact decimals rounded half up. The legitimate figure of
    the row is the worst case, the intercepted one the expectation. ``status``
    is ``ready``, or says why there is no forecast (all figures zero).
    """
    moves, world_seeds, world_times, weights = scenarios(transfers, paths, seeds, times)
    moves, world_seeds, world_times = cut_lineage(moves), cut_lineage(world_seeds), cut_lineage(world_times)
    baseline = cut_lineage(taint.allocations(moves, world_seeds))
    in_world = candidates.join(weights.select(F.col("of_case").alias("case_id"), F.col("case_id").alias("world")), "case_id").withColumn("case_id", F.col("world")).drop("world")
    named = counterfactual.with_id(in_world, world_times)
    results = counterfactual.outcomes(moves, world_seeds, baseline, named, world_times).join(weights, "case_id")
    expected = lambda c: F.round(F.sum(F.col("weight").cast(RATIO) * F.col(c).cast("decimal(19,0)")), 0).cast("bigint")
    keys = [F.col("of_case").alias("case_id"), "kind", "target_account", "target_event"]
    ready = results.groupBy(*keys).agg(
        F.count("*").alias("futures"), F.max("horizon").alias("horizon"),
        expected("intercepted").alias("expected_intercepted"), F.min("intercepted").alias("worst_intercepted"), F.max("intercepted").alias("best_intercepted"),
        expected("legitimate").alias("expected_legitimate"), F.max("legitimate").alias("worst_legitimate"), F.min("legitimate").alias("best_legitimate"),
        expected("remaining").alias("remaining"), expected("affected_accounts").alias("affected_accounts"), expected("affected_edges").alias("affected_edges"),
        F.min("provenance_confidence").alias("provenance_confidence"), F.sum(F.col("weight") * F.col("provenance_coverage")).alias("provenance_coverage"),
        F.sum(F.when(F.col("intercepted") > 0, F.col("weight")).otherwise(0.0)).alias("effective_probability"),
    )
    with_paths = paths.select("case_id").distinct().withColumn("has_paths", F.lit(True))
    with_taint = active_sources(transfers, seeds, times).where("amount > 0").select("case_id").distinct().withColumn("has_taint", F.lit(True))
    same = (F.col("c.kind") == F.col("r.kind")) & F.col("c.target_account").eqNullSafe(F.col("r.target_account")) & F.col("c.target_event").eqNullSafe(F.col("r.target_event"))
    joined = candidates.alias("c").join(ready.alias("r"), (F.col("c.case_id") == F.col("r.case_id")) & same, "left")
    joined = joined.select("c.*", *(F.col(f"r.{n}") for n in ready.columns[4:])).join(with_paths, "case_id", "left").join(with_taint, "case_id", "left").join(times.select("case_id", "as_of"), "case_id")
    status = F.when(F.col("has_paths"), "ready").when(F.col("has_taint"), "no_candidate_paths").otherwise("insufficient_evidence")
    zero = lambda n: F.coalesce(n, F.lit(0)).alias(n)
    target = F.coalesce(F.col("target_account").cast("string"), F.col("target_event").cast("string"))
    return joined.select(
        "case_id", intervention_id(F.col("kind"), target, F.col("as_of")).alias("intervention_id"), "kind", "target_account", "target_event", status.alias("forecast_status"),
        *(zero(n) for n in ("futures", "horizon", "expected_intercepted", "worst_intercepted", "best_intercepted", "expected_legitimate", "worst_legitimate", "best_legitimate", "remaining", "affected_accounts", "affected_edges")),
        F.coalesce("expected_intercepted", F.lit(0)).alias("intercepted"), F.coalesce("worst_legitimate", F.lit(0)).alias("legitimate"),
        F.coalesce("provenance_coverage", F.lit(1.0)).alias("provenance_coverage"), F.coalesce("provenance_confidence", F.lit(0.0)).alias("provenance_confidence"),
        F.coalesce("effective_probability", F.lit(0.0)).alias("effective_probability"),
    )


def paths_from(transfers: DataFrame, seeds: DataFrame, times: DataFrame, institutions: DataFrame | None = None, top_k: int = 3, max_depth: int = 3, hop_seconds: int = 300) -> tuple[DataFrame, DataFrame]:
    """``active_sources`` and ``beam_paths`` of each case with the heuristic next hop."""
    from weirflow.operators.features import predicted_next_hops

    known = history(transfers, times)
    sources = cut_lineage(active_sources(transfers, seeds, times))
    hops = lambda reached: predicted_next_hops(transfers, times, institutions, 2 * top_k, reached)
    return sources, cut_lineage(beam_paths(hops, sources, upstream(known, sources), times, top_k, max_depth, hop_seconds))
