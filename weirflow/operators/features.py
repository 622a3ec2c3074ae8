"""Point-in-time account features, pairwise next-hop features and the heuristic next hop.

All accounts of all cases are computed together: one pass over the legs, one
window sort for pass-through delays. Nothing later than the as-of time is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.motifs import next_out
from weirflow.operators.scan import active, legs
from weirflow.operators.traverse import cut_lineage, upstream

# fixed values: defaults where nothing was observed, and thresholds
NO_PASS_SECONDS = 86_400.0
NO_CONTACT_SECONDS = 86_400.0 * 30
RAPID_SECONDS = 300.0
ACCOUNT_FEATURES = (
    "in_degree", "out_degree", "total_degree", "unique_senders", "unique_receivers", "unique_counterparties",
    "bilateral_counterparties", "fan_in_ratio", "fan_out_ratio", "institution_diversity", "cross_institution_tx_ratio",
    "lifespan_seconds", "active_duration_seconds", "tx_velocity_per_hour", "min_pass_through_seconds",
    "median_pass_through_seconds", "has_rapid_pass_through", "tx_count_last_1h", "tx_count_last_24h", "burst_ratio_1h",
    "time_since_last_tx_seconds", "total_inbound_amount", "total_outbound_amount", "net_flow_amount", "forwarding_ratio",
    "mean_inbound_amount", "mean_outbound_amount", "max_inbound_amount", "max_outbound_amount",
    "inbound_outbound_amount_ratio", "historical_tx_count", "historical_duration_seconds", "has_historical_profile",
    "is_cold_start", "evidence_maturity_level",
)


def micros(c: Column | str) -> Column:
    return F.unix_micros(F.to_timestamp_ltz(F.col(c) if isinstance(c, str) else c))


def _seconds(c: Column) -> Column:
    return c.cast("double") / 1e6


def _positive(c: Column) -> Column:
    """Negative to zero, null to null."""
    return F.when(c < 0, 0.0).otherwise(c)


def _per(a: Column, b: Column) -> Column:
    """a / max(1, b)."""
    return a.cast("double") / F.greatest(F.lit(1.0), b.cast("double"))


def account_features(transfers: DataFrame, times: DataFrame, institutions: DataFrame | None = None) -> DataFrame:
    """One row per (``case_id``, ``account``) seen up to its case's time.

    ``times``: ``case_id, as_of`` and optionally ``history_cutoff`` (default:
    24 hours before). ``institutions``: ``account, institution``.
    """
    cut = F.col("history_cutoff") if "history_cutoff" in times.columns else F.lit(None).cast("timestamp_ntz")
    times = times.select("case_id", "as_of", F.coalesce(cut, F.expr("as_of - INTERVAL 24 HOURS")).alias("history_cutoff"))
    known = active(transfers).join(times, "case_id").where("occurred_at <= as_of")
    rows = legs(known)
    if institutions is not None:
        names = institutions.select(F.col("account"), F.col("institution").alias("own"))
        rows = rows.join(names, "account", "left").join(names.select(F.col("account").alias("counterparty"), F.col("own").alias("other")), "counterparty", "left")
    else:
        rows = rows.withColumns({"own": F.lit(None).cast("string"), "other": F.lit(None).cast("string")})
    inward, amount = F.col("direction") == "in", F.col("amount_minor_units")
    only = lambda cond, c: F.when(cond, c)
    past = F.col("occurred_at") < F.col("history_cutoff")
    counted = rows.groupBy("case_id", "account").agg(
        F.first("as_of").alias("as_of"), F.first("own").alias("own"),
        F.count_if(inward).alias("in_degree"), F.count_if(~inward).alias("out_degree"),
        F.count_distinct("other").alias("banks"), F.count_if(~F.col("own").eqNullSafe(F.col("other"))).alias("cross"),
        F.min("occurred_at").alias("first_at"), F.max("occurred_at").alias("last_at"),
        F.count_if(F.col("occurred_at") >= F.expr("as_of - INTERVAL 1 HOUR")).alias("last_1h"),
        F.count_if(F.col("occurred_at") >= F.expr("as_of - INTERVAL 24 HOURS")).alias("last_24h"),
        F.coalesce(F.sum(only(inward, amount)), F.lit(0)).alias("inbound"), F.coalesce(F.sum(only(~inward, amount)), F.lit(0)).alias("outbound"),
        F.coalesce(F.max(only(inward, amount)), F.lit(0)).alias("max_in"), F.coalesce(F.max(only(~inward, amount)), F.lit(0)).alias("max_out"),
        F.count_if(past).alias("old"), F.min(only(past, F.col("occurred_at"))).alias("old_first"), F.max(only(past, F.col("occurred_at"))).alias("old_last"),
    )
    delay = _seconds(F.col("delay_micros"))
    passed = next_out(known).groupBy("case_id", "account").agg(F.min(delay).alias("fastest"), F.percentile(delay, F.lit(0.5)).alias("middle"))
    # partners first, one row each, then counts: a hub's partners are never one row
    partners = rows.where("counterparty IS NOT NULL").groupBy("case_id", "account", "counterparty").agg(F.max(inward).alias("gives"), F.max(~inward).alias("takes"))
    partners = partners.groupBy("case_id", "account").agg(F.count_if("gives").alias("senders"), F.count_if("takes").alias("receivers"), F.count("*").alias("either"), F.count_if(F.col("gives") & F.col("takes")).alias("both"))
    c = counted.join(partners, ["case_id", "account"], "left").join(passed, ["case_id", "account"], "left")
    total = F.col("in_degree") + F.col("out_degree")
    span = lambda a, b: _positive(_seconds(micros(a) - micros(b)))
    duration, old_duration = span("last_at", "first_at"), F.coalesce(span("old_last", "old_first"), F.lit(0.0))
    profile = (F.col("old") >= 3) & (old_duration >= 86_400.0)
    either = F.coalesce("either", F.lit(0))
    low, high = F.least("inbound", "outbound"), F.greatest("inbound", "outbound")
    values = {
        "in_degree": F.col("in_degree"), "out_degree": F.col("out_degree"), "total_degree": total,
        "unique_senders": F.coalesce("senders", F.lit(0)), "unique_receivers": F.coalesce("receivers", F.lit(0)), "unique_counterparties": either,
        "bilateral_counterparties": F.coalesce("both", F.lit(0)),
        "fan_in_ratio": _per(F.col("in_degree"), total), "fan_out_ratio": _per(F.col("out_degree"), total),
        "institution_diversity": F.col("banks"),
        "cross_institution_tx_ratio": F.when(F.col("own").isNotNull() & (either > 0), _per(F.col("cross"), total)).otherwise(0.0),
        "lifespan_seconds": span("as_of", "first_at"), "active_duration_seconds": duration,
        "tx_velocity_per_hour": _per(total, duration / 3600.0),
        "min_pass_through_seconds": F.coalesce("fastest", F.lit(NO_PASS_SECONDS)), "median_pass_through_seconds": F.coalesce("middle", F.lit(NO_PASS_SECONDS)),
        "has_rapid_pass_through": F.coalesce(F.col("fastest") <= RAPID_SECONDS, F.lit(False)).cast("int"),
        "tx_count_last_1h": F.col("last_1h"), "tx_count_last_24h": F.col("last_24h"), "burst_ratio_1h": _per(F.col("last_1h"), total),
        "time_since_last_tx_seconds": span("as_of", "last_at"),
        "total_inbound_amount": F.col("inbound"), "total_outbound_amount": F.col("outbound"), "net_flow_amount": F.col("inbound") - F.col("outbound"),
        "forwarding_ratio": F.when(F.col("inbound") > 0, F.least(F.lit(1.0), F.try_divide(F.col("outbound").cast("double"), F.col("inbound").cast("double")))).otherwise(0.0),
        "mean_inbound_amount": _per(F.col("inbound"), F.col("in_degree")), "mean_outbound_amount": _per(F.col("outbound"), F.col("out_degree")),
        "max_inbound_amount": F.col("max_in"), "max_outbound_amount": F.col("max_out"),
        "inbound_outbound_amount_ratio": F.when(high == 0, 1.0).otherwise(_per(low, high)),
        "historical_tx_count": F.col("old"), "historical_duration_seconds": old_duration,
        "has_historical_profile": profile.cast("int"), "is_cold_start": (F.col("old") == 0).cast("int"),
        "evidence_maturity_level": F.when(profile & (total >= 5), 2).when(total <= 1, 0).otherwise(1),
    }
    return c.select("case_id", "account", *(values[n].cast("double").alias(n) for n in ACCOUNT_FEATURES))


def _neighbours(known: DataFrame) -> DataFrame:
    return legs(known).select("case_id", "account", "counterparty").distinct()


def _nodes(known: DataFrame, institutions: DataFrame | None) -> DataFrame:
    """Legs, amounts, counterparties and institution of each account."""
    width = _neighbours(known).groupBy("case_id", "account").agg(F.count("*").alias("width"))
    side = lambda d: F.col("direction") == d
    node = legs(known).groupBy("case_id", "account").agg(
        F.count_if(side("in")).alias("ins"), F.count_if(side("out")).alias("outs"),
        F.coalesce(F.sum(F.when(side("in"), F.col("amount_minor_units"))), F.lit(0)).alias("inbound"),
        F.coalesce(F.sum(F.when(side("out"), F.col("amount_minor_units"))), F.lit(0)).alias("outbound"),
    )
    node = node.join(width, ["case_id", "account"])
    if institutions is not None:
        return node.join(institutions.select("account", "institution"), "account", "left")
    return node.withColumn("institution", F.lit(None).cast("string"))


def institution_candidates(transfers: DataFrame, times: DataFrame, institutions: DataFrame) -> DataFrame:
    """``case_id, institution, candidate`` and the features of its pairs with accounts that share the institution and nothing else: they follow from the candidate."""
    known = active(transfers).join(times.select("case_id", "as_of"), "case_id").where("occurred_at <= as_of")
    return _candidates(_nodes(known, institutions)).drop("candidate_width")


def _candidates(node: DataFrame, digits: int | None = None) -> DataFrame:
    node = node.where("institution IS NOT NULL")
    none = F.lit(0.0)
    values = {
        "past_transfers_count": none, "past_transfer_volume": none, "time_since_last_transfer_seconds": F.lit(NO_CONTACT_SECONDS), "shared_counterparties_count": none, "jaccard_similarity": none,
        "candidate_in_degree": F.col("ins"), "candidate_out_degree": F.col("outs"), "candidate_total_inbound": F.col("inbound"), "candidate_forwarding_ratio": _per(F.col("outbound"), F.col("inbound")), "same_institution": F.lit(1.0),
    }
    return node.select("case_id", "institution", F.col("account").alias("candidate"), F.col("width").alias("candidate_width"), *(_rounded(v, digits).alias(n) for n, v in values.items()))


def _rounded(value: Column, digits: int | None) -> Column:
    return value.cast("double") if digits is None else F.round(value.cast("double"), digits)


def next_hop_features(transfers: DataFrame, times: DataFrame, pairs: DataFrame | None = None, institutions: DataFrame | None = None, alike_alone: bool = True, digits: int | None = None) -> DataFrame:
    """Ten features of each (``case_id``, ``source``, ``candidate``).

    Without ``pairs``, all pairs with any evidence: a past transfer, a shared
    counterparty or a shared institution. Each kind is an equi-join; no pair
    of accounts is made without one. Pairs that share an institution alone have
    the candidate's features and constants: these are worked out (and rounded to ``digits``)
    once a candidate, and the pairs are made where they are
    returned and never shuffled, so only accounts and the other pairs are; without
    ``alike_alone`` they are left to ``institution_candidates``.
    """
    known = active(transfers).join(times.select("case_id", "as_of"), "case_id").where("occurred_at <= as_of")
    direct = known.groupBy("case_id", F.col("sender").alias("source"), F.col("receiver").alias("candidate")).agg(
        F.count("*").alias("sent"), F.sum("amount_minor_units").alias("volume"), F.max("occurred_at").alias("last_at")
    )
    near = _neighbours(known)
    shared = (
        near.select("case_id", F.col("account").alias("source"), "counterparty")
        .join(near.select("case_id", F.col("account").alias("candidate"), "counterparty"), ["case_id", "counterparty"])
        .groupBy("case_id", "source", "candidate").agg(F.count("*").alias("shared"))
    )
    node = _nodes(known, institutions)
    alike = None
    if pairs is None:
        keys = ["case_id", "source", "candidate"]
        pairs = direct.select(keys).unionByName(shared.select(keys)).distinct()
        if institutions is not None and alike_alone:
            alike = _same_institution(pairs, node, digits)
    pairs = pairs.where("source <> candidate")
    named = lambda p, cols: node.select("case_id", F.col("account").alias(p), *(F.col(c).alias(f"{p}_{c}") for c in cols))
    wide = (
        pairs.join(direct, ["case_id", "source", "candidate"], "left").join(shared, ["case_id", "source", "candidate"], "left")
        .join(named("source", ["width", "institution"]), ["case_id", "source"], "left")
        .join(named("candidate", ["width", "institution", "ins", "outs", "inbound", "outbound"]), ["case_id", "candidate"], "left")
        .join(times.select("case_id", "as_of"), "case_id")
    )
    zero = lambda n: F.coalesce(F.col(n), F.lit(0))
    union = zero("source_width") + zero("candidate_width") - zero("shared")
    values = {
        "past_transfers_count": zero("sent"), "past_transfer_volume": zero("volume"),
        "time_since_last_transfer_seconds": F.coalesce(_positive(_seconds(micros("as_of") - micros("last_at"))), F.lit(NO_CONTACT_SECONDS)),
        "shared_counterparties_count": zero("shared"), "jaccard_similarity": _per(zero("shared"), union),
        "candidate_in_degree": zero("candidate_ins"), "candidate_out_degree": zero("candidate_outs"), "candidate_total_inbound": zero("candidate_inbound"),
        "candidate_forwarding_ratio": _per(zero("candidate_outbound"), zero("candidate_inbound")),
        "same_institution": F.coalesce(F.col("source_institution") == F.col("candidate_institution"), F.lit(False)).cast("int"),
    }
    out = wide.select("case_id", "source", "candidate", *(_rounded(v, digits).alias(n) for n, v in values.items()))
    return out if alike is None else out.unionByName(alike.join(F.broadcast(times.select("case_id")), "case_id", "left_semi").select(*out.columns))


#: Shares of a case's and institution's sources, each of which meets all candidates in a task of its own.
SHARES = 16


def _same_institution(related: DataFrame, node: DataFrame, digits: int | None = None) -> DataFrame:
    """Pairs of accounts of one institution that are not ``related``, with their features."""
    keys = ["case_id", "institution", "__share"]
    n = int(node.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bank = node.where("institution IS NOT NULL")
    of = bank.select("case_id", F.col("account").alias("candidate"), F.col("institution").alias("bank"))
    left_out = related.join(of, ["case_id", "candidate"]).groupBy("case_id", F.col("source").alias("account"), F.col("bank").alias("institution")).agg(F.collect_set("candidate").alias("left_out"))
    sources = bank.select("case_id", "institution", "account").join(left_out, ["case_id", "account", "institution"], "left")
    sources = sources.select(*keys[:2], F.pmod(F.xxhash64("account"), F.lit(SHARES)).cast("int").alias("__share"), F.col("account").alias("source"), F.coalesce("left_out", F.array().cast(dict(left_out.dtypes)["left_out"])).alias("left_out"))
    every = _candidates(node, digits).withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = sources.repartition(n, *keys).join(every.repartition(n, *keys).hint("merge"), keys)
    met = met.where("source <> candidate AND NOT array_contains(left_out, candidate)")
    return met.drop("left_out", "__share", "institution")


def heuristic_next_hops(features: DataFrame, ancestors: DataFrame | None = None, top_k: int | None = 5, digits: int = 4) -> DataFrame:
    """``rank``, ``probability`` of each source's candidates by relational evidence.

    Candidates without evidence or upstream of the source are left out; a
    softmax over the rest; ties go to the smaller account.
    """
    if ancestors is not None:
        gone = ancestors.select("case_id", F.col("account").alias("source"), F.col("ancestor").alias("candidate"))
        features = features.join(gone, ["case_id", "source", "candidate"], "left_anti")
    evidence = F.col("past_transfers_count") * 2.0 + F.col("shared_counterparties_count") * 1.5 + F.col("same_institution") * 0.5
    pool = Window.partitionBy("case_id", "source")
    scored = features.withColumn("evidence", evidence).where("evidence > 0").withColumn("score", F.col("evidence") + F.col("candidate_in_degree") * 0.5)
    raised = F.exp(F.col("score") - F.max("score").over(pool))
    scored = scored.withColumn("raised", raised).withColumn("p", F.col("raised") / F.sum("raised").over(pool))
    order = pool.orderBy(F.desc(F.round("p", 12)), "candidate")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if top_k is not None:
        ranked = ranked.where(F.col("rank") <= top_k)
    return ranked.select("case_id", "source", "candidate", "rank", F.round("p", digits).alias("probability"))


def predicted_next_hops(transfers: DataFrame, times: DataFrame, institutions: DataFrame | None = None, top_k: int = 5, sources: DataFrame | None = None, digits: int = 4) -> DataFrame:
    """The heuristic next hops of ``sources`` (``case_id, account``; all accounts if not given), from transfers.

    As ``heuristic_next_hops`` over all pairs with evidence, but pairs that
    share nothing except an institution are not made. Their score depends on
    the candidate's in-degree alone: they enter the softmax as counts by
    in-degree, less those left out, and only the first ``top_k`` of them (after
    as many as are left out) become rows. Only asked sources get ancestors.
    """
    known = active(transfers).join(times.select("case_id", "as_of"), "case_id").where("occurred_at <= as_of").select("case_id", "sender", "receiver", "status")
    both = legs(known)
    node = both.groupBy("case_id", "account").agg(F.count_if(F.col("direction") == "in").alias("ins"))
    asked = (node if sources is None else sources).select("case_id", F.col("account").alias("source")).distinct()
    pair = ["case_id", "source", "candidate"]
    direct = known.withColumnsRenamed({"sender": "source", "receiver": "candidate"}).join(asked, ["case_id", "source"], "left_semi").select(*pair, F.lit(1).alias("sent"), F.lit(0).alias("shared"))
    near = both.select("case_id", "account", "counterparty").distinct()
    from_asked = near.withColumnRenamed("account", "source").join(asked, ["case_id", "source"], "left_semi")
    shared = from_asked.join(near.withColumnRenamed("account", "candidate"), ["case_id", "counterparty"]).select(*pair, F.lit(0).alias("sent"), F.lit(1).alias("shared"))
    related = direct.unionByName(shared).where("source <> candidate").groupBy(*pair).agg(F.sum("sent").alias("sent"), F.sum("shared").alias("shared"))
    ancestors = upstream(known, asked.withColumnRenamed("source", "account")).withColumnsRenamed({"account": "source", "ancestor": "candidate"})
    of = institutions.select("account", F.col("institution").alias("bank")).where("bank IS NOT NULL").distinct() if institutions is not None else None
    if of is None:
        related = related.withColumn("same", F.lit(0))
    else:
        named = lambda p: of.select(F.col("account").alias(p), F.col("bank").alias(f"{p}_bank"))
        related = related.join(named("source"), "source", "left").join(named("candidate"), "candidate", "left")
        related = related.withColumn("same", F.coalesce(F.col("source_bank") == F.col("candidate_bank"), F.lit(False)).cast("int"))
    score = F.col("sent") * 2.0 + F.col("shared") * 1.5 + F.col("same") * 0.5 + F.col("ins") * 0.5
    related = cut_lineage(related.join(node.withColumnRenamed("account", "candidate"), ["case_id", "candidate"]).select(*pair, score.alias("score")))
    open_ = related.join(ancestors.select(pair), pair, "left_anti")
    weights, rows = open_.select("case_id", "source", "score", F.lit(1).cast("bigint").alias("n")), open_
    if of is not None:
        inside = node.join(of, "account").select("case_id", "bank", "account", "ins")
        home = asked.join(of.withColumnRenamed("account", "source"), "source").select("case_id", "source", "bank")
        left_out = related.select(pair).unionByName(ancestors.select(pair)).unionByName(asked.select("case_id", "source", F.col("source").alias("candidate"))).distinct()
        left_out = left_out.join(home, ["case_id", "source"]).join(inside.withColumnRenamed("account", "candidate"), ["case_id", "bank", "candidate"])
        left_out = cut_lineage(left_out.select(*pair, "ins"))
        fewer = left_out.groupBy("case_id", "source", "ins").agg(F.count("*").alias("less"))
        counts = home.join(inside.groupBy("case_id", "bank", "ins").agg(F.count("*").alias("all")), ["case_id", "bank"]).join(fewer, ["case_id", "source", "ins"], "left")
        rest = F.col("all") - F.coalesce("less", F.lit(0))
        weights = weights.unionByName(counts.select("case_id", "source", (F.col("ins") * 0.5 + 0.5).alias("score"), rest.alias("n")).where("n > 0"))
        place = Window.partitionBy("case_id", "bank").orderBy(F.desc("ins"), "account")
        ranked = inside.select("case_id", "bank", F.col("account").alias("candidate"), (F.col("ins") * 0.5 + 0.5).alias("score"), F.row_number().over(place).alias("place"))
        skipped = left_out.groupBy("case_id", "source").agg(F.count("*").alias("skip"))
        reach = home.join(skipped, ["case_id", "source"], "left").select("case_id", "source", "bank", F.explode(F.sequence(F.lit(1), (F.coalesce("skip", F.lit(0)) + top_k).cast("int"))).alias("place"))
        rows = rows.unionByName(reach.join(ranked, ["case_id", "bank", "place"]).join(left_out.select(pair), pair, "left_anti").select(*pair, "score"))
    pool = weights.groupBy("case_id", "source", "score").agg(F.sum("n").alias("n")).groupBy("case_id", "source").agg(F.max("score").alias("top"), F.collect_list(F.struct("score", "n")).alias("pool"))
    total = F.aggregate(F.array_sort("pool"), F.lit(0.0), lambda a, x: a + x["n"] * F.exp(x["score"] - F.col("top")))
    order = Window.partitionBy("case_id", "source").orderBy(F.desc("score"), "candidate")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).join(pool.select("case_id", "source", "top", total.alias("total")), ["case_id", "source"])
    return best.select(*pair, "rank", F.round(F.exp(F.col("score") - F.col("top")) / F.col("total"), digits).alias("probability"))


def default_risk_scores(transfers: DataFrame, times: DataFrame) -> DataFrame:
    """``(2 out + in) / max(1, in + out)`` by number of legs up to the case's time."""
    known = active(transfers).join(times.select("case_id", "as_of"), "case_id").where("occurred_at <= as_of")
    out = F.when(F.col("direction") == "out", 2).otherwise(1)
    return legs(known).groupBy("case_id", "account").agg((F.sum(out).cast("double") / F.greatest(F.lit(1), F.count("*"))).alias("risk_score"))
