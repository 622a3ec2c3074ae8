"""Evaluation of provenance and of intervention strategies against labelled worlds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.functions.columns import RATIO, benchmark_efficiency, rupees
from weirflow.operators import counterfactual, pareto, taint
from weirflow.operators.features import default_risk_scores
from weirflow.operators.scan import active
from weirflow.operators.traverse import cut_lineage


def world_summary(world: DataFrame) -> DataFrame:
    """Per family: transfers, accounts, volumes split by label, and the volume in rupees."""
    amount = F.col("amount_minor_units")
    sums = world.groupBy("family").agg(
        F.count("*").alias("transactions"), F.count_distinct("case_id").alias("cases"), F.sum(amount).alias("volume"),
        F.sum(F.when(F.col("mark") != "legit", amount).otherwise(0)).alias("fraud_volume"), F.sum(F.when(F.col("mark") == "legit", amount).otherwise(0)).alias("legit_volume"),
        F.count_if(F.col("mark") != "legit").alias("fraud_transactions"),
    )
    accounts = world.select("family", F.explode(F.array("sender", "receiver")).alias("a")).groupBy("family").agg(F.count_distinct("a").alias("accounts"))
    return sums.join(accounts, "family").withColumn("volume_text", rupees(F.col("volume")))


def institution_participation(transfers: DataFrame) -> DataFrame:
    """Legs and volume by institution; both legs of a transfer count."""
    legs = transfers.select(F.explode(F.array("sender_inst", "receiver_inst")).alias("institution"), "amount_minor_units")
    return legs.groupBy("institution").agg(F.count("*").alias("legs"), F.sum("amount_minor_units").alias("volume"))


def reach_sequence(allocated: DataFrame) -> DataFrame:
    """``case_id, account, reached``: the sequence at which an account first is downstream of a seed."""
    edges = cut_lineage(allocated.select("case_id", "sequence", "sender", "receiver", "is_seed"))
    now = cut_lineage(edges.where("is_seed").groupBy("case_id", F.col("receiver").alias("account")).agg(F.min("sequence").alias("reached")))
    fresh = now
    while not fresh.isEmpty():
        onward = edges.join(fresh.withColumnRenamed("account", "sender"), ["case_id", "sender"]).where("sequence > reached")
        found = onward.groupBy("case_id", F.col("receiver").alias("account")).agg(F.min("sequence").alias("reached"))
        better = found.alias("f").join(now.alias("n"), ["case_id", "account"], "left").where("n.reached IS NULL OR f.reached < n.reached").select("case_id", "account", F.col("f.reached").alias("reached"))
        fresh = cut_lineage(better)
        newer = fresh.withColumnRenamed("reached", "newer")
        now = cut_lineage(now.join(newer, ["case_id", "account"], "full_outer").select("case_id", "account", F.least("reached", "newer").alias("reached")))
    return now


def audit(world: DataFrame, allocated: DataFrame) -> DataFrame:
    """Each fraud edge with its taint, and a category where it has none."""
    marks = world.select("case_id", "event_id", "family", "mark")
    source = world.where("mark = 'seed'").select("case_id", F.col("sender").alias("origin")).distinct().withColumn("from_source", F.lit(True))
    edges = allocated.join(marks, ["case_id", "event_id"]).where("mark <> 'legit'")
    edges = edges.join(reach_sequence(allocated).withColumnRenamed("account", "sender"), ["case_id", "sender"], "left").join(source.withColumnRenamed("origin", "sender"), ["case_id", "sender"], "left")
    reachable = F.col("is_seed") | F.coalesce(F.col("reached") < F.col("sequence"), F.lit(False))
    # fixed values: category names
    category = (
        F.when(F.col("tainted") > 0, F.lit(None).cast("string"))
        .when(~reachable & (F.col("reached") > F.col("sequence")), "temporal ordering")
        .when(~reachable & (F.col("family") == "smurfing") & F.coalesce("from_source", F.lit(False)) & (F.col("mark") != "seed"), "evaluation-definition mismatch")
        .when(~reachable, "no upstream taint").when(F.col("tainted_before") == 0, "no upstream taint")
        .when(F.col("unattributed") > 0, "observable-balance shortfall").otherwise("actual implementation bug")
    )
    ever = F.col("is_seed") | F.col("reached").isNotNull()
    return edges.select("case_id", "family", "event_id", "sequence", "mark", "tainted", "clean", "unattributed", "contributions", "balance_before", reachable.alias("reachable"), ever.alias("ever_reachable"), category.alias("category"))


def coverage(world: DataFrame, allocated: DataFrame) -> DataFrame:
    """Per family: fraud edges, how many carry taint (all, seed-reachable, backed by balance), and attribution."""
    rows = audit(world, allocated)
    tainted = F.col("tainted") > 0
    backed = F.col("mark").eqNullSafe("seed") | (F.col("balance_before") > 0)
    own = F.size(F.filter("contributions", lambda c: ~c["source_id"].startswith(F.col("case_id")))) == 0
    count = lambda cond: F.count_if(cond)
    out = rows.groupBy("family").agg(
        F.count("*").alias("fraud_edges"), count(tainted).alias("tainted_edges"), count(F.col("ever_reachable")).alias("reachable_edges"),
        count(tainted & F.col("ever_reachable")).alias("tainted_reachable_edges"), count(backed).alias("backed_edges"), count(tainted & backed).alias("tainted_backed_edges"),
        count(tainted & own).alias("rightly_attributed"), count(tainted & (F.col("clean") > 0)).alias("commingled_edges"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumns({"raw_coverage": ratio("tainted_edges", "fraud_edges"), "reachable_coverage": ratio("tainted_reachable_edges", "reachable_edges"), "backed_coverage": ratio("tainted_backed_edges", "backed_edges")})


def branch_preservation(world: DataFrame, allocated: DataFrame) -> DataFrame:
    """Per case: distinct fraud branches (sender, receiver), and how many carried taint."""
    want = world.where("mark <> 'legit'").select("case_id", "sender", "receiver").distinct()
    got = allocated.where("tainted > 0").select("case_id", "sender", "receiver").distinct().withColumn("kept", F.lit(1))
    return want.join(got, ["case_id", "sender", "receiver"], "left").groupBy("case_id").agg(F.count("*").alias("branches"), F.count("kept").alias("preserved"))


# fixed values: strategy names and the measure each maximises
BASELINES = {"highest_risk": "risk_score", "highest_tainted_balance": "tainted", "highest_transaction_value": "largest_later", "maximum_immediate_recovery": "intercepted"}
OWN = "pareto"


def strategies(world: DataFrame, seeds: DataFrame, times: DataFrame, limits: pareto.Limits = pareto.Limits()) -> tuple[DataFrame, DataFrame]:
    """Every strategy's choice in each case, and all evaluations (with ranks) they choose from."""
    allocated = cut_lineage(taint.allocations(world, seeds))
    options = cut_lineage(counterfactual.with_id(counterfactual.candidates(world, allocated, times), times))
    found = cut_lineage(counterfactual.outcomes(world, seeds, allocated, options, times).drop("accounts", "blocked_event_ids"))
    rows = cut_lineage(pareto.ranked(found, limits, named=False))
    target = ["case_id", "target_account"]
    named = lambda d, c: d.select("case_id", F.col("account").alias("target_account"), c)
    later = active(world).join(times.select("case_id", "as_of"), "case_id").where("occurred_at > as_of").groupBy("case_id", F.col("sender").alias("account")).agg(F.max("amount_minor_units").alias("largest_later"))
    wide = rows.join(named(default_risk_scores(world, times), "risk_score"), target, "left").join(named(taint.tainted_accounts(allocated), "tainted"), target, "left").join(named(later, "largest_later"), target, "left")
    picks = wide.where("selected").withColumn("strategy", F.lit(OWN)).drop("n")
    for name, measure in BASELINES.items():
        picks = picks.unionByName(pareto.baseline_choice(wide, measure, name != "maximum_immediate_recovery").withColumn("strategy", F.lit(name)))
    cold = world.groupBy("case_id").agg(F.max(F.col("family") == "cold_start").alias("cold_start")) if "family" in world.columns else None
    return cut_lineage(choices(picks, times if cold is None else times.join(cold, "case_id", "left"), rows)), rows


def choices(picks: DataFrame, cases: DataFrame, evaluations: DataFrame | None = None) -> DataFrame:
    """A row per case and strategy from ``picks`` (``case_id, strategy`` and an evaluation); a strategy without a pick has zeros.

    ``tie_count``: feasible rows of the case's ``evaluations`` that intercept and
    affect as much as the pick, itself included. ``cold_start`` is that of ``cases``.
    """
    kept = ["case_id", "strategy", "intervention_id", "intercepted", "legitimate", "affected_accounts", "affected_edges", "pareto_rank"]
    names = picks.sparkSession.createDataFrame([(n,) for n in (*BASELINES, OWN)], "strategy string")
    cold = F.coalesce("cold_start", F.lit(False)) if "cold_start" in cases.columns else F.lit(False)
    every = cases.select("case_id", cold.alias("cold_start")).join(F.broadcast(names))  # five names
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    chosen = every.join(picks.select(kept), ["case_id", "strategy"], "left")
    if evaluations is None:
        chosen = chosen.withColumn("tie_count", F.lit(0).cast("bigint"))
    else:
        alike = evaluations.where("feasible").groupBy("case_id", "intercepted", "legitimate").agg(F.count("*").alias("tie_count"))
        chosen = chosen.join(alike, ["case_id", "intercepted", "legitimate"], "left")
    return chosen.select("case_id", "strategy", "cold_start", zero("tie_count"), "intervention_id", F.col("intervention_id").isNotNull().alias("feasible"), *(zero(n) for n in kept[3:7]), F.coalesce(F.col("pareto_rank") == 0, F.lit(False)).alias("pareto_efficient"), benchmark_efficiency(F.col("intercepted"), F.col("legitimate")).alias("efficiency"))


def strategy_totals(chosen: DataFrame) -> DataFrame:
    """Per strategy: sums over cases, compliance and the number of Pareto-efficient choices."""
    out = chosen.groupBy("strategy").agg(
        F.count("*").alias("scenarios"), F.count_if("feasible").alias("feasible"), F.sum("intercepted").alias("recovery"), F.sum("legitimate").alias("collateral"),
        F.sum("affected_accounts").alias("accounts"), F.sum("affected_edges").alias("edges"), F.count_if("pareto_efficient").alias("pareto_efficient"),
        F.count_if("cold_start").alias("cold_start_scenarios"),
    )
    compliance = (F.col("feasible").cast(RATIO) / F.col("scenarios").cast(RATIO)).cast("decimal(10,6)")
    return out.withColumn("efficiency", benchmark_efficiency(F.col("recovery"), F.col("collateral"))).withColumn("compliance", compliance)


def advantages(chosen: DataFrame) -> DataFrame:
    """The Pareto choice against each baseline, case by case."""
    own = chosen.where(F.col("strategy") == OWN).select("case_id", F.col("intercepted").alias("i"), F.col("legitimate").alias("l"), F.col("efficiency").alias("e"))
    rest = chosen.where(F.col("strategy") != OWN)
    return rest.join(own, "case_id").select(
        "case_id", "strategy", (F.col("i") - F.col("intercepted")).alias("recovery_advantage"), (F.col("legitimate") - F.col("l")).alias("collateral_reduction"), (F.col("e") - F.col("efficiency")).alias("efficiency_improvement")
    )


def findings(chosen: DataFrame) -> DataFrame:
    """Sorted labels of what stands out in each case."""
    ties = chosen.groupBy("case_id").agg(F.max("tie_count").alias("ties"))
    p = chosen.groupBy("case_id").pivot("strategy", [*BASELINES, OWN]).agg(F.first("feasible").alias("ok"), F.first("intercepted").alias("i"), F.first("legitimate").alias("l")).join(ties, "case_id")
    c = F.col
    best = "maximum_immediate_recovery"
    any_free = F.lit(False)
    for s in (*BASELINES, OWN):
        any_free = any_free | (c(f"{s}_ok") & (c(f"{s}_l") == 0))
    # fixed values: finding labels
    rules = [
        ("highest_risk_loses_to_taint", c("highest_risk_ok") & c("highest_tainted_balance_ok") & (c("highest_risk_i") < c("highest_tainted_balance_i"))),
        ("maximum_recovery_has_more_collateral", c(f"{best}_ok") & c(f"{OWN}_ok") & (c(f"{best}_l") > c(f"{OWN}_l"))),
        ("pareto_lower_recovery", c(f"{best}_ok") & c(f"{OWN}_ok") & (c(f"{OWN}_i") < c(f"{best}_i"))),
        ("no_feasible_intervention", ~c(f"{OWN}_ok")),
        ("multiple_strategies_tie", c("ties") > 1),
        ("zero_collateral_intervention", any_free),
    ]
    return p.select("case_id", F.array_sort(F.array_compact(F.array(*(F.when(r, F.lit(n)) for n, r in rules)))).alias("findings"))


# fixed values: strategy names of the forecast benchmark
OBSERVED, FORECAST = "observed_future", "forecast_aware"


def forecast_comparison(observed: DataFrame, forecast: DataFrame, realized: DataFrame, cases: DataFrame) -> DataFrame:
    """Choices with the observed future at hand and by forecast only: a row per case and strategy, with notes.

    ``observed``: the chosen outcome of each case; ``forecast``: the chosen
    forecast-aware row; ``realized``: outcomes of holds (``case_id,
    intervention_id``) in the observed future; ``cases``: all that count.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    one = cases.select("case_id").join(observed.select("case_id", F.col("intervention_id").alias("o"), F.col("intercepted").alias("oi"), F.col("legitimate").alias("ol")), "case_id", "left")
    two = forecast.select("case_id", F.col("intervention_id").alias("f"), "expected_intercepted", "worst_intercepted", "expected_legitimate", "worst_legitimate", "effective_probability")
    three = realized.select("case_id", F.col("intervention_id").alias("f"), F.col("intercepted").alias("ri"), F.col("legitimate").alias("rl"))
    both = one.join(two, "case_id", "left").join(three, ["case_id", "f"], "left")
    has_o, has_f = F.col("o").isNotNull(), F.col("f").isNotNull()
    ri, oi = F.coalesce("ri", F.lit(0)), F.coalesce("oi", F.lit(0))
    # fixed values: comparison notes
    notes = F.array_compact(F.array(
        F.lit("observed_oracle_reference"),
        F.when(has_o & has_f & (ri == oi), "identical_realized_recovery"),
        F.when(has_o & has_f & (ri < oi), "forecast_underperforms_due_to_prediction_gap"),
        F.when(has_o & has_f & (ri > oi), "forecast_exceeds_observed"),
        F.when(has_o & has_f & (F.col("worst_legitimate") > F.col("ol")), "forecast_guards_worst_case_collateral"),
        F.when(~has_o & ~has_f, "both_infeasible_or_negative_control"),
        F.when(has_o & ~has_f, "forecast_conservative_infeasibility"),
    ))
    row = lambda name, ok, *v: F.struct(
        F.lit(name).alias("strategy"), ok.alias("feasible"), F.col("o" if name == OBSERVED else "f").alias("intervention_id"),
        *(zero(F.col(c)).alias(n) for c, n in zip(v, ("expected_recovery", "worst_recovery", "realized_recovery", "expected_collateral", "worst_collateral", "realized_collateral"))),
        F.when(ok, F.lit(1.0) if name == OBSERVED else F.coalesce("effective_probability", F.lit(0.0))).otherwise(0.0).alias("stability"),
    )
    pair = F.array(row(OBSERVED, has_o, "oi", "oi", "oi", "ol", "ol", "ol"), row(FORECAST, has_f, "expected_intercepted", "worst_intercepted", "ri", "expected_legitimate", "worst_legitimate", "rl"))
    return both.select("case_id", notes.alias("notes"), F.explode(pair).alias("r")).select("case_id", "r.*", "notes")


def forecast_totals(compared: DataFrame) -> DataFrame:
    """Per strategy of ``forecast_comparison``: sums over cases, and the mean stability to four decimals."""
    sums = ("expected_recovery", "worst_recovery", "realized_recovery", "expected_collateral", "worst_collateral", "realized_collateral")
    return compared.groupBy("strategy").agg(F.count("*").alias("scenarios"), F.count_if("feasible").alias("feasible"), *(F.sum(c).alias(c) for c in sums), F.bround(F.avg("stability"), 4).alias("mean_stability"))
