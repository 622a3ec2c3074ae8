"""A whole investigation: every stage as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.operators import chokepoint, counterfactual, forecast, pareto, risk, scan, taint
from weirflow.operators.features import account_features, predicted_next_hops
from weirflow.operators.traverse import cut_lineage


@dataclass
class Request:
    """What to investigate: ``times`` (``case_id, as_of``), ``seeds``, and what is optional."""

    times: DataFrame
    seeds: DataFrame
    sources: DataFrame | None = None
    sinks: DataFrame | None = None
    institutions: DataFrame | None = None
    limits: pareto.Limits = field(default_factory=pareto.Limits)
    model: risk.BoostedModel | None = None
    top_k: int = 3
    max_depth: int = 3
    with_forecast: bool = True
    budgets: chokepoint.Budgets | None = None


@dataclass
class Report:
    """Frames and the status of each stage: completed, unavailable or insufficient_evidence."""

    frames: dict[str, DataFrame]
    stages: dict[str, str]

    @property
    def status(self) -> str:
        return "partial" if "unavailable" in set(self.stages.values()) else "completed"


def investigate(transfers: DataFrame, request: Request) -> Report:
    """Seven stages: graph, provenance, risk, forecast, chokepoint, candidates, selection.

    Seeds must be transactions of their case. A stage that lacks what it needs
    (a model, sinks, candidate paths) is recorded and the others go on.
    """
    frames: dict[str, DataFrame] = {}
    stages: dict[str, str] = {}
    r, times, kind = request, request.times, dict(transfers.dtypes)
    strangers = r.seeds.join(transfers.select("case_id", "transaction_id").distinct(), ["case_id", "transaction_id"], "left_anti").limit(1).collect()
    if strangers:
        raise ValueError(f"seed {strangers[0].transaction_id} does not belong to case {strangers[0].case_id}")
    frames["graph"] = scan.manifest(transfers)
    stages["graph"] = "completed"

    bad = taint.check_seeds(transfers, r.seeds).limit(1).collect()
    if bad:
        raise ValueError(f"case {bad[0].case_id}: {bad[0].problem}")
    allocated = cut_lineage(taint.allocations(transfers, r.seeds))
    frames["allocations"], frames["balances"] = allocated, taint.balances(allocated)
    frames["shortfalls"], frames["conservation"] = taint.shortfalls(allocated), taint.conservation(allocated, r.seeds)
    known = cut_lineage(forecast.history(transfers, times))
    past = taint.allocations(known, scan.seeds_in(r.seeds, known))
    frames["tainted_now"] = cut_lineage(taint.tainted_accounts(past))
    stages["provenance"] = "completed"

    features = account_features(transfers, times, r.institutions)
    frames["features"] = features
    if r.model is None:
        stages["risk"] = "unavailable"
    else:
        frames["risk"] = risk.risk_predictions(r.model.score(features))
        stages["risk"] = "completed"
    frames["next_hops"] = predicted_next_hops(transfers, times, r.institutions, 2 * r.top_k, frames["tainted_now"])

    options = counterfactual.candidates(transfers, allocated, times)
    if r.with_forecast:
        sources, paths = forecast.paths_from(transfers, r.seeds, times, r.institutions, r.top_k, r.max_depth)
        holds = forecast.forecast_candidates(sources, paths, kind["event_id"])
        frames["paths"] = paths
        frames["forecast"] = forecast.evaluate(transfers, r.seeds, paths, holds, times)
        options = options.unionByName(holds)
        stages["forecast"] = "insufficient_evidence" if paths.isEmpty() else "completed"
    else:
        stages["forecast"] = "unavailable"

    if r.sinks is not None:
        marked = r.seeds.join(transfers.select("case_id", "transaction_id", "receiver"), ["case_id", "transaction_id"])
        origins = r.sources if r.sources is not None else marked.select("case_id", F.col("receiver").alias("account")).distinct()
        later = scan.active(transfers).join(times, "case_id").where("occurred_at > as_of")
        report, edges = chokepoint.reports(transfers, later, counterfactual.edge_hold_collateral(allocated, times), origins, r.sinks, r.budgets)
        frames["chokepoint_report"], frames["chokepoints"] = cut_lineage(report), edges
        options = options.unionByName(chokepoint.cut_candidates(edges, kind["sender"]))
        stages["chokepoint"] = "completed"

    named = counterfactual.with_id(counterfactual.valid(options.distinct()), times)
    frames["candidates"] = named
    stages["candidates"] = "completed"
    results = cut_lineage(counterfactual.explanation(counterfactual.outcomes(transfers, r.seeds, allocated, named, times)))
    frames["evaluations"] = pareto.explained(results, r.limits)
    frames["selected"], frames["explanation"] = frames["evaluations"].where("selected"), pareto.comparisons(frames["evaluations"])
    stages["selection"] = "completed"
    return Report(frames, stages)
