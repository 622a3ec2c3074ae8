"""Hard limits, Pareto frontiers, ranks and deterministic selection of interventions.

Evaluations have ``case_id, intervention_id, intercepted, legitimate,
affected_accounts, affected_edges`` and, for confidence limits,
``provenance_confidence``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import recovery_efficiency

OBJECTIVES = ("intercepted", "legitimate", "affected_accounts", "affected_edges")


@dataclass(frozen=True)
class Limits:
    """Hard limits; a candidate that breaks one is never ranked."""

    minimum_required_illicit_recovery: int = 0
    maximum_legitimate_capital_affected: int | None = None
    maximum_affected_accounts: int | None = None
    maximum_affected_edges: int | None = None
    maximum_interventions: int = 1
    minimum_provenance_confidence: float | None = None

    def __post_init__(self) -> None:
        for name in ("minimum_required_illicit_recovery", "maximum_legitimate_capital_affected", "maximum_affected_accounts", "maximum_affected_edges"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.maximum_interventions < 1:
            raise ValueError("maximum_interventions must be at least one")
        if self.minimum_provenance_confidence is not None and not 0 <= self.minimum_provenance_confidence <= 1:
            raise ValueError("minimum_provenance_confidence must lie between 0 and 1")


def violations(limits: Limits) -> Column:
    """Names of the limits that a row breaks, in declaration order."""
    rules = [
        ("minimum_required_illicit_recovery", F.col("intercepted") < limits.minimum_required_illicit_recovery),
        ("maximum_legitimate_capital_affected", _over("legitimate", limits.maximum_legitimate_capital_affected)),
        ("maximum_affected_accounts", _over("affected_accounts", limits.maximum_affected_accounts)),
        ("maximum_affected_edges", _over("affected_edges", limits.maximum_affected_edges)),
    ]
    if limits.minimum_provenance_confidence is not None:
        rules.append(("minimum_provenance_confidence", F.col("provenance_confidence") < limits.minimum_provenance_confidence))
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))


def _over(name: str, limit: int | None) -> Column:
    return F.lit(False) if limit is None else F.col(name) > limit


def binding(limits: Limits) -> Column:
    """Names of the limits that a row meets exactly."""
    at = [("minimum_required_illicit_recovery", "intercepted"), ("maximum_legitimate_capital_affected", "legitimate"), ("maximum_affected_accounts", "affected_accounts"), ("maximum_affected_edges", "affected_edges")]
    rules = [F.when(F.col(c) == getattr(limits, n), F.lit(n)) for n, c in at if getattr(limits, n) is not None]
    if limits.minimum_provenance_confidence is not None:
        rules.append(F.when(F.col("provenance_confidence") == limits.minimum_provenance_confidence, F.lit("minimum_provenance_confidence")))
    if limits.maximum_interventions == 1:
        rules.append(F.lit("maximum_interventions"))
    return F.array_compact(F.array(*rules))


def judged(evaluations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``evaluations`` plus ``violations``, ``feasible`` and ``efficiency``."""
    out = evaluations.withColumn("violations", violations(limits)).withColumn("feasible", F.size("violations") == 0)
    return out.withColumn("efficiency", recovery_efficiency(F.col("intercepted"), F.col("legitimate")))


def _dominates(a: str, b: str) -> Column:
    """Row ``a`` is nowhere worse than ``b`` and somewhere better: more intercepted, less of the rest."""
    signs = {"intercepted": 1}
    pairs = [(F.col(f"{a}.{o}") * signs.get(o, -1), F.col(f"{b}.{o}") * signs.get(o, -1)) for o in OBJECTIVES]
    no_worse, better = F.lit(True), F.lit(False)
    for x, y in pairs:
        no_worse, better = no_worse & (x >= y), better | (x > y)
    return no_worse & better


#: Cells of a case whose own frontiers are found first.
CELLS = 32


def undominated(points: np.ndarray, block: int = 512) -> np.ndarray:
    """Which rows (all columns to be small) no other row dominates; equal rows are all kept."""
    order = np.lexsort(points.T[::-1])  # what dominates a row comes before it
    keep, best = np.zeros(len(points), bool), points[:0]
    worse = lambda a, b: ((a[None] <= b[:, None]).all(axis=2) & (a[None] < b[:, None]).any(axis=2)).any(axis=1)
    for at in range(0, len(order), block):
        rows = order[at : at + block]
        out = np.zeros(len(rows), bool)
        for k in range(0, len(best), 4096):
            out |= worse(best[k : k + 4096], points[rows])
        rows = rows[~out]
        rows = rows[~worse(points[rows], points[rows])]
        keep[rows] = True
        best = np.concatenate([best, points[rows]])
    return keep


def frontier(feasible: DataFrame, cells: int = CELLS) -> DataFrame:
    """Rows that no other row of their case dominates.

    Dominance is decided between distinct objective points, in two phases. A
    case's points are dealt out to cells, and each cell gives its own frontier: a
    task each, so a case of many points is no single task. The survivors are
    thinned by one sorted pass (in order of recovery, a point with more cost in
    every other respect than the best so far is out) and compared by an anti-join.
    """
    points = feasible.select("case_id", *OBJECTIVES).distinct()
    cell = F.pmod(F.xxhash64(*OBJECTIVES), F.lit(cells))

    def local(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        costs = np.column_stack([-rows["intercepted"], *(rows[o] for o in OBJECTIVES if o != "intercepted")])
        return rows[undominated(costs)][["case_id", *OBJECTIVES]]

    points = points.groupBy("case_id", cell.alias("cell")).applyInPandas(local, points.schema)
    ahead = Window.partitionBy("case_id").orderBy(F.desc("intercepted"), "legitimate", "affected_accounts", "affected_edges").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(F.struct("legitimate", "affected_accounts", "affected_edges")).over(ahead)
    thin = points.withColumn("best", best).where(
        "best IS NULL OR NOT (best.legitimate < legitimate AND best.affected_accounts <= affected_accounts AND best.affected_edges <= affected_edges)"
    ).drop("best")
    kept = thin.alias("b").join(thin.alias("a"), (F.col("a.case_id") == F.col("b.case_id")) & _dominates("a", "b"), "left_anti")
    return feasible.join(kept, ["case_id", *OBJECTIVES], "left_semi")


def selection_order() -> list[Column]:
    return [F.desc("intercepted"), F.asc("legitimate"), F.desc("efficiency"), F.asc("affected_accounts"), F.asc("affected_edges"), F.asc("intervention_id")]


def ranked(evaluations: DataFrame, limits: Limits = Limits(), named: bool = True) -> DataFrame:
    """All rows with ``pareto_rank`` (0 frontier, 1 dominated, null infeasible), ``dominated_by`` and ``selected``.

    Infeasible rows have no rank, but frontier rows that dominate them are listed;
    without ``named`` there is no such list, which is as long as the frontier.
    """
    rows = judged(evaluations, limits)
    front = frontier(rows.where("feasible")).select("case_id", "intervention_id", *OBJECTIVES)
    if not named:
        return _placed(rows, front)
    over = rows.alias("b").join(front.alias("a"), (F.col("a.case_id") == F.col("b.case_id")) & _dominates("a", "b"))
    by = over.groupBy(F.col("b.case_id").alias("case_id"), F.col("b.intervention_id").alias("intervention_id")).agg(F.array_sort(F.collect_list("a.intervention_id")).alias("dominated_by"))
    out = _placed(rows, front).join(by, ["case_id", "intervention_id"], "left")
    return out.withColumn("dominated_by", F.coalesce("dominated_by", F.array().cast("array<string>")))


def _placed(rows: DataFrame, front: DataFrame) -> DataFrame:
    """``rows`` with ``pareto_rank`` and ``selected``."""
    marked = front.select("case_id", "intervention_id", F.lit(True).alias("on_front"))
    out = rows.join(marked, ["case_id", "intervention_id"], "left")
    on = F.coalesce("on_front", F.lit(False))
    place = F.row_number().over(Window.partitionBy("case_id", on).orderBy(*selection_order()))
    return (
        out.withColumn("selected", on & (place == 1))
        .withColumn("pareto_rank", F.when(on, 0).when(F.col("feasible"), 1)).drop("on_front")
    )


def explained(evaluations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``ranked`` with a reason for every row and the limits that the selected one meets exactly."""
    reason = (
        F.when(F.col("selected"), "recommended: feasible and Pareto-efficient, first by recovery, collateral, efficiency, scope and id")
        .when(F.col("pareto_rank") == 0, "Pareto-efficient, but later by the tie-breaking order")
        .when(F.col("pareto_rank") == 1, "dominated on one or more objectives")
        .otherwise(F.concat(F.lit("infeasible: "), F.array_join("violations", ", ")))
    )
    return ranked(evaluations, limits).withColumns({"reason": reason, "binding": F.when(F.col("selected"), binding(limits))})


def comparisons(explained_: DataFrame) -> DataFrame:
    """Per case: whether anything is feasible, the selected row's figures and limits met, and why each other row was not taken, by id."""
    other = F.when(~F.col("selected"), F.struct("intervention_id", "reason"))
    own = lambda c: F.max(F.when(F.col("selected"), F.col(c))).alias(c)
    out = explained_.groupBy("case_id").agg(own("intervention_id"), own("intercepted"), own("legitimate"), own("efficiency"), own("binding"), F.array_sort(F.collect_list(other)).alias("others"))
    verdict = F.when(F.col("intervention_id").isNull(), "no feasible intervention meets all limits").otherwise("feasible and Pareto-efficient; ties by recovery, collateral, efficiency, scope and id")
    return out.withColumn("verdict", verdict)


def baseline_choice(rows: DataFrame, measure: str, account_holds_only: bool = True) -> DataFrame:
    """The feasible row of each case with the largest ``measure`` (missing: zero), ties by id."""
    pool = rows.where("feasible")
    if account_holds_only:
        pool = pool.where("kind = 'account_hold'")
    order = Window.partitionBy("case_id").orderBy(F.desc(F.coalesce(F.col(measure), F.lit(0))), "intervention_id")
    return pool.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def robust_choice(rows: DataFrame) -> DataFrame:
    """The feasible forecast-aware row of each case: expected recovery, worst collateral, worst recovery, scope, target."""
    order = Window.partitionBy("case_id").orderBy(
        F.desc("expected_intercepted"), F.asc("worst_legitimate"), F.desc("worst_intercepted"), F.asc("affected_accounts"), F.asc("affected_edges"),
        F.asc("kind"), F.asc(F.coalesce(F.col("target_account").cast("string"), F.lit(""))), F.asc(F.coalesce(F.col("target_event").cast("string"), F.lit(""))),
    )
    return rows.where("feasible").withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def highest_taint_edge(allocated: DataFrame, times: DataFrame, eligible: DataFrame) -> DataFrame:
    """The first later eligible event with the most taint, per case."""
    later = allocated.join(times.select("case_id", "as_of"), "case_id").where("occurred_at > as_of").join(eligible.select("case_id", "event_id"), ["case_id", "event_id"], "left_semi")
    order = Window.partitionBy("case_id").orderBy(F.desc("tainted"), "sequence")
    return later.withColumn("n", F.row_number().over(order)).where("n = 1").select("case_id", "event_id", "tainted")


def candidate_table(rows: DataFrame, sort: str = "intercepted", ascending: bool = False, feasible_only: bool = False) -> DataFrame:
    """``rows`` of each case with their place by one measure (``intercepted``, ``legitimate`` or ``provenance_confidence``), ties by id."""
    shown = rows.where("feasible") if feasible_only else rows
    key = F.asc(sort) if ascending else F.desc(sort)
    return shown.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy(key, "intervention_id")))
