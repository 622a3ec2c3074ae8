"""Registered queries answer for all transfers, accounts and candidates of their cases."""

from collections import defaultdict

import __spark_entry__
from weirflow.operators import scan
from weirflow.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_chokepoints_over_all_transfers(spark):
    """A case has a path exactly when brute-force search over all its active transfers finds one."""
    moves, marked, _ = plans._dense(spark, SF)
    origin = {r.case_id: r.receiver for r in marked.join(moves.select("case_id", "transaction_id", "receiver"), ["case_id", "transaction_id"]).collect()}
    events = defaultdict(list)
    for r in scan.active(moves).collect():
        events[r.case_id].append((r.occurred_at, r.sender, r.receiver))
    got = {r.case_id: r.status for r in __spark_entry__.queries()["chokepoint_edges"](spark, SF).collect()}
    assert got
    for case, status in got.items():
        start = origin[case]
        reached = {start: None}  # account: its earliest arrival
        for at, sender, receiver in sorted(events[case]):
            if sender in reached and (reached[sender] is None or reached[sender] < at):
                reached.setdefault(receiver, at)
        assert (status != "no_path_exists") == bool(set(reached) & (set(range(5)) - {start})), case


def test_outcomes_of_every_candidate_at_noon(spark):
    queries = __spark_entry__.queries()
    key = lambda r: (r.case_id, r.kind, r.target_account, r.target_event)
    outcomes = queries["counterfactual_outcomes"](spark, SF).collect()
    assert outcomes and {key(r) for r in outcomes} == {key(r) for r in queries["counterfactual_candidates"](spark, SF).collect()}
    sources = queries["source_interception"](spark, SF).select("intervention_id").distinct().collect()
    assert {r.intervention_id for r in sources} == {r.intervention_id for r in outcomes}


def test_plans_with_code_generation_give_the_same_rows(spark):
    """The other tests run without it, as tiny inputs compile for longer than they run."""
    queries = __spark_entry__.queries()
    rows = lambda name: sorted(map(str, queries[name](spark, SF).collect()))
    names = ("fan_out", "account_features", "taint_balances", "pareto_ranks", "network_arcs")
    plain = {name: rows(name) for name in names}
    spark.conf.set("spark.sql.codegen.wholeStage", "true")
    try:
        assert {name: rows(name) for name in names} == plain
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")
