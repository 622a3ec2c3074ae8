import random
from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import CHAIN, at, graph, named, seeds
from weirflow.functions.columns import as_list, benchmark_efficiency, compact_rupees, is_stale, iso, recovery_efficiency, rupees, stage_badge, trade_off
from weirflow.operators import chokepoint, features, forecast, pareto, risk, scan, traverse
from weirflow.operators.features import account_features, heuristic_next_hops, next_hop_features, predicted_next_hops
from weirflow.operators.traverse import upstream
from weirflow.plans.investigate import Request, investigate
from weirflow.sources import synthetic


def cut(spark, rows, collateral, sources, sinks, minutes=None):
    g = graph(spark, *rows)
    costs = spark.createDataFrame([("c", e, v) for e, v in collateral.items()] or [("c", "none", 0)], "case_id string, event_id string, collateral bigint")
    later = scan.eligible(g, None if minutes is None else at(spark, minutes).first().as_of)
    found = chokepoint.chokepoints(g, later, costs, named(spark, *sources), named(spark, *sinks)).orderBy("position").collect()
    return found[0].status, [r.event_id for r in found if r.event_id], found[0].cost, found[0].residual_path


def test_cuts(spark):
    assert cut(spark, [("e1", "A", "B", 0), ("e2", "B", "C", 1)], {"e1": 5000, "e2": 1000}, ["A"], ["C"])[:2] == ("optimal_cut_found", ["e2"])
    diamond = [("ab", "A", "B", 0), ("ac", "A", "C", 0), ("bd", "B", "D", 1), ("cd", "C", "D", 2)]
    assert cut(spark, diamond, {"ab": 50_000, "ac": 50_000, "bd": 2000, "cd": 2000}, ["A"], ["D"])[1] == ["bd", "cd"]
    hub = [("a", "A", "H", 0), ("b", "B", "H", 1), ("exit", "H", "X", 5)]
    assert cut(spark, hub, {}, ["A", "B"], ["X"]) == ("optimal_cut_found", ["exit"], 1, False)
    assert cut(spark, [("e1", "A", "X", 0), ("e2", "B", "Y", 0)], {}, ["A", "B"], ["X", "Y"])[1] == ["e1", "e2"]
    assert cut(spark, [("e1", "A", "B", 0), ("e2", "C", "D", 1)], {}, ["A"], ["D"])[0] == "no_path_exists"
    assert cut(spark, [("e1", "A", "B", 0), ("e2", "B", "C", 1)], {"e1": 10_000, "e2": 0}, ["A"], ["C"])[1:3] == (["e2"], 1)
    assert cut(spark, [("e1", "A", "B", 0), ("e2", "B", "C", 1)], {}, ["A"], ["C"], minutes=9)[0] == "no_feasible_cut"
    assert cut(spark, [("e1", "A", "B", 0), ("e2", "B", "C", 0)], {}, ["A"], ["C"])[0] == "no_path_exists"


def test_cut_reports(spark):
    rows = [("ab", "A", "B", 0), ("ac", "A", "C", 0), ("bd", "B", "D", 1), ("cd", "C", "D", 2), ("bc", "B", "C", 1), ("back", "D", "A", 9), ("ba", "B", "A", 3)]
    g = graph(spark, *rows).unionByName(graph(spark, ("x", "A", "B", 0), case="bad")).unionByName(graph(spark, ("y", "A", "B", 0), case="none"))
    costs = spark.createDataFrame([("c", "bd", 5), ("c", "cd", 7)], "case_id string, event_id string, collateral bigint")
    every = lambda *a: named(spark, *a).unionByName(named(spark, *a, case="bad")).unionByName(named(spark, *a, case="none"))
    sinks = named(spark, "D").unionByName(named(spark, "A", " ", case="bad")).unionByName(named(spark, "Z", case="none"))
    report, edges = chokepoint.reports(g, g, costs, every("A"), sinks)
    got = {r.case_id: r for r in report.collect()}
    r = got["c"]
    assert (r.status, r.cut_size, r.collateral, r.verified, r.initial_paths, r.residual_paths, r.events, r.eligible) == ("optimal_cut_found", 2, 0, True, 3, 0, 7, 7)
    assert [e.event_id for e in r.per_edge] == [x.event_id for x in edges.where("case_id = 'c'").orderBy("position").collect()] and r.summary.startswith("A least cut of 2 edge(s) parts 1 source(s)")
    assert (got["bad"].status, got["bad"].verified, got["none"].status, got["none"].verified, got["none"].initial_paths) == ("invalid_input", False, "no_path_exists", True, 0)
    small = chokepoint.reports(g, g, costs, every("A"), sinks, chokepoint.Budgets(arcs=10, paths=1))[0].where("case_id = 'c'").first()
    assert small.status == "budget_exceeded" and not small.verified and small.arcs > 10
    capped = chokepoint.reports(g, g, costs, every("A"), sinks, chokepoint.Budgets(paths=2))[0].where("case_id = 'c'").first()
    assert capped.initial_paths == 2 and capped.verified
    with pytest.raises(ValueError):
        chokepoint.Budgets(paths=0)


def test_counted_paths_equal_all_paths():
    rng = random.Random(3)
    for _ in range(60):
        events = [(rng.randint(0, 8), rng.randint(0, 5), rng.randint(0, 5)) for _ in range(rng.randint(0, 14))]
        sources, sinks = {0, 1}, {4, 5}

        def walk(at, time, seen, depth):
            for t, s, r in events:
                if s == at and (time is None or t > time) and r not in seen:
                    yield 1 if r in sinks else 0
                    if r not in sinks and depth < 9:
                        yield from walk(r, t, seen | {r}, depth + 1)

        want = sum(sum(walk(s, None, {s}, 0)) for s in sources)
        assert chokepoint.count_paths(events, sources, sinks, 10_000) == want
        assert chokepoint.count_paths(events, sources, sinks, 2) == min(want, 2)


def test_cut_cost_equals_the_least_of_all_cuts(spark):
    rng, cases, g, costs = random.Random(5), {}, None, []
    for case in "pqrstu":
        rows = [(f"{case}{i}", *rng.sample("ABCDE", 2), rng.randint(0, 9)) for i in range(13)]
        cases[case] = rows, {r[0]: rng.randint(0, 4) for r in rows}
        g = graph(spark, *rows, case=case) if g is None else g.unionByName(graph(spark, *rows, case=case))
        costs += [(case, e, v) for e, v in cases[case][1].items()]
    side = lambda a: spark.createDataFrame([(c, a) for c in cases], "case_id string, account string")
    rows_ = chokepoint.chokepoints(g, g, spark.createDataFrame(costs, "case_id string, event_id string, collateral bigint"), side("A"), side("E")).collect()
    cut_at_all = 0
    for case, (rows, collateral) in cases.items():
        price = {e: v * (len(rows) + 1) + 1 for e, v in collateral.items()}

        def open_(gone, rows=rows):
            reached = {"A": -1}
            for _, s, r, t in sorted((x for x in rows if x[0] not in gone), key=lambda x: x[3]):
                if s == "A" or reached.get(s, 99) < t:
                    reached[r] = min(t, reached.get(r, 99))
            return "E" in reached

        best = min(sum(price[e] for e in gone) for n in range(6) for gone in combinations(price, n) if not open_(set(gone)))
        mine = [r for r in rows_ if r.case_id == case]
        assert (mine[0].status, int(mine[0].cost)) == ("optimal_cut_found" if best else "no_path_exists", best) and not open_({r.event_id for r in mine})
        cut_at_all += best > 0
    assert cut_at_all >= 3


def test_network_size_and_terminals(spark):
    g = graph(spark, *[(f"e{i:02d}", f"a{i:02d}", f"a{i + 1:02d}", i) for i in range(50)])
    costs = chokepoint.encoded_costs(g, g, g.select("case_id", "event_id", F.lit(0).alias("collateral")))
    size = chokepoint.budgets(chokepoint.network_arcs(g, costs, named(spark, "a00"), named(spark, "a50"))).first()
    assert size.vertices <= 202 and size.arcs <= 350 and not size.exceeded
    with pytest.raises(ValueError, match="both source and sink"):
        chokepoint.check_terminals(named(spark, "A"), named(spark, " A "))
    with pytest.raises(ValueError, match="empty"):
        chokepoint.check_terminals(named(spark, " "), named(spark, "A"))


def evaluations(spark, *rows):
    return spark.createDataFrame([("c", *r) for r in rows], "case_id string, intervention_id string, intercepted bigint, legitimate bigint, affected_accounts int, affected_edges int, provenance_confidence double")


def test_frontier_and_selection(spark):
    rows = evaluations(spark, ("a", 100, 20, 1, 1, 1.0), ("b", 90, 40, 1, 1, 1.0), ("c", 80, 10, 1, 1, 1.0), ("d", 95, 500, 1, 1, 1.0))
    got = {r.intervention_id: r for r in pareto.explained(rows, pareto.Limits(maximum_legitimate_capital_affected=100)).collect()}
    assert {k: r.pareto_rank for k, r in got.items()} == {"a": 0, "b": 1, "c": 0, "d": None}
    assert [k for k, r in got.items() if r.selected] == ["a"] and got["b"].dominated_by == ["a"] and got["d"].dominated_by == ["a"]
    assert got["d"].reason == "infeasible: maximum_legitimate_capital_affected" and "maximum_interventions" in got["a"].binding
    tie = pareto.ranked(evaluations(spark, ("z", 100, 20, 2, 1, 1.0), ("a", 100, 20, 1, 1, 1.0)))
    assert [r.intervention_id for r in tie.where("selected").collect()] == ["a"]


def test_comparisons_of_a_case(spark):
    rows = evaluations(spark, ("a", 100, 20, 1, 1, 1.0), ("b", 90, 40, 1, 1, 1.0), ("d", 95, 500, 1, 1, 1.0))
    told = pareto.comparisons(pareto.explained(rows, pareto.Limits(maximum_legitimate_capital_affected=100))).first()
    assert (told.intervention_id, told.intercepted, [o.intervention_id for o in told.others]) == ("a", 100, ["b", "d"]) and "infeasible" in told.others[1].reason
    none = pareto.comparisons(pareto.explained(rows, pareto.Limits(maximum_affected_edges=0))).first()
    assert none.intervention_id is None and len(none.others) == 3 and none.verdict.startswith("no feasible")


def test_limits(spark):
    limits = pareto.Limits(100, 10, 1, 1, 1, 0.9)
    row = pareto.judged(evaluations(spark, ("x", 1, 11, 2, 2, 0.8)), limits).first()
    assert row.violations == ["minimum_required_illicit_recovery", "maximum_legitimate_capital_affected", "maximum_affected_accounts", "maximum_affected_edges", "minimum_provenance_confidence"]
    with pytest.raises(ValueError):
        pareto.Limits(maximum_interventions=0)


def test_scalar_rules(spark):
    df = spark.createDataFrame([(100, 20), (0, 0), (10, 0), (10, 4)], "i bigint, l bigint")
    rows = df.select(recovery_efficiency(F.col("i"), F.col("l")).alias("e"), benchmark_efficiency(F.col("i"), F.col("l")).alias("b")).collect()
    assert [r.e for r in rows] == [5, 0, 10, Decimal("2.5")] and [r.b for r in rows] == [5, None, 10, Decimal("2.5")]
    money = spark.createDataFrame([(1234567890,), (-99,), (100000,), (0,), (123456789012,)], "m bigint")
    assert [r[0] for r in money.select(rupees(F.col("m"))).collect()] == ["₹1,23,45,678.90", "-₹0.99", "₹1,000.00", "₹0.00", "₹1,23,45,67,890.12"]
    assert [r[0] for r in money.select(compact_rupees(F.col("m"))).collect()] == ["₹1.23Cr", "-₹1", "₹1.0K", "₹0", "₹123.46Cr"]
    badges = spark.createDataFrame([("failed",), ("odd",)], "s string").select(stage_badge(F.col("s")).alias("b")).collect()
    assert [(r.b.label, r.b.variant) for r in badges] == [("Failed", "danger"), ("odd", "neutral")]
    told = df.select(trade_off(F.col("i"), F.col("l")).alias("t")).collect()
    assert (told[0].t, told[2].t) == ("Recovers ₹1.00 and affects ₹0.20 (5.0x)", "Recovers ₹0.10 and affects nobody else")
    lists = df.select(as_list(F.col("i"), False).alias("a"), as_list(F.array("i"), True).alias("b"), is_stale(F.lit(None), F.lit(1)).alias("c"), is_stale(F.lit(2), F.lit(1)).alias("d")).first()
    assert (lists.a, lists.b, lists.c, lists.d) == ([100], [100], False, True)
    times = spark.sql("SELECT timestamp_ntz'2026-01-02 03:04:05' t UNION ALL SELECT timestamp_ntz'2026-01-02 03:04:05.000600'")
    assert [r[0] for r in times.select(iso(F.col("t"))).collect()] == ["2026-01-02T03:04:05+00:00", "2026-01-02T03:04:05.000600+00:00"]


def test_account_features(spark):
    g = graph(spark, ("a", "V", "M", 0, 1_000_000), ("b", "M", "X", 1, 990_000))
    rows = {r.account: r for r in account_features(g, at(spark, 5)).collect()}
    m = rows["M"]
    assert (m.has_rapid_pass_through, m.min_pass_through_seconds, round(m.forwarding_ratio, 2), m.total_degree) == (1.0, 60.0, 0.99, 2.0)
    assert rows["V"].forwarding_ratio == 0.0 and rows["X"].forwarding_ratio == 0.0 and rows["X"].evidence_maturity_level == 0.0
    before = account_features(g.union(graph(spark, ("late", "M", "Q", 60))), at(spark, 5)).collect()
    assert sorted(map(str, before)) == sorted(map(str, rows.values()))
    self_ = account_features(graph(spark, ("s", "A", "A", 0)), at(spark, 1)).first()
    assert (self_.in_degree, self_.out_degree, self_.min_pass_through_seconds) == (1, 1, 0)
    pair = next_hop_features(graph(spark, ("x", "S", "C", 0, 250_000)), at(spark, 1)).where("source = 'S'").first()
    assert (pair.candidate, pair.past_transfers_count, pair.past_transfer_volume, pair.candidate_in_degree) == ("C", 1, 250_000, 1)


def test_next_hops_without_all_pairs_equal_those_with(spark):
    rng = random.Random(1)
    rows = [(f"e{i}", *(f"a{rng.randint(0, 14):02d}" for _ in range(2)), i) for i in range(40)]
    g = graph(spark, *rows).unionByName(graph(spark, *rows[:9], case="d"))
    times = at(spark, 30).unionByName(at(spark, 30, case="d"))
    banks = spark.createDataFrame([(f"a{i:02d}", f"b{i % 3}" if i % 5 else None) for i in range(16)], "account string, institution string")
    known = g.join(times, "case_id").where("occurred_at <= as_of").drop("as_of")
    for institutions in (banks, None):
        whole = heuristic_next_hops(next_hop_features(g, times, None, institutions), upstream(known, scan.accounts(known)), 4)
        got = predicted_next_hops(g, times, institutions, 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
        some = named(spark, "a03", "a07", "a15")
        part = predicted_next_hops(g, times, institutions, 4, some).collect()
        assert sorted(map(tuple, part)) == sorted(tuple(r) for r in whole.collect() if r.case_id == "c" and r.source in ("a03", "a07")) + sorted(tuple(r) for r in part if r.source == "a15")


def test_fitted_next_hops(spark):
    world = synthetic.synthetic_world(spark, worlds=3)
    labels = world.where("mark = 'fraud'").select("case_id", "sender", "receiver")
    banks = world.select(F.col("sender").alias("account"), F.col("sender_inst").alias("institution")).union(world.select("receiver", "receiver_inst")).distinct()
    moments = risk.next_hop_moments(world, labels)
    rows = traverse.cut_lineage(risk.next_hop_rows(world, moments, banks))
    accounts = scan.accounts(world).groupBy("case_id").count().withColumnRenamed("count", "n")
    per = rows.groupBy("case_id", "source").agg(F.count("*").alias("rows"), F.sum("label").alias("hits")).join(accounts, "case_id").join(moments, ["case_id", "source"]).collect()
    assert len(per) == moments.count() and all(r["rows"] == r.n - 1 and r.hits == len(set(r.targets) - {r.source}) for r in per)
    model = risk.next_hop_model()
    model.rounds = 3
    best = risk.fitted_next_hops(rows.drop("label"), model.fit(rows), top_k=3)
    metrics = risk.next_hop_metrics(best, rows.where("label = 1")).first()
    assert metrics.top_3 > 0.4 and best.where("rank > 3").isEmpty() and best.first().signals.past_transfers_count >= 0
    times = {r.case_id: r.as_of for r in risk.observation_times(world).collect()}
    benign = world.where("family = 'benign_high_volume_merchant'").groupBy("case_id").agg(F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b")).collect()
    assert all(abs((times[r.case_id] - r.a) / (r.b - r.a) - 0.85) < 1e-6 for r in benign)


def test_beam_keeps_the_best_paths(spark):
    hops = spark.createDataFrame([("c", "m1", f"m{i + 2}", i + 1, p) for i, p in enumerate((0.5, 0.3, 0.15, 0.05))], "case_id string, source string, candidate string, rank int, probability double")
    start = spark.createDataFrame([("c", "m1", 1000)], "case_id string, account string, amount bigint")
    none = spark.createDataFrame([], "case_id string, account string, ancestor string")
    got = forecast.beam_paths(hops, start, none, at(spark, 0), top_k=2, max_depth=1).orderBy("path_rank").collect()
    assert [(r.accounts, r.cumulative) for r in got] == [(["m1", "m2"], 0.5), (["m1", "m3"], 0.3)] and got[0].path_id.startswith("path-")
    deep = forecast.beam_paths(hops, start, none, at(spark, 0), top_k=2, max_depth=3).orderBy("path_rank").collect()
    assert [r.accounts for r in deep] == [["m1", "m2"], ["m1", "m3"]]  # dead ends end a path
    assert deep[0].hops[0].occurred_at == at(spark, 5).first().as_of


def test_linear_chains_have_no_forecast(spark):
    g, s = graph(spark, *CHAIN), seeds(spark, ("e1", 10_000))
    for minutes in (5, 15):
        t = at(spark, minutes)
        sources, paths = forecast.paths_from(g.withColumn("event_id", F.col("ingest_seq")), s, t)
        assert paths.count() == 0
        rows = forecast.evaluate(g.withColumn("event_id", F.col("ingest_seq")), s, paths, forecast.forecast_candidates(sources, paths), t).collect()
        assert {r.forecast_status for r in rows} == {"no_candidate_paths"} and all(r.intercepted == 0 and r.provenance_confidence == 0 for r in rows)


def test_forecast_worlds(spark):
    g = graph(spark, ("s", "V", "M", 0), ("a", "M", "X", -9, 10), ("b", "M", "Y", -8, 10), ("c", "M", "X", -7, 10)).withColumn("event_id", F.col("ingest_seq"))
    s, t = seeds(spark, ("s", 10_000)), at(spark, 5)
    sources, paths = forecast.paths_from(g, s, t, max_depth=1)
    assert [r.accounts[-1] for r in paths.orderBy("path_rank").collect()][:1] == ["X"]
    rows = {r.target_account: r for r in forecast.evaluate(g, s, paths, forecast.forecast_candidates(sources, paths), t).collect()}
    assert rows["M"].forecast_status == "ready" and rows["M"].worst_intercepted == 10_000 and abs(rows["M"].effective_probability - 1) < 1e-9
    assert rows["X"].best_intercepted == 0


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    r = risk.binary_metrics(df).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 0, 1) and r.roc_auc == 0.875 and abs(r.average_precision - (0.5 + 0.5 * 2 / 3)) < 1e-12
    none = risk.binary_metrics(df.where("label = 0")).first()
    assert none.recall is None and none.roc_auc is None


def test_investigation(spark):
    g = graph(spark, ("e1", "V", "M1", 0, 10_000_000), ("e2", "M1", "M2", 10, 10_000_000), ("e3", "M2", "X", 20, 10_000_000)).withColumn("event_id", F.col("ingest_seq"))
    request = Request(at(spark, 5), seeds(spark, ("e1", 10_000_000)), sources=named(spark, "M1"), sinks=named(spark, "X"))
    report = investigate(g, request)
    assert report.status == "partial" and report.stages["risk"] == "unavailable" and report.stages["forecast"] == "insufficient_evidence"
    m = report.frames["graph"].first()
    assert (m.node_count, m.edge_count) == (4, 3)
    cut_ = report.frames["chokepoints"].collect()
    assert cut_[0].status == "optimal_cut_found" and not cut_[0].residual_path
    assert report.frames["selected"].first().intercepted == 10_000_000
    with pytest.raises(ValueError, match="does not belong"):
        investigate(g, Request(at(spark, 5), seeds(spark, ("nope", 1))))


def test_frontier_in_cells_equals_all_pairs(spark):
    rng = random.Random(12)
    rows = [(c, f"i{c}{k}", rng.randint(0, 40), rng.randint(0, 40), rng.randint(1, 6), rng.randint(1, 6)) for c in "ab" for k in range(300)]
    rows += [("a", "copy", *rows[0][2:])]
    frame = spark.createDataFrame(rows, "case_id string, intervention_id string, intercepted bigint, legitimate bigint, affected_accounts bigint, affected_edges bigint")
    beats = lambda x, y: x[2] >= y[2] and all(p <= q for p, q in zip(x[3:], y[3:])) and x[2:] != y[2:]
    want = {r[1] for r in rows if not any(beats(x, r) for x in rows if x[0] == r[0])}
    for cells in (1, 7):
        assert {r.intervention_id for r in pareto.frontier(frame, cells).collect()} == want
    points = np.array([[-r[2], *r[3:]] for r in rows if r[0] == "a"])
    kept = pareto.undominated(points, block=16)
    assert {r[1] for r, k in zip([r for r in rows if r[0] == "a"], kept) if k} == {i for i in want if not i.startswith("ib")}


def test_pairs_of_an_institution_are_not_shuffled(spark):
    """They are made above the last exchange, and are those that share nothing else."""
    accounts = [("c", f"a{i}", f"B{i % 2}" if i < 9 else None, i, 2, 3, 4, 5) for i in range(10)]
    node = spark.createDataFrame(accounts, "case_id string, account string, institution string, width bigint, ins bigint, outs bigint, inbound bigint, outbound bigint")
    related = spark.createDataFrame([("c", "a0", "a2"), ("c", "a0", "a1"), ("c", "a9", "a0")], "case_id string, source string, candidate string")
    met = features._same_institution(related, node)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" in plan and "Exchange" not in plan[: plan.index("SortMergeJoin")]
    want = {(f"a{i}", f"a{j}") for i in range(9) for j in range(9) if i != j and i % 2 == j % 2} - {("a0", "a2")}
    rows = met.collect()
    assert len(rows) == len(want) and {(r.source, r.candidate) for r in rows} == want and {r.candidate: r.candidate_width for r in rows} == {f"a{i}": i for i in range(9)}


def test_pairs_of_one_institution_are_weights_and_places(spark):
    """Training rows count as many pairs as the list of all pairs has, and the ranks are those over all pairs."""
    rng = random.Random(4)
    rows = [(f"e{i}", *(f"a{rng.randint(0, 19):02d}" for _ in range(2)), i, rng.randrange(1, 900)) for i in range(45)]
    g = graph(spark, *rows).unionByName(graph(spark, *rows[:9], case="d"))
    times = at(spark, 20).unionByName(at(spark, 20, case="d"))
    banks = spark.createDataFrame([(f"a{i:02d}", f"b{i % 3}" if i % 7 else None) for i in range(20)], "account string, institution string")
    later = g.join(times, "case_id").where("occurred_at > as_of").select("case_id", F.col("sender").alias("source"), F.col("receiver").alias("candidate"))
    every = traverse.cut_lineage(next_hop_features(g, times, None, banks))
    related = traverse.cut_lineage(next_hop_features(g, times, None, banks, alike_alone=False))
    candidates = traverse.cut_lineage(features.institution_candidates(g, times, banks))
    assert 0 < related.count() < every.count()
    labelled = every.join(later.distinct().withColumn("label", F.lit(1)), ["case_id", "source", "candidate"], "left").fillna(0, ["label"])
    columns = ["case_id", "candidate", *risk.NEXT_HOP_FEATURES, "label"]
    weighted = traverse.cut_lineage(risk.weighted_pairs(related, candidates, later))
    tally = lambda d, n: {tuple(r)[:-1]: r.n for r in d.groupBy(columns).agg(n.alias("n")).collect()}
    assert tally(weighted, F.sum("weight")) == tally(labelled, F.count("*"))
    model = risk.next_hop_model()
    model.rounds = 3
    model.fit(weighted, weight="weight")
    known = g.join(times, "case_id").where("occurred_at <= as_of").drop("as_of")
    ancestors = traverse.cut_lineage(upstream(known, scan.accounts(known)))
    want = risk.fitted_next_hops(every, model, ancestors, top_k=3).drop("signals").collect()
    got = risk.fitted_next_hops_by_institution(related, candidates, model, ancestors, top_k=3).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.probability for r in got}) > 3


def test_ranks_without_lists_of_what_dominates(spark):
    rng = random.Random(6)
    rows = [("c", f"i{n:02d}", *(rng.randrange(4) for _ in range(4))) for n in range(40)]
    options = spark.createDataFrame(rows, "case_id string, intervention_id string, intercepted bigint, legitimate bigint, affected_accounts int, affected_edges bigint")
    limits = pareto.Limits(maximum_affected_edges=2)
    plain, named_ = pareto.ranked(options, limits, named=False), pareto.ranked(options, limits)
    assert "dominated_by" not in plain.columns
    columns = ["intervention_id", "pareto_rank", "selected", "feasible"]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, named_.select(columns).collect()))


def test_fits_of_a_boosted_model_run_side_by_side(spark, monkeypatch):
    from threading import Barrier

    meet, fit = Barrier(4), risk.Pipeline.fit
    monkeypatch.setattr(risk.Pipeline, "fit", lambda self, rows: (meet.wait(60), fit(self, rows))[1])
    rows = spark.range(80).selectExpr("CAST(id % 2 AS int) AS label", "CAST(id % 2 AS double) AS x", "id")
    model = risk.BoostedModel(("x",), 1).fit(rows)
    assert {(r.label, r.score > 0.5) for r in model.score(rows).collect()} == {(0, False), (1, True)}
