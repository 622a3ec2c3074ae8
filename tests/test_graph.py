import random
from datetime import timedelta

from pyspark.sql import functions as F

from tests.helpers import CHAIN, T0, at, graph, named
from weirflow.operators import features, motifs, scan, traverse


def depths(df):
    return {r.event_id: r.depth for r in df.collect()}


def test_downstream_of_a_chain(spark):
    g, a = graph(spark, *CHAIN), named(spark, "A")
    assert depths(traverse.downstream(g, a)) == {"e1": 1, "e2": 2, "e3": 3}
    assert depths(traverse.downstream(g, a, max_depth=2)) == {"e1": 1, "e2": 2}
    assert depths(traverse.downstream(g, a, start_time=T0 + timedelta(minutes=10))) == {}
    assert depths(traverse.downstream(g, a, start_time=T0)) == {"e1": 1, "e2": 2, "e3": 3}


def test_downstream_needs_strictly_later_hops(spark):
    g = graph(spark, ("a", "A", "B", 0), ("same", "B", "C", 0), ("b", "B", "D", 1), ("back", "D", "A", 2), ("loop", "A", "B", 3))
    assert depths(traverse.downstream(g, named(spark, "A"))) == {"a": 1, "b": 2, "back": 3, "loop": 1}


def test_only_completed_transfers_count(spark):
    g = graph(spark, *[(f"m{i}", "A", x, i, 1, s) for i, (x, s) in enumerate([("B", "completed"), ("C", "pending"), ("D", "failed"), ("E", "reversed"), ("F", "completed"), ("G", "held")])])
    assert sorted(depths(traverse.downstream(g, named(spark, "A")))) == ["m0", "m4"]
    assert scan.active(g).count() == 2 and scan.accounts(g).count() == 7


def paths(spark, g, source, target, **options):
    pairs = spark.createDataFrame([("c", source, target)], "case_id string, source string, target string")
    return sorted(tuple(r.events) for r in traverse.temporal_paths(g, pairs, **options).collect())


def test_paths(spark):
    g = graph(spark, *CHAIN)
    assert paths(spark, g, "A", "D") == [("e1", "e2", "e3")]
    assert paths(spark, g, "A", "D", max_depth=2) == []
    assert paths(spark, g, "A", "D", start_time=T0) == []  # the first hop is strictly later
    assert paths(spark, g, "A", "A") == []
    assert paths(spark, g, "A", "D", end_time=T0 + timedelta(minutes=19)) == []
    two = graph(spark, ("p1", "A", "B", 0), ("p2", "A", "B", 5), ("p3", "B", "C", 10))
    assert paths(spark, two, "A", "C") == [("p1", "p3"), ("p2", "p3")]
    ring = graph(spark, ("a", "A", "B", 0), ("b", "B", "A", 1), ("c", "A", "C", 2), ("d", "B", "C", 3))
    assert paths(spark, ring, "A", "C") == [("a", "d"), ("c",)]


def test_upstream_ignores_the_order_of_times(spark):
    g = graph(spark, ("a", "A", "B", 5), ("b", "Z", "A", 9), ("c", "B", "A", 10), ("late", "Q", "Z", 30))
    got = {r.ancestor for r in traverse.upstream(g, named(spark, "B"), T0 + timedelta(minutes=20)).collect()}
    assert got == {"A", "Z"}


def test_bursts(spark):
    g = graph(spark, ("a", "S", "A", 0), ("b", "S", "B", 1), ("c", "S", "C", 2))
    row = motifs.fan_out(g, 600, 3).first()
    assert (row.source, row.targets, row.event_ids) == ("S", ["A", "B", "C"], ["a", "b", "c"]) and row.window_end == T0 + timedelta(minutes=2)
    assert motifs.fan_out(g, 600, 4).count() == 0 and motifs.fan_out(g, 119, 3).count() == 0 and motifs.fan_out(g, 120, 3).count() == 1
    back = graph(spark, ("a", "A", "S", 0), ("b", "B", "S", 1), ("c", "C", "S", 2))
    assert motifs.fan_in(back, 600, 3).first().sources == ["A", "B", "C"]
    later = graph(spark, ("x", "S", "A", 0), ("a", "S", "A", 100), ("b", "S", "B", 101), ("c", "S", "C", 102), ("d", "S", "D", 103))
    assert motifs.fan_out(later, 600, 3).first().event_ids == ["a", "b", "c", "d"]


def test_pass_through(spark):
    g = graph(spark, ("in", "A", "P", 0), ("out", "P", "B", 0.5))
    assert motifs.rapid_pass_through(g, 60).first().delay_micros == 30_000_000 and motifs.rapid_pass_through(g, 10).count() == 0
    self_ = graph(spark, ("s", "A", "A", 0))
    assert motifs.rapid_pass_through(self_, 0).first().delay_micros == 0


def test_fan_out_fan_in(spark):
    g = graph(spark, *[(f"o{i}", "S", f"I{i}", i) for i in range(3)], *[(f"i{i}", f"I{i}", "T", 10 + i) for i in range(3)])
    row = motifs.fan_out_fan_in(g, 600, 3).first()
    assert (row.source, row.target, row.intermediaries) == ("S", "T", ["I0", "I1", "I2"])
    assert motifs.fan_out_fan_in(g, 600, 4).count() == 0


def test_ranges_are_closed_and_ordered_by_ingestion(spark):
    g = graph(spark, ("z", "A", "B", 0), ("y", "A", "B", 0), ("x", "A", "C", 5, 1, "failed"))
    assert [r.event_id for r in scan.in_time_order(scan.between(g, T0, T0)).collect()] == ["z", "y"]
    assert scan.outgoing(g, "A", active_only=False).count() == 3 and scan.incoming(g, "C").count() == 0
    assert [r.event_id for r in scan.timeline(g).orderBy("position").collect()] == ["z", "y", "x"]
    m = scan.manifest(g).first()
    assert (m.node_count, m.edge_count, m.nodes, m.event_ids) == (3, 3, ["A", "B", "C"], ["z", "y", "x"])
    assert scan.event(g, "none").count() == 0
    assert [r.step for r in scan.split_at(g, T0).orderBy("ingest_seq").collect()] == [0, 0, 1]


def test_time_filters_reach_the_scan(spark, tmp_path):
    graph(spark, *CHAIN).write.parquet(f"{tmp_path}/t")
    plan = scan.outgoing(spark.read.parquet(f"{tmp_path}/t"), "B", T0, T0).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,completed)" in plan and "IsNotNull(occurred_at)" in plan and "amount_minor_units" not in plan.split("ReadSchema")[1]


def test_results_do_not_depend_on_partitioning(spark):
    g = graph(spark, *[(f"e{i}", f"a{i % 7}", f"a{(i * 3 + 1) % 7}", i % 13) for i in range(80)])
    run = lambda d: sorted(map(str, motifs.fan_out(d, 3600, 2).collect() + traverse.downstream(d, named(spark, "a1")).collect()))
    assert run(g) == run(g.repartition(5, F.rand(1)))


def test_ancestors_by_bitsets_and_by_levels(spark):
    rng = random.Random(8)
    cases = {f"c{n}": [(f"e{i}", f"a{rng.randrange(12 + n)}", f"a{rng.randrange(12 + n)}", i % 9, 5, "completed" if i % 6 else "failed") for i in range(14)] for n in range(6)}
    g = graph(spark, *cases["c0"], case="c0")
    for c in list(cases)[1:]:
        g = g.unionByName(graph(spark, *cases[c], case=c))
    of = spark.createDataFrame([(c, f"a{k}") for c in cases for k in range(0, 18, 2)] + [("none", "a1"), ("c0", "a2")], "case_id string, account string")
    want = set()
    for c, rows in cases.items():
        into = {}
        for _, a, b, *rest in rows:
            if rest[2] == "completed":
                into.setdefault(b, set()).add(a)
        for k in range(0, 18, 2):
            seen, todo = set(), [f"a{k}"]
            while todo:
                for x in into.get(todo.pop(), ()):
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            want |= {(c, f"a{k}", x) for x in seen if x != f"a{k}"}
    for most in (20_000, 13, 1):
        rows = [tuple(r) for r in traverse.upstream(g, of, bitset_accounts=most).select("case_id", "account", "ancestor").collect()]
        assert len(rows) == len(want) and set(rows) == want


def test_ancestors_of_large_cases_by_connected_parts(spark, monkeypatch):
    """Cases beyond the bitsets are taken apart, so no part goes level by level that fits a task."""
    links = [("A", "B"), ("B", "C"), ("D", "E"), ("E", "D"), ("F", "G"), ("H", "I"), ("I", "J"), ("J", "K"), ("H", "K"), ("K", "L")]
    g = graph(spark, *((f"e{i}", a, b, i) for i, (a, b) in enumerate(links)))
    of = named(spark, *"ABCDEFGHIJKLZ")
    want = sorted(tuple(r) for r in traverse.upstream(g, of).select("account", "ancestor").collect())
    assert len(want) == 16
    levels = []
    slow = traverse._upstream_by_levels
    monkeypatch.setattr(traverse, "_upstream_by_levels", lambda rest, asked: levels.append(1) or slow(rest, asked))
    for most, by_levels in ((5, 0), (4, 1), (2, 1)):
        for task_links in (100, 3):
            levels.clear()
            got = traverse.upstream(g, of, bitset_accounts=most, task_links=task_links).select("account", "ancestor").collect()
            assert (sorted(map(tuple, got)), len(levels)) == (want, by_levels)


def test_pairs_of_an_institution_alone_are_made_of_finished_features(spark):
    """Rounding ten features of every pair took most of the time; they are those of the candidate."""
    g = graph(spark, ("e1", "A", "B", 0), ("e2", "C", "D", 1), ("e3", "C", "A", 2))
    banks = spark.createDataFrame([(a, "X") for a in "ABCD"], "account string, institution string")
    found = features.next_hop_features(g, at(spark, 5), None, banks, digits=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    met = next(i for i, line in enumerate(plan) if "strategy=merge" in line)
    assert not any("round(" in line for line in plan[met - 4 : met + 1]) and any("round(" in line for line in plan[met:])
    whole = features.next_hop_features(g, at(spark, 5), None, banks)
    keys = ("case_id", "source", "candidate")
    rounded = whole.select(*keys, *(F.round(c, 1).alias(c) for c in whole.columns if c not in keys))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rounded.collect())) and found.count() == 12
