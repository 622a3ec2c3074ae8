import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import graph
from weirflow.operators import evaluate, risk, taint
from weirflow.plans.queries import QUERIES, institutions_of
from weirflow.sources import events, synthetic
from weirflow.sources.transfers import seeds, transfers
from weirflow.streaming import stream

SF = "/root/testdata/sf0.001"


def event(n, **over):
    base = {
        "event_id": f"e{n}", "transaction_id": f"t{n}", "sender": {"account_id": "A", "institution": "B1"}, "receiver": {"account_id": "B"}, "amount_minor_units": 5, "currency": "INR",
        "occurred_at": "2026-01-01T10:00:00+00:00", "observed_at": "2026-01-01T15:30:01+05:30", "status": "completed", "channel": "upi", "origin": "bank_feed",
    }
    return base | over


def lines(spark, *texts):
    return spark.createDataFrame([(t if isinstance(t, str) else json.dumps(t),) for t in texts], "value string")


def test_batches_are_taken_whole_or_not_at_all(spark):
    good = events.ingest(lines(spark, [event(1), event(2)]), None, "case-1")
    rows = good.orderBy("ingest_seq").collect()
    assert [(r.event_id, r.sender, r.sender_inst, r.ingest_seq, r.case_id) for r in rows] == [("e1", "A", "B1", 0, "case-1"), ("e2", "A", "B1", 1, "case-1")]
    assert (rows[0].observed_at - rows[0].occurred_at).total_seconds() == 1
    more = events.ingest(lines(spark, event(3)), good, "case-1").first()
    assert more.ingest_seq == 2
    one = events.ingest(lines(spark, event(1)), None, "case-1")
    two = events.ingest(lines(spark, event(2)), one, "case-1")
    three = events.ingest(lines(spark, [event(3), event(4)]), one.unionByName(two), "case-1")
    assert [r.ingest_seq for d in (one, two, three) for r in d.orderBy("ingest_seq").collect()] == [0, 1, 2, 3]
    for bad, why in [
        ([event(1), event(1)], "duplicate event_id"), ([event(4, currency="inr")], "currency"), ([event(4, occurred_at="2026-01-01T10:00:00")], "occurred_at"),
        ([event(4, amount_minor_units=-1)], "amount_minor_units"), ([event(4, status="odd")], "status"), ([event(4, extra=1)], "unknown field extra"), ("not json", "json"),
    ]:
        with pytest.raises(events.Rejected) as caught:
            events.ingest(lines(spark, bad), None, "case-1").collect()
        assert any(why in reasons for _, reasons in caught.value.rows), why
    with pytest.raises(events.Rejected, match="event exists"):
        events.ingest(lines(spark, event(2)), good, "case-1")


def test_tables_by_case(spark, tmp_path):
    path = f"{tmp_path}/t"
    events.append(graph(spark, ("a", "A", "B", 0), case="1"), path)
    events.append(graph(spark, ("a", "A", "B", 0), ("b", "A", "B", 1), case="2"), path)
    assert events.read(spark, path).count() == 3 and events.read(spark, path, "2").count() == 2 and events.exists(events.read(spark, path), "b")
    plan = events.read(spark, path, "2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(case_id" in plan
    assert events.deduplicated(events.read(spark, path, "2").union(events.read(spark, path, "2"))).count() == 2
    with pytest.raises(events.Rejected):
        events.new_cases(spark.createDataFrame([("1",)], "case_id string"), spark.createDataFrame([("1",)], "case_id string"))
    cases = f"{tmp_path}/cases"
    spark.createDataFrame([("7", "t", ["a", "b"])], "case_id string, title string, transaction_ids array<string>").write.json(cases)
    known = events.read_cases(spark, cases)
    assert (known.first().case_id, known.first().transaction_ids, known.first().status) == ("7", ["a", "b"], None)
    assert events.new_cases(spark.createDataFrame([("8",)], "case_id string"), known).count() == 1
    events.write_json(spark.sql("SELECT 1.50BD AS x"), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().x == "1.50"


def test_synthetic_worlds(spark):
    world = synthetic.synthetic_world(spark, 42, 3)
    again = synthetic.synthetic_world(spark, 42, 3, partitions=2)
    assert sorted(map(str, world.collect())) == sorted(map(str, again.collect()))
    assert world.select("event_id").distinct().count() == world.count() and world.select("family").distinct().count() == 10
    assert synthetic.synthetic_world(spark, 7, 1).agg(F.sum("amount_minor_units")).first()[0] != synthetic.synthetic_world(spark, 42, 1).agg(F.sum("amount_minor_units")).first()[0]
    marked = synthetic.world_seeds(world)
    assert taint.check_seeds(world, marked).count() == 0
    truth = {r.family: r for r in synthetic.world_truth(world).collect()}
    assert truth["benign_high_volume_merchant"].fraud_transaction_ids == [] and len(truth["fan_in"].seed_transaction_ids) == 3
    allocated = taint.allocations(world, marked)
    assert {r.error for r in taint.conservation(allocated, marked).collect()} == {0}
    cover = {r.family: r for r in evaluate.coverage(world, allocated).collect()}
    assert cover["simple_chain"].raw_coverage == 1.0 and cover["smurfing"].raw_coverage == 0.25 and all(r.reachable_coverage in (None, 1.0) for r in cover.values())
    kinds = {(r.family, r.category) for r in evaluate.audit(world, allocated).where("category IS NOT NULL").collect()}
    assert kinds == {("smurfing", "evaluation-definition mismatch")}


def test_strategies(spark):
    world = synthetic.synthetic_world(spark, 42, 1)
    chosen, _ = evaluate.strategies(world, synthetic.world_seeds(world), synthetic.world_times(world))
    totals = {r.strategy: r for r in evaluate.strategy_totals(chosen).collect()}
    assert float(totals["pareto"].compliance) == 0.8  # merchant and smurfing offer nothing to hold
    assert totals["pareto"].recovery == max(t.recovery for t in totals.values()) and totals["pareto"].pareto_efficient == 8
    assert {r.recovery_advantage >= 0 for r in evaluate.advantages(chosen).collect()} == {True}
    found = {r.case_id.rsplit("-", 1)[0]: r.findings for r in evaluate.findings(chosen).collect()}
    assert "no_feasible_intervention" in found["case-smurfing"]


def test_risk_model(spark, tmp_path):
    world = synthetic.synthetic_world(spark, 42, 6)
    ends = world.groupBy("case_id").agg(F.max("occurred_at").alias("as_of"))
    fraud = world.where("mark <> 'legit'").select("case_id", F.col("receiver").alias("account"))
    rows = risk.labelled_features(world, ends, fraud, institutions_of(world)).cache()
    model = risk.BoostedModel(risk.ACCOUNT_FEATURES, 8).fit(rows)
    scored = model.score(rows)
    m = risk.binary_metrics(scored).first()
    assert m.roc_auc > 0.85 and 0 <= m.brier < 0.2
    model.save(f"{tmp_path}/m")
    loaded = risk.BoostedModel.load(spark, f"{tmp_path}/m").score(rows)
    assert scored.join(loaded.select("case_id", "account", F.col("score").alias("s2")), ["case_id", "account"]).where("abs(score - s2) > 1e-9").count() == 0
    p = risk.risk_predictions(scored).collect()
    assert all(0 <= r.risk_score <= 1 and r.confidence <= 0.55 for r in p if r.evidence_maturity == "limited_evidence")
    assert {r.cohort for r in risk.cold_start_comparison(model, rows).collect()} <= {"cold", "warm", "warm_masked"}
    assert risk.evidence_envelopes(risk.risk_predictions(scored)).select("evidence_id").distinct().count() > 0
    with pytest.raises(ValueError):
        risk.BoostedModel(risk.ACCOUNT_FEATURES, 2).fit(rows.where("label = 1"))


def drain(spark, stream_df, name):
    query = stream_df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_running_taint_equals_the_batch(spark, tmp_path):
    moves = transfers(spark, SF, dense=True)
    marked = seeds(moves)
    batch = {r.event_id: (r.tainted, r.clean, r.unattributed) for r in taint.allocations(moves, marked).collect()}
    last = moves.agg(F.max("occurred_at")).first()[0]
    end = moves.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "transaction_id": F.lit("end"), "case_id": F.lit("end"), "status": F.lit("completed"), "occurred_at": F.lit(last) + F.expr("INTERVAL 30 DAYS")})
    path = f"{tmp_path}/in"
    moves.orderBy("occurred_at").coalesce(1).write.parquet(path)
    end.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")).write.mode("append").parquet(path)
    source = spark.readStream.schema(moves.schema).option("maxFilesPerTrigger", 1).parquet(path)
    by_tx = {r.transaction_id: {r.source_id: r.tainted_amount} for r in marked.collect()}
    got = {r.event_id: (r.tainted, r.clean, r.unattributed) for r in drain(spark, stream.running_taint(source, by_tx), "taint_out") if r.event_id >= 0}
    assert got == batch


def test_stream_dedup_and_velocity(spark, tmp_path):
    moves = transfers(spark, SF)
    path = f"{tmp_path}/in"
    moves.union(moves).write.parquet(path)
    source = spark.readStream.schema(moves.schema).parquet(path)
    assert len(drain(spark, stream.deduplicated(source).select("event_id"), "dedup_out")) == moves.count()
    assert stream.velocity(source).isStreaming and stream.sessions(source).isStreaming
    assert stream.velocity(moves, "1 hour").agg(F.sum("transfers")).first()[0] == moves.where("status = 'completed'").count()


def test_every_query_has_rows_and_plain_names(spark):
    for name in ("fan_out", "account_features", "network_arcs", "pareto_ranks", "taint_trace"):
        out = QUERIES[name](spark, SF)
        assert out.count() > 0 and all(c.isidentifier() for c in out.columns)
