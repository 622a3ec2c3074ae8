"""Registered queries of ingestion and of the evaluation harness over the observed transfers, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import evaluate, pareto, risk, scan, taint, traverse
from weirflow.plans.queries import _ALLOC, _OPTIONS, LIMITS, _options, _register, _with
from weirflow.schema import flatten
from weirflow.sources.events import deduplicated, parse_events
from weirflow.sources.transfers import transfers

# ---- ingestion --------------------------------------------------------------------------------------

_PROBLEMS = """concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'sender' END, CASE WHEN event_id % 7 = 0 THEN 'currency' END, CASE WHEN event_id % 5 = 0 THEN 'occurred_at' END, CASE WHEN event_id % 13 = 0 THEN 'unknown field note' END)"""


def _as_json(spark: SparkSession, d: str) -> DataFrame:
    """Transfers as JSON events, some of which break the contract."""
    id_, stamp = F.col("event_id"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    account = lambda c, bank: F.struct(c.cast("string").alias("account_id"), F.col(bank).alias("institution"))
    moves = transfers(spark, d)
    return moves.select(
        F.to_json(
            F.struct(
                F.lit("1.0.0").alias("schema_version"), id_.cast("string").alias("event_id"), "transaction_id",
                account(F.when(id_ % 11 == 0, "").otherwise(F.col("sender").cast("string")), "sender_inst").alias("sender"), account(F.col("receiver"), "receiver_inst").alias("receiver"),
                "amount_minor_units", F.when(id_ % 7 == 0, "inr").otherwise("INR").alias("currency"), F.concat(stamp("occurred_at"), F.when(id_ % 5 == 0, "").otherwise("Z")).alias("occurred_at"),
                F.concat(stamp("observed_at"), F.lit("+05:30")).alias("observed_at"), "status", "channel", F.lit("bank_feed").alias("origin"), F.when(id_ % 13 == 0, "x").alias("note"),
            )
        ).alias("value")
    )


@_register("parsed_events", _with(f"SELECT CAST(event_id AS VARCHAR) AS event_id, {_PROBLEMS} AS problems FROM transfers"))
def parsed_events(spark: SparkSession, d: str) -> DataFrame:
    """Every event's broken rules."""
    rows = parse_events(_as_json(spark, d))
    return rows.select(F.col("event.event_id").alias("event_id"), F.array_join("problems", ",").alias("problems"))


@_register(
    "accepted_events",
    _with(f"""SELECT CAST(event_id AS VARCHAR) AS event_id, transaction_id, CAST(sender AS VARCHAR) AS sender, CAST(receiver AS VARCHAR) AS receiver, sender_inst, receiver_inst, amount_minor_units, status,
        date_trunc('second', occurred_at) AS occurred_at, date_trunc('second', observed_at) - INTERVAL 330 MINUTE AS observed_at FROM transfers WHERE {_PROBLEMS} = ''"""),
)
def accepted_events(spark: SparkSession, d: str) -> DataFrame:
    """Events without a broken rule, flat; two deliveries of an event count once."""
    rows = parse_events(_as_json(spark, d).unionByName(_as_json(spark, d))).where(F.size("problems") == 0)
    flat = flatten(rows.select("event.*", F.lit(0).cast("bigint").alias("ingest_seq"))).withColumn("case_id", F.lit("all"))
    names = ["event_id", "transaction_id", "sender", "receiver", "sender_inst", "receiver_inst", "amount_minor_units", "status"]
    return deduplicated(flat).select(*names, *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("occurred_at", "observed_at")))


# ---- coverage and audit ------------------------------------------------------------------------------


def _marked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense transfers as a labelled world (a third of them fraud), and their allocations."""
    moves = transfers(spark, d, dense=True).withColumn("case_id", F.concat(F.lit("case-"), "case_id"))
    first = scan.active(moves).where("amount_minor_units > 0").groupBy("case_id").agg(F.min_by(F.struct("transaction_id", "amount_minor_units"), F.struct("occurred_at", "ingest_seq")).alias("s"))
    seeds = first.select("case_id", F.col("s.transaction_id").alias("transaction_id"), F.col("s.amount_minor_units").alias("tainted_amount"), F.concat_ws(":", "case_id", "s.transaction_id").alias("source_id"))
    world = moves.join(seeds.select("case_id", "transaction_id", F.lit(True).alias("seed")), ["case_id", "transaction_id"], "left")
    mark = F.when(F.col("seed"), "seed").when(F.col("event_id") % 3 == 0, "fraud").otherwise("legit")
    world = world.withColumns({"mark": mark, "family": F.when(F.col("event_id") % 2 == 0, "smurfing").otherwise("fan_out")}).drop("seed")
    return world, traverse.cut_lineage(taint.allocations(moves, seeds))


_AUDIT = f"""{_ALLOC}, re AS (SELECT case_id, CAST(0 AS BIGINT) AS n, CAST(list_transform(range(20), lambda i: NULL) AS BIGINT[]) AS r FROM s
        UNION ALL SELECT re.case_id, re.n + 1, list_transform(re.r, lambda x, i: CASE WHEN i = al.receiver + 1 AND (al.is_seed OR re.r[al.sender + 1] IS NOT NULL) THEN coalesce(x, re.n) ELSE x END) FROM re JOIN al ON al.case_id = re.case_id AND al.sequence = re.n),
    rd AS (SELECT case_id, unnest(range(20)) AS sender, unnest(arg_max(r, n)) AS reached FROM re GROUP BY case_id), og AS (SELECT case_id, sender, true AS from_source FROM al WHERE is_seed),
    ed AS (SELECT al.*, CASE WHEN event_id % 2 = 0 THEN 'smurfing' ELSE 'fan_out' END AS family, reached, is_seed OR coalesce(reached < sequence, false) AS ok, coalesce(from_source, false) AS src
        FROM al LEFT JOIN rd USING (case_id, sender) LEFT JOIN og USING (case_id, sender) WHERE is_seed OR event_id % 3 = 0),
    au AS (SELECT *, CASE WHEN tainted > 0 THEN NULL WHEN NOT ok AND reached > sequence THEN 'temporal ordering' WHEN NOT ok AND family = 'smurfing' AND src AND NOT is_seed THEN 'evaluation-definition mismatch'
        WHEN NOT ok THEN 'no upstream taint' WHEN tainted_before = 0 THEN 'no upstream taint' WHEN unattributed > 0 THEN 'observable-balance shortfall' ELSE 'actual implementation bug' END AS category FROM ed)"""


@_register("observed_audit", _with(f"{_AUDIT} SELECT 'case-' || case_id AS case_id, family, category, count(*) AS edges, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS reachable FROM au GROUP BY ALL", dense=True, recursive=True))
def observed_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.audit(*_marked(spark, d))
    return rows.groupBy("case_id", "family", "category").agg(F.count("*").alias("edges"), F.count_if("reachable").alias("reachable"))


@_register(
    "observed_coverage",
    _with(f"""{_AUDIT} SELECT family, count(*) AS fraud_edges, count(*) FILTER (tainted > 0) AS tainted_edges, count(*) FILTER (is_seed OR reached IS NOT NULL) AS reachable_edges, count(*) FILTER (tainted > 0 AND (is_seed OR reached IS NOT NULL)) AS tainted_reachable_edges,
        count(*) FILTER (is_seed OR balance_before > 0) AS backed_edges, count(*) FILTER (tainted > 0 AND (is_seed OR balance_before > 0)) AS tainted_backed_edges, count(*) FILTER (tainted > 0) AS rightly_attributed, count(*) FILTER (tainted > 0 AND clean > 0) AS commingled_edges,
        round(count(*) FILTER (tainted > 0) / count(*), 6) AS raw_coverage FROM au GROUP BY family""", dense=True, recursive=True),
)
def observed_coverage(spark: SparkSession, d: str) -> DataFrame:
    rows = evaluate.coverage(*_marked(spark, d))
    return rows.withColumn("raw_coverage", F.round("raw_coverage", 6)).drop("reachable_coverage", "backed_coverage")


@_register("reached_accounts", _with(f"{_AUDIT} SELECT 'case-' || case_id AS case_id, sender AS account, CAST(reached AS INTEGER) AS reached FROM rd WHERE reached IS NOT NULL", dense=True, recursive=True))
def reached_accounts(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.reach_sequence(_marked(spark, d)[1]).select("case_id", "account", "reached")


@_register("allocations_of_a_source", _with(f"{_ALLOC} SELECT case_id, event_id FROM al WHERE tainted > 0 AND case_id = (SELECT min(case_id) FROM s)", dense=True, recursive=True))
def allocations_of_a_source(spark: SparkSession, d: str) -> DataFrame:
    """What carries money of the first case's seed."""
    allocated = _marked(spark, d)[1]
    source = allocated.where("is_seed").orderBy("case_id").first()
    found = taint.allocations_for(allocated, source.contributions[0].source_id if source else "")
    return found.select(F.substring("case_id", 6, 10).alias("case_id"), "event_id")


@_register(
    "branch_preservation",
    _with(f"{_ALLOC}, br AS (SELECT DISTINCT case_id, sender, receiver FROM transfers WHERE event_id % 3 = 0 OR transaction_id IN (SELECT transaction_id FROM s)), kp AS (SELECT DISTINCT case_id, sender, receiver, 1 AS kept FROM al WHERE tainted > 0) SELECT 'case-' || case_id AS case_id, count(*) AS branches, count(kept) AS preserved FROM br LEFT JOIN kp USING (case_id, sender, receiver) GROUP BY case_id", dense=True, recursive=True),
)
def branch_preservation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.branch_preservation(*_marked(spark, d))


# ---- strategies ---------------------------------------------------------------------------------------

# measures that stand for risk, taint and value among the candidates of the observed transfers
_MEASURES = {"highest_risk": "affected_edges", "highest_tainted_balance": "affected_accounts", "highest_transaction_value": "legitimate", "maximum_immediate_recovery": "intercepted"}
_PICKS = " UNION ALL ".join(
    f"SELECT case_id, intervention_id, '{name}' AS strategy FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY {measure} DESC, intervention_id) AS n FROM j WHERE feasible) WHERE n = 1" for name, measure in _MEASURES.items()
)
_CHOSEN = f"""{_OPTIONS}, ow AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY intercepted DESC, legitimate, eff DESC, affected_accounts, affected_edges, intervention_id) AS n FROM fr),
    pi AS ({_PICKS} UNION ALL SELECT case_id, intervention_id, 'pareto' FROM ow WHERE n = 1), ca AS (SELECT case_id, coalesce(hour(min(occurred_at) FILTER (status = 'completed')) >= 1, false) AS cold FROM transfers GROUP BY case_id), nm AS (SELECT unnest(['{"', '".join((*_MEASURES, "pareto"))}']) AS strategy),
    tc AS (SELECT case_id, intercepted, legitimate, count(*) AS ties FROM j WHERE feasible GROUP BY ALL),
    ch AS (SELECT ca.case_id, cold, coalesce((SELECT ties FROM tc WHERE tc.case_id = j.case_id AND tc.intercepted = j.intercepted AND tc.legitimate = j.legitimate), 0) AS ties, nm.strategy, pi.intervention_id, pi.intervention_id IS NOT NULL AS ok, coalesce(intercepted, 0) AS i, coalesce(legitimate, 0) AS l, coalesce(affected_accounts, 0) AS ac, coalesce(affected_edges, 0) AS ae,
        pi.intervention_id IN (SELECT fr.intervention_id FROM fr WHERE fr.case_id = ca.case_id) AS eff FROM ca CROSS JOIN nm LEFT JOIN pi ON pi.case_id = ca.case_id AND pi.strategy = nm.strategy LEFT JOIN j ON j.case_id = ca.case_id AND j.intervention_id = pi.intervention_id)"""


def _chosen(spark: SparkSession, d: str) -> DataFrame:
    rows = traverse.cut_lineage(pareto.ranked(_options(spark, d), LIMITS, named=False))
    picks = rows.where("selected").withColumn("strategy", F.lit(evaluate.OWN))
    for name, measure in _MEASURES.items():
        picks = picks.unionByName(pareto.baseline_choice(rows, measure, account_holds_only=False).withColumn("strategy", F.lit(name)))
    moves = transfers(spark, d)
    cases = moves.groupBy("case_id").agg((F.hour(F.min(F.when(F.col("status") == "completed", F.col("occurred_at")))) >= 1).alias("cold_start"))
    return evaluate.choices(picks, cases, rows)


@_register(
    "observed_strategy_totals",
    _with(f"""{_CHOSEN} SELECT strategy, count(*) AS scenarios, count(*) FILTER (ok) AS feasible, CAST(sum(i) AS BIGINT) AS recovery, CAST(sum(l) AS BIGINT) AS collateral, CAST(sum(ac) AS BIGINT) AS accounts, CAST(sum(ae) AS BIGINT) AS edges, count(*) FILTER (eff) AS pareto_efficient, count(*) FILTER (cold) AS cold_start_scenarios,
        round(CASE WHEN sum(l) > 0 THEN sum(i) / sum(l) WHEN sum(i) > 0 THEN sum(i) END, 6) AS efficiency, round(count(*) FILTER (ok) / count(*), 6) AS compliance FROM ch GROUP BY strategy""", dense=True),
)
def observed_strategy_totals(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.strategy_totals(_chosen(spark, d)).withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("efficiency", "compliance")})


@_register(
    "observed_advantages",
    _with(f"{_CHOSEN} SELECT x.case_id, x.strategy, CAST(p.i - x.i AS BIGINT) AS recovery_advantage, CAST(x.l - p.l AS BIGINT) AS collateral_reduction FROM ch x JOIN ch p ON p.case_id = x.case_id AND p.strategy = 'pareto' WHERE x.strategy <> 'pareto'", dense=True),
)
def observed_advantages(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.advantages(_chosen(spark, d)).drop("efficiency_improvement")


@_register(
    "observed_findings",
    _with(f"""{_CHOSEN}, pv AS (SELECT case_id, max(i) FILTER (strategy = 'highest_risk' AND ok) AS r, max(i) FILTER (strategy = 'highest_tainted_balance' AND ok) AS t, max(i) FILTER (strategy = 'maximum_immediate_recovery' AND ok) AS mi, max(l) FILTER (strategy = 'maximum_immediate_recovery' AND ok) AS ml,
            max(i) FILTER (strategy = 'pareto' AND ok) AS p, max(l) FILTER (strategy = 'pareto' AND ok) AS pl, bool_or(ok AND l = 0) AS free, max(ties) AS ties FROM ch GROUP BY case_id)
        SELECT case_id, concat_ws(',', CASE WHEN r < t THEN 'highest_risk_loses_to_taint' END, CASE WHEN ml > pl THEN 'maximum_recovery_has_more_collateral' END, CASE WHEN ties > 1 THEN 'multiple_strategies_tie' END, CASE WHEN p IS NULL THEN 'no_feasible_intervention' END, CASE WHEN p < mi THEN 'pareto_lower_recovery' END,
            CASE WHEN free THEN 'zero_collateral_intervention' END) AS findings FROM pv""", dense=True),
)
def observed_findings(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.findings(_chosen(spark, d)).select("case_id", F.array_join("findings", ",").alias("findings"))


@_register(
    "robust_choice",
    _with(f"{_OPTIONS}, rb AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY intercepted // 1000 DESC, legitimate // 1000, affected_edges % 5 DESC, affected_accounts, affected_edges, CAST(sender AS VARCHAR)) AS n FROM j WHERE feasible) SELECT case_id, intervention_id FROM rb WHERE n = 1", dense=True),
)
def robust_choice(spark: SparkSession, d: str) -> DataFrame:
    """Coarse figures, so that every part of the order decides somewhere."""
    rows = pareto.judged(_options(spark, d), LIMITS).withColumns({
        "expected_intercepted": F.expr("intercepted div 1000"), "worst_legitimate": F.expr("legitimate div 1000"), "worst_intercepted": F.col("affected_edges") % 5,
        "kind": F.lit("account_hold"), "target_account": F.col("sender"), "target_event": F.lit(None).cast("bigint"),
    })
    return pareto.robust_choice(rows).select("case_id", "intervention_id")


@_register(
    "negative_control",
    "SELECT strftime(ts, '%Y-%m-%d') AS case_id, count(*) AS n, round(avg(CASE WHEN (event_id * 37 % 101) / 100.0 >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS false_positive_rate FROM events WHERE event_type <> 'error' GROUP BY 1",
)
def negative_control(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("case_id"), (F.col("event_type") == "error").cast("int").alias("label"), (F.col("event_id") * 37 % 101 / 100.0).alias("score")
    )
    return risk.false_positive_rate(rows).withColumn("false_positive_rate", F.round("false_positive_rate", 6))


@_register(
    "observed_world_summary",
    _with(_ALLOC + """ SELECT CASE WHEN event_id % 2 = 0 THEN 'smurfing' ELSE 'fan_out' END AS family, count(*) AS transactions, count(DISTINCT case_id) AS cases, CAST(sum(amount_minor_units) AS BIGINT) AS volume, CAST(sum(CASE WHEN fraud THEN amount_minor_units ELSE 0 END) AS BIGINT) AS fraud_volume,
        CAST(sum(CASE WHEN fraud THEN 0 ELSE amount_minor_units END) AS BIGINT) AS legit_volume, count(*) FILTER (fraud) AS fraud_transactions, (SELECT count(DISTINCT x) FROM (SELECT event_id, sender AS x FROM transfers UNION ALL SELECT event_id, receiver FROM transfers) u WHERE u.event_id % 2 = min(m.event_id % 2)) AS accounts
        FROM (SELECT *, event_id % 3 = 0 OR transaction_id IN (SELECT transaction_id FROM s) AS fraud FROM transfers) m GROUP BY family, event_id % 2""", dense=True, recursive=True),
)
def observed_world_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.world_summary(_marked(spark, d)[0]).drop("volume_text")


# ---- observation times by id prefix --------------------------------------------------------------------


@_register(
    "prefix_observation_times",
    _with("""SELECT p AS prefix, CAST(min(t) + floor((max(t) - min(t)) * 0.85) AS BIGINT) AS as_of_micros
        FROM (SELECT unnest(range(1, 10)) AS p) JOIN (SELECT CAST(sender AS VARCHAR) AS a, CAST(receiver AS VARCHAR) AS b, epoch_us(occurred_at) AS t FROM transfers) ON starts_with(a, CAST(p AS VARCHAR)) OR starts_with(b, CAST(p AS VARCHAR)) GROUP BY p"""),
)
def prefix_observation_times(spark: SparkSession, d: str) -> DataFrame:
    prefixes = spark.range(1, 10).select(F.col("id").cast("string").alias("prefix"))
    found = risk.prefix_observation_times(transfers(spark, d), prefixes)
    return found.select(F.col("prefix").cast("bigint").alias("prefix"), "as_of_micros")
