"""Registered queries of the transfer operators, most with SQL that gives the same rows.

Cases are days; each case's decision time is noon (of a month: noon of its 16th day). Doubles are rounded and
lists are joined to text so that rows compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.functions.columns import confidence, evidence_signals, proportional_allocation, rupees
from weirflow.operators import chokepoint, counterfactual, evaluate, features, flow, forecast, motifs, pareto, risk, scan, taint, traverse
from weirflow.plans.investigate import Request, investigate
from weirflow.sources.transfers import seeds, transfers, transfers_sql
from weirflow.streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3600


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return put


def _with(body: str, dense: bool = False, ties: bool = False, recursive: bool = False, monthly: bool = False) -> str:
    """SQL over ``transfers`` and its active part ``a``."""
    noon = "'-16 12:00:00'" if monthly else "' 12:00:00'"
    return f"WITH {'RECURSIVE' if recursive else ''} transfers AS ({transfers_sql(dense, ties, monthly)}), a AS (SELECT * FROM transfers WHERE status = 'completed'), times AS (SELECT DISTINCT case_id, CAST(case_id || {noon} AS TIMESTAMP) AS as_of FROM transfers) {body}"


def _joined(c: str | Column) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def times_of(moves: DataFrame, hour: str = "12:00:00", day: str = "") -> DataFrame:
    return moves.select("case_id").distinct().withColumn("as_of", F.to_timestamp_ntz(F.concat("case_id", F.lit(f"{day} {hour}"))))


def institutions_of(moves: DataFrame) -> DataFrame:
    return moves.select(F.col("sender").alias("account"), F.col("sender_inst").alias("institution")).union(moves.select("receiver", "receiver_inst")).distinct()


# ---- scans, ranges, projections ---------------------------------------------------------------

EDGES = "case_id, event_id, sender, receiver, amount_minor_units, occurred_at"


@_register("active_edges", _with(f"SELECT {EDGES} FROM a"))
def active_edges(spark: SparkSession, d: str) -> DataFrame:
    return scan.active(scan.edges(transfers(spark, d))).select(*EDGES.split(", "))


@_register("events_between", _with(f"SELECT {EDGES} FROM a WHERE occurred_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10 06:00:00'"))
def events_between(spark: SparkSession, d: str) -> DataFrame:
    span = [F.to_timestamp_ntz(F.lit(t)) for t in ("2024-01-05 00:00:00", "2024-01-10 06:00:00")]
    return scan.between(transfers(spark, d), *span).select(*EDGES.split(", "))


@_register("outgoing_window", _with(f"SELECT {EDGES} FROM a WHERE sender = 3 AND occurred_at >= TIMESTAMP '2024-01-03'"))
def outgoing_window(spark: SparkSession, d: str) -> DataFrame:
    return scan.outgoing(transfers(spark, d), 3, F.to_timestamp_ntz(F.lit("2024-01-03 00:00:00"))).select(*EDGES.split(", "))


@_register("incoming_window", _with(f"SELECT {EDGES} FROM transfers WHERE receiver = 3 AND occurred_at <= TIMESTAMP '2024-01-20'"))
def incoming_window(spark: SparkSession, d: str) -> DataFrame:
    return scan.incoming(transfers(spark, d), 3, None, F.to_timestamp_ntz(F.lit("2024-01-20 00:00:00")), active_only=False).select(*EDGES.split(", "))


@_register("event_lookup", _with(f"SELECT {EDGES}, status, channel FROM transfers WHERE event_id = 17"))
def event_lookup(spark: SparkSession, d: str) -> DataFrame:
    return scan.event(transfers(spark, d), 17).select(*EDGES.split(", "), "status", "channel")


@_register("account_nodes", _with("SELECT case_id, sender AS account FROM transfers UNION SELECT case_id, receiver FROM transfers"))
def account_nodes(spark: SparkSession, d: str) -> DataFrame:
    return scan.accounts(transfers(spark, d))


@_register(
    "node_flow_totals",
    _with("""SELECT case_id, account, CAST(sum(i) AS BIGINT) AS total_inflow, CAST(sum(o) AS BIGINT) AS total_outflow, count(*) AS transaction_count FROM (
        SELECT case_id, sender AS account, 0 AS i, amount_minor_units AS o FROM transfers UNION ALL SELECT case_id, receiver, amount_minor_units, 0 FROM transfers) GROUP BY ALL"""),
)
def node_flow_totals(spark: SparkSession, d: str) -> DataFrame:
    return scan.node_totals(transfers(spark, d))


@_register("case_timeline", _with("SELECT case_id, event_id, status, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at, ingest_seq) - 1 AS position FROM transfers", ties=True))
def case_timeline(spark: SparkSession, d: str) -> DataFrame:
    return scan.timeline(transfers(spark, d, ties=True)).select("case_id", "event_id", "status", F.col("position").cast("bigint").alias("position"))


@_register(
    "case_graph_manifest",
    _with("""SELECT case_id, node_count, edge_count, nodes, event_ids FROM
        (SELECT case_id, count(*) AS edge_count, string_agg(event_id, ',' ORDER BY occurred_at, ingest_seq) AS event_ids FROM transfers GROUP BY 1) JOIN
        (SELECT case_id, count(*) AS node_count, string_agg(n, ',' ORDER BY n) AS nodes FROM (SELECT case_id, sender AS n FROM transfers UNION SELECT case_id, receiver FROM transfers) GROUP BY 1) USING (case_id)"""),
)
def case_graph_manifest(spark: SparkSession, d: str) -> DataFrame:
    return scan.manifest(transfers(spark, d)).select("case_id", "node_count", "edge_count", _joined("nodes").alias("nodes"), _joined("event_ids").alias("event_ids"))


@_register("asof_snapshot", _with(f"SELECT {EDGES} FROM a JOIN times USING (case_id) WHERE occurred_at <= as_of"))
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    return scan.as_of(moves.join(times_of(moves), "case_id"), F.col("as_of")).select(*EDGES.split(", "))


_SEEDS = "s AS (SELECT case_id, transaction_id, amount_minor_units AS tainted_amount, 'case-' || case_id || ':' || transaction_id AS source_id, occurred_at FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at, ingest_seq) AS n FROM a WHERE amount_minor_units > 0) WHERE n = 1)"


@_register("seeds_in_history", _with(f", {_SEEDS} SELECT case_id, transaction_id, tainted_amount, source_id FROM s WHERE occurred_at <= CAST(case_id || ' 00:05:00' AS TIMESTAMP)"))
def seeds_in_history(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    known = scan.as_of(moves.join(times_of(moves, "00:05:00"), "case_id"), F.col("as_of"))
    return scan.seeds_in(seeds(moves), known).select("case_id", "transaction_id", "tainted_amount", "source_id")


@_register("history_split", _with("SELECT case_id, event_id, occurred_at <= as_of AS is_available, dense_rank() OVER (PARTITION BY case_id ORDER BY occurred_at) - 1 AS step FROM transfers JOIN times USING (case_id)", ties=True))
def history_split(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d, ties=True)
    return scan.split_at(moves.join(times_of(moves), "case_id"), F.col("as_of")).select("case_id", "event_id", "is_available", F.col("step").cast("bigint").alias("step"))


@_register(
    "normalised_events",
    _with("""SELECT case_id, event_id, transaction_id, CAST(sender AS VARCHAR) AS sender, CAST(receiver AS VARCHAR) AS receiver, occurred_at, amount_minor_units, status = 'completed' AS is_active, event_id % 5 = 0 AS is_forecast FROM transfers"""),
)
def normalised_events(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    hop = F.col("event_id") % 5 == 0
    observed = moves.where(~hop).withColumn("origin", F.lit("bank_feed"))
    expected = moves.where(hop).withColumn("probability", F.lit(0.5)).withColumnsRenamed({"sender": "sender_account_id", "receiver": "receiver_account_id"})
    out = scan.normalised(observed.unionByName(expected, allowMissingColumns=True))
    return out.select("case_id", "event_id", "transaction_id", "sender", "receiver", "occurred_at", "amount_minor_units", "is_active", "is_forecast")


@_register("eligible_events", _with("SELECT case_id, event_id FROM a JOIN times USING (case_id) WHERE occurred_at > as_of"))
def eligible_events(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d))
    return scan.eligible(moves.join(times_of(moves), "case_id"), F.col("as_of")).select("case_id", "event_id")


# ---- motifs -------------------------------------------------------------------------------------


def _burst_sql(hub: str, spoke: str, out_hub: str, out_spokes: str, ties: bool = False, hours: int = 6, k: int = 3) -> str:
    return _with(
        f""", w AS (SELECT x.case_id, x.{hub} AS hub, x.event_id, x.occurred_at AS ws, x.ingest_seq AS seq, max(y.occurred_at) AS we, count(DISTINCT y.{spoke}) AS k,
                array_to_string(list_sort(list_distinct(list(y.{spoke}))), ',') AS spokes, string_agg(y.event_id, ',' ORDER BY y.occurred_at, y.ingest_seq) AS event_ids
            FROM a x JOIN a y ON x.case_id = y.case_id AND x.{hub} = y.{hub} AND y.occurred_at BETWEEN x.occurred_at AND x.occurred_at + INTERVAL {hours} HOUR
                AND (y.occurred_at, y.ingest_seq) >= (x.occurred_at, x.ingest_seq) GROUP BY ALL),
            f AS (SELECT *, row_number() OVER (PARTITION BY case_id, hub ORDER BY ws, seq) AS n FROM w WHERE k >= {k})
        SELECT case_id, hub AS {out_hub}, ws AS window_start, we AS window_end, spokes AS {out_spokes}, event_ids FROM f WHERE n = 1""",
        ties=ties,
    )


@_register("fan_out", _burst_sql("sender", "receiver", "source", "targets"))
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    found = motifs.fan_out(transfers(spark, d), 6 * HOUR, 3)
    return found.select("case_id", "source", "window_start", "window_end", _joined("targets").alias("targets"), _joined("event_ids").alias("event_ids"))


@_register("fan_out_ties", _burst_sql("sender", "receiver", "source", "targets", ties=True))
def fan_out_ties(spark: SparkSession, d: str) -> DataFrame:
    found = motifs.fan_out(transfers(spark, d, ties=True), 6 * HOUR, 3)
    return found.select("case_id", "source", "window_start", "window_end", _joined("targets").alias("targets"), _joined("event_ids").alias("event_ids"))


@_register("fan_in", _burst_sql("receiver", "sender", "target", "sources"))
def fan_in(spark: SparkSession, d: str) -> DataFrame:
    found = motifs.fan_in(transfers(spark, d), 6 * HOUR, 3)
    return found.select("case_id", "target", "window_start", "window_end", _joined("sources").alias("sources"), _joined("event_ids").alias("event_ids"))


@_register(
    "rapid_pass_through",
    _with("""SELECT i.case_id, i.receiver AS account, i.event_id AS in_event_id, o.event_id AS out_event_id, epoch_us(o.occurred_at) - epoch_us(i.occurred_at) AS delay_micros
        FROM a i ASOF JOIN a o ON i.case_id = o.case_id AND i.receiver = o.sender AND i.occurred_at <= o.occurred_at WHERE epoch_us(o.occurred_at) - epoch_us(i.occurred_at) <= 3600000000"""),
)
def rapid_pass_through(spark: SparkSession, d: str) -> DataFrame:
    return motifs.rapid_pass_through(transfers(spark, d), HOUR).select("case_id", "account", "in_event_id", "out_event_id", "delay_micros")


@_register(
    "fan_out_fan_in",
    _burst_sql("sender", "receiver", "source", "targets", hours=24, k=2).replace(
        "SELECT case_id, hub AS source", ", o AS (SELECT case_id, hub AS source"
    ) + """), l AS (SELECT case_id, source, window_start, CAST(unnest(string_split(targets, ',')) AS BIGINT) AS mid FROM o)
        SELECT l.case_id, source, receiver AS target, array_to_string(list_sort(list_distinct(list(mid))), ',') AS intermediaries FROM l JOIN a ON a.case_id = l.case_id AND sender = mid AND occurred_at > window_start AND receiver <> source
        GROUP BY ALL HAVING count(DISTINCT mid) >= 2""",
)
def fan_out_fan_in(spark: SparkSession, d: str) -> DataFrame:
    found = motifs.fan_out_fan_in(transfers(spark, d), 24 * HOUR, 2)
    return found.select("case_id", "source", "target", _joined("intermediaries").alias("intermediaries"))


# ---- traversal ----------------------------------------------------------------------------------


_START = f"{_SEEDS}, st AS (SELECT s.case_id, receiver AS account FROM s JOIN a USING (case_id, transaction_id))"


def _seed_receivers(moves: DataFrame) -> DataFrame:
    return seeds(moves).join(moves.select("case_id", "transaction_id", "receiver"), ["case_id", "transaction_id"]).select("case_id", F.col("receiver").alias("account"))


@_register(
    "temporal_downstream",
    _with(
        f""", {_START}, w AS (SELECT case_id, event_id, receiver, occurred_at, 1 AS depth FROM a JOIN st USING (case_id) WHERE sender = account
            UNION SELECT a.case_id, a.event_id, a.receiver, a.occurred_at, w.depth + 1 FROM w JOIN a ON a.case_id = w.case_id AND a.sender = w.receiver AND a.occurred_at > w.occurred_at)
        SELECT case_id, event_id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY ALL""",
        recursive=True,
    ),
)
def temporal_downstream(spark: SparkSession, d: str) -> DataFrame:
    """All that the receiver of each case's seed can reach."""
    moves = transfers(spark, d)
    return traverse.downstream(moves, _seed_receivers(moves)).select("case_id", "event_id", "depth")


@_register(
    "temporal_paths",
    _with(
        """, e AS (SELECT case_id, receiver, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at, ingest_seq) AS n, row_number() OVER (PARTITION BY case_id ORDER BY occurred_at DESC, ingest_seq DESC) AS m FROM a),
            f AS (SELECT DISTINCT case_id, receiver AS source FROM e WHERE n <= 10), l AS (SELECT DISTINCT case_id, receiver AS target FROM e WHERE m <= 10), p AS (SELECT case_id, source, target FROM f JOIN l USING (case_id) WHERE source <> target),
            w AS (SELECT a.case_id, source, target, receiver AS at_, occurred_at AS t, [sender, receiver] AS seen, [event_id] AS ev FROM a JOIN p ON p.case_id = a.case_id AND sender = source WHERE receiver <> source
            UNION ALL SELECT a.case_id, w.source, w.target, a.receiver, a.occurred_at, list_append(w.seen, a.receiver), list_append(w.ev, a.event_id)
            FROM w JOIN a ON a.case_id = w.case_id AND a.sender = w.at_ AND a.occurred_at > w.t AND NOT list_contains(w.seen, a.receiver) WHERE len(w.ev) < 10 AND w.at_ <> w.target)
        SELECT case_id, source, target, array_to_string(ev, ',') AS events, CAST(len(ev) AS INTEGER) AS hops FROM w WHERE at_ = target""",
        recursive=True,
    ),
)
def temporal_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths from the receivers of each case's first ten transfers to those of its last ten."""
    moves = transfers(spark, d)
    edge = lambda *order: Window.partitionBy("case_id").orderBy(*order)
    ends = scan.active(moves).select("case_id", "receiver", F.row_number().over(edge("occurred_at", "ingest_seq")).alias("n"), F.row_number().over(edge(F.desc("occurred_at"), F.desc("ingest_seq"))).alias("m"))
    side = lambda c, name: ends.where(F.col(c) <= 10).select("case_id", F.col("receiver").alias(name)).distinct()
    pairs = side("n", "source").join(side("m", "target"), "case_id").where("source <> target")
    found = traverse.temporal_paths(moves, pairs)
    return found.select("case_id", "source", "target", _joined("events").alias("events"), F.size("events").alias("hops"))


@_register(
    "upstream_ancestors",
    _with(
        """, k AS (SELECT DISTINCT case_id, sender, receiver FROM a JOIN times USING (case_id) WHERE occurred_at <= as_of),
            w AS (SELECT case_id, receiver AS account, sender AS ancestor FROM k UNION SELECT k.case_id, w.account, k.sender FROM w JOIN k ON k.case_id = w.case_id AND k.receiver = w.ancestor)
        SELECT case_id, account, ancestor FROM w WHERE account <> ancestor""",
        recursive=True,
    ),
)
def upstream_ancestors(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    known = moves.join(times_of(moves), "case_id").where("occurred_at <= as_of")
    return traverse.upstream(known, scan.accounts(known))


# ---- features and next hops ---------------------------------------------------------------------

_LEGS = """k AS (SELECT a.*, as_of FROM a JOIN times USING (case_id) WHERE occurred_at <= as_of),
    l AS (SELECT case_id, sender AS account, receiver AS other, 'out' AS dir, amount_minor_units AS amt, occurred_at AS t, event_id, as_of FROM k
          UNION ALL SELECT case_id, receiver, sender, 'in', amount_minor_units, occurred_at, event_id, as_of FROM k)"""

_FEATURES = f""", {_LEGS},
    p AS (SELECT i.case_id, i.account, (epoch_us(o.t) - epoch_us(i.t)) / 1e6 AS d FROM (SELECT * FROM l WHERE dir = 'in') i ASOF JOIN (SELECT * FROM l WHERE dir = 'out') o ON i.case_id = o.case_id AND i.account = o.account AND i.t <= o.t),
    q AS (SELECT case_id, account, min(d) AS fastest, median(d) AS middle FROM p GROUP BY ALL),
    g AS (SELECT case_id, account, count(*) FILTER (dir = 'in') AS i, count(*) FILTER (dir = 'out') AS o, count(*) AS n, count(DISTINCT other) FILTER (dir = 'in') AS us, count(DISTINCT other) FILTER (dir = 'out') AS ur,
        count(DISTINCT other) AS uc, count(DISTINCT other % 4) AS banks, count(*) FILTER (other % 4 <> account % 4) AS crossed, min(t) AS t0, max(t) AS t1, max(as_of) AS at_,
        count(*) FILTER (t >= as_of - INTERVAL 1 HOUR) AS h1, count(*) FILTER (t >= as_of - INTERVAL 24 HOUR) AS h24, coalesce(sum(amt) FILTER (dir = 'in'), 0) AS si, coalesce(sum(amt) FILTER (dir = 'out'), 0) AS so,
        coalesce(max(amt) FILTER (dir = 'in'), 0) AS mi, coalesce(max(amt) FILTER (dir = 'out'), 0) AS mo, count(*) FILTER (t < as_of - INTERVAL 2 HOUR) AS old,
        coalesce((epoch_us(max(t) FILTER (t < as_of - INTERVAL 2 HOUR)) - epoch_us(min(t) FILTER (t < as_of - INTERVAL 2 HOUR))) / 1e6, 0) AS olds FROM l GROUP BY ALL),
    f AS (SELECT g.*, fastest, middle, (epoch_us(t1) - epoch_us(t0)) / 1e6 AS dur, old >= 3 AND olds >= 86400 AS prof FROM g LEFT JOIN q USING (case_id, account)),
    v AS (SELECT case_id, account, i AS in_degree, o AS out_degree, n AS total_degree, us AS unique_senders, ur AS unique_receivers, uc AS unique_counterparties, us + ur - uc AS bilateral_counterparties,
        i / greatest(1, n) AS fan_in_ratio, o / greatest(1, n) AS fan_out_ratio, banks AS institution_diversity, crossed / greatest(1, n) AS cross_institution_tx_ratio,
        (epoch_us(at_) - epoch_us(t0)) / 1e6 AS lifespan_seconds, dur AS active_duration_seconds, n / greatest(1.0, dur / 3600.0) AS tx_velocity_per_hour,
        coalesce(fastest, 86400) AS min_pass_through_seconds, coalesce(middle, 86400) AS median_pass_through_seconds, CASE WHEN fastest <= 300 THEN 1 ELSE 0 END AS has_rapid_pass_through,
        h1 AS tx_count_last_1h, h24 AS tx_count_last_24h, h1 / greatest(1, n) AS burst_ratio_1h, (epoch_us(at_) - epoch_us(t1)) / 1e6 AS time_since_last_tx_seconds,
        si AS total_inbound_amount, so AS total_outbound_amount, si - so AS net_flow_amount, CASE WHEN si > 0 THEN least(1.0, CAST(so AS DOUBLE) / si) ELSE 0 END AS forwarding_ratio,
        si / greatest(1, i) AS mean_inbound_amount, so / greatest(1, o) AS mean_outbound_amount, mi AS max_inbound_amount, mo AS max_outbound_amount,
        CASE WHEN si = 0 AND so = 0 THEN 1 ELSE CAST(least(si, so) AS DOUBLE) / greatest(1, greatest(si, so)) END AS inbound_outbound_amount_ratio, old AS historical_tx_count, olds AS historical_duration_seconds,
        CASE WHEN prof THEN 1 ELSE 0 END AS has_historical_profile, CASE WHEN old = 0 THEN 1 ELSE 0 END AS is_cold_start, CASE WHEN prof AND n >= 5 THEN 2 WHEN n <= 1 THEN 0 ELSE 1 END AS evidence_maturity_level FROM f)"""


def _features(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    times = times_of(moves).withColumn("history_cutoff", F.expr("as_of - INTERVAL 2 HOURS"))
    return features.account_features(moves, times, institutions_of(moves))


@_register("account_features", _with(f"{_FEATURES} SELECT case_id, account, {', '.join(f'round(CAST({n} AS DOUBLE) + 1e-8, 6) AS {n}' for n in features.ACCOUNT_FEATURES)} FROM v"))
def account_features(spark: SparkSession, d: str) -> DataFrame:
    # medians lie between microseconds: the small shift keeps them off rounding ties
    return _features(spark, d).select("case_id", "account", *(F.round(F.col(n) + 1e-8, 6).alias(n) for n in features.ACCOUNT_FEATURES))


_MONTHLY = _FEATURES.replace("INTERVAL 2 HOUR", "INTERVAL 24 HOUR")


def _monthly_features(spark: SparkSession, d: str) -> DataFrame:
    """Cases of a month, so that accounts have days of history."""
    moves = transfers(spark, d, monthly=True)
    return features.account_features(moves, times_of(moves, "12:00:00", "-16"), institutions_of(moves))


@_register("account_features_monthly", _with(f"{_MONTHLY} SELECT case_id, account, {', '.join(f'round(CAST({n} AS DOUBLE) + 1e-8, 6) AS {n}' for n in features.ACCOUNT_FEATURES)} FROM v", monthly=True))
def account_features_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _monthly_features(spark, d).select("case_id", "account", *(F.round(F.col(n) + 1e-8, 6).alias(n) for n in features.ACCOUNT_FEATURES))


_RULES = """array_to_string(list_filter([CASE WHEN forwarding_ratio >= 0.85 THEN 'forwarding_ratio:0.35' END, CASE WHEN forwarding_ratio < 0.15 AND in_degree > 3 THEN 'forwarding_ratio:-0.25' END,
    CASE WHEN has_rapid_pass_through = 1 AND min_pass_through_seconds < 300 THEN 'min_pass_through_seconds:0.3' END, CASE WHEN in_degree >= 3 AND fan_in_ratio > 0.65 THEN 'fan_in_ratio:0.2' END,
    CASE WHEN out_degree >= 3 AND fan_out_ratio > 0.65 THEN 'fan_out_ratio:0.2' END, CASE WHEN is_cold_start = 1 THEN 'is_cold_start:0.15' END, CASE WHEN is_cold_start = 0 AND historical_tx_count >= 5 THEN 'historical_tx_count:-0.15' END,
    CASE WHEN burst_ratio_1h > 0.8 AND total_degree >= 3 THEN 'burst_ratio_1h:0.15' END], lambda x: x IS NOT NULL), ',')"""


@_register("evidence_rules", _with(f"{_FEATURES} SELECT case_id, account, {_RULES} AS signals FROM v"))
def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = _features(spark, d).withColumn("s", evidence_signals())
    return rows.select("case_id", "account", F.array_join(F.transform("s", lambda x: F.concat(x["feature"], F.lit(":"), x["contribution"].cast("string"))), ",").alias("signals"))


_CONFIDENCE = """, r AS (SELECT *, least(1.0, (2.0 * out_degree + in_degree) / greatest(1, total_degree) / 2.0) AS s FROM v), m AS (SELECT *, abs(s - 0.5) * 2.0 AS g FROM r)
    SELECT case_id, account, round(s, 6) AS score, round(CASE evidence_maturity_level WHEN 0 THEN least(0.55, 0.35 + 0.20 * g) WHEN 1 THEN least(0.90, greatest(0.40, 0.50 + 0.40 * g * least(1.0, total_degree / 4.0)))
        ELSE least(0.98, greatest(0.50, 0.60 + 0.38 * g)) END, 3) AS confidence FROM m"""


def _confident(rows: DataFrame, digits: int = 3) -> DataFrame:
    score = F.least(F.lit(1.0), (2 * F.col("out_degree") + F.col("in_degree")) / F.greatest(F.lit(1.0), F.col("total_degree")) / 2)
    rows = rows.withColumn("score", score)
    return rows.select("case_id", "account", F.round("score", 6).alias("score"), F.round(confidence(F.col("score"), F.col("evidence_maturity_level"), F.col("total_degree")), digits).alias("confidence"))


@_register("risk_confidence", _with(f"{_FEATURES}{_CONFIDENCE}"))
def risk_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _confident(_features(spark, d))


@_register("risk_confidence_monthly", _with(f"{_MONTHLY}{_CONFIDENCE}", monthly=True).replace("round(CASE evidence_maturity_level", "round_even(CASE evidence_maturity_level").replace("END, 3) AS confidence", "END, 4) AS confidence"))
def risk_confidence_monthly(spark: SparkSession, d: str) -> DataFrame:
    return _confident(_monthly_features(spark, d), 4)


@_register("default_risk_score", _with(f", {_LEGS} SELECT case_id, account, round(sum(CASE dir WHEN 'out' THEN 2.0 ELSE 1.0 END) / count(*), 6) AS risk_score FROM l GROUP BY ALL"))
def default_risk_score(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    return features.default_risk_scores(moves, times_of(moves)).select("case_id", "account", F.round("risk_score", 6).alias("risk_score"))


_HOPS = f""", {_LEGS}, e AS (SELECT DISTINCT case_id, account, other FROM l), w AS (SELECT case_id, account, count(*) AS w FROM e GROUP BY ALL),
    n AS (SELECT case_id, account, count(*) FILTER (dir = 'in') AS i, count(*) FILTER (dir = 'out') AS o, coalesce(sum(amt) FILTER (dir = 'in'), 0) AS si, coalesce(sum(amt) FILTER (dir = 'out'), 0) AS so, max(as_of) AS at_ FROM l GROUP BY ALL),
    dd AS (SELECT case_id, sender AS source, receiver AS candidate, count(*) AS c, sum(amount_minor_units) AS v, max(occurred_at) AS t FROM k GROUP BY ALL),
    sh AS (SELECT x.case_id, x.account AS source, y.account AS candidate, count(*) AS c FROM e x JOIN e y USING (case_id, other) GROUP BY ALL),
    pr AS (SELECT x.case_id, x.account AS source, y.account AS candidate, x.account % 4 = y.account % 4 AS same FROM n x JOIN n y ON x.case_id = y.case_id AND x.account <> y.account),
    nh AS (SELECT case_id, source, candidate, coalesce(dd.c, 0) AS past_transfers_count, coalesce(dd.v, 0) AS past_transfer_volume, coalesce((epoch_us(b.at_) - epoch_us(dd.t)) / 1e6, 2592000) AS time_since_last_transfer_seconds,
        coalesce(sh.c, 0) AS shared_counterparties_count, coalesce(sh.c, 0) / greatest(1.0, ws.w + wc.w - coalesce(sh.c, 0)) AS jaccard_similarity, b.i AS candidate_in_degree, b.o AS candidate_out_degree, b.si AS candidate_total_inbound,
        CAST(b.so AS DOUBLE) / greatest(1, b.si) AS candidate_forwarding_ratio, CASE WHEN same THEN 1 ELSE 0 END AS same_institution
        FROM pr LEFT JOIN dd USING (case_id, source, candidate) LEFT JOIN sh USING (case_id, source, candidate) JOIN n b ON b.case_id = pr.case_id AND b.account = pr.candidate
        JOIN w ws ON ws.case_id = pr.case_id AND ws.account = pr.source JOIN w wc ON wc.case_id = pr.case_id AND wc.account = pr.candidate
        WHERE dd.c IS NOT NULL OR sh.c IS NOT NULL OR same)"""


_HOP_COLUMNS = ", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in risk.NEXT_HOP_FEATURES)


def _hop_features(moves: DataFrame) -> DataFrame:
    found = features.next_hop_features(moves, times_of(moves), None, institutions_of(moves), digits=6)
    return found.select("case_id", "source", "candidate", *risk.NEXT_HOP_FEATURES)


@_register("next_hop_features", _with(f"{_HOPS} SELECT case_id, source, candidate, {_HOP_COLUMNS} FROM nh", dense=True))
def next_hop_features(spark: SparkSession, d: str) -> DataFrame:
    return _hop_features(transfers(spark, d, dense=True))


@_register("next_hop_features_all_accounts", _with(f"{_HOPS} SELECT case_id, source, candidate, {_HOP_COLUMNS} FROM nh"))
def next_hop_features_all_accounts(spark: SparkSession, d: str) -> DataFrame:
    return _hop_features(transfers(spark, d))


_RANKED = f"""{_HOPS}, anc AS (SELECT case_id, receiver AS account, sender AS ancestor FROM k UNION SELECT k.case_id, anc.account, k.sender FROM anc JOIN k ON k.case_id = anc.case_id AND k.receiver = anc.ancestor),
    sc AS (SELECT case_id, source, candidate, 2.0 * past_transfers_count + 1.5 * shared_counterparties_count + 0.5 * same_institution + 0.5 * candidate_in_degree AS s FROM nh
        WHERE past_transfers_count + shared_counterparties_count + same_institution > 0 AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.case_id = nh.case_id AND anc.account = nh.source AND anc.ancestor = nh.candidate)),
    ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY case_id, source)) AS x FROM sc), pb AS (SELECT *, x / sum(x) OVER (PARTITION BY case_id, source) AS p FROM ex),
    rk AS (SELECT *, row_number() OVER (PARTITION BY case_id, source ORDER BY round(p, 12) DESC, candidate) AS rank FROM pb)"""


@_register("next_hop_heuristic", _with(f"{_RANKED} SELECT case_id, source, candidate, CAST(rank AS INTEGER) AS rank, round(p, 4) AS probability FROM rk WHERE rank <= 5", recursive=True))
def next_hop_heuristic(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    return features.predicted_next_hops(moves, times_of(moves), institutions_of(moves))


@_register(
    "next_hop_metrics",
    _with(f"""{_RANKED}, tr AS (SELECT a.case_id, a.sender AS source, min(a.receiver) AS candidate FROM a JOIN times USING (case_id) WHERE occurred_at > as_of GROUP BY ALL),
        b AS (SELECT tr.case_id, tr.source, min(rank) AS r FROM tr LEFT JOIN rk ON rk.case_id = tr.case_id AND rk.source = tr.source AND rk.candidate = tr.candidate AND rk.rank <= 5 GROUP BY ALL)
        SELECT count(*) AS n, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0.0 END), 6) AS top_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS top_3, round(avg(coalesce(1.0 / r, 0.0)), 6) AS mrr FROM b""", recursive=True),
)
def next_hop_metrics(spark: SparkSession, d: str) -> DataFrame:
    moves = transfers(spark, d)
    times = times_of(moves)
    later = scan.active(moves).join(times, "case_id").where("occurred_at > as_of").groupBy("case_id", F.col("sender").alias("source")).agg(F.min("receiver").alias("candidate"))
    found = risk.next_hop_metrics(features.predicted_next_hops(moves, times, institutions_of(moves)), later)
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("top_1", "top_3", "mrr")))


# ---- provenance ---------------------------------------------------------------------------------

_POOL = """, p AS (SELECT case_id, sender, 'r' || receiver AS key, CAST(sum(amount_minor_units) AS BIGINT) AS b FROM a GROUP BY ALL), t AS (SELECT case_id, sender, sum(b) AS total, sum(b) * 37 // 100 AS amount FROM p GROUP BY ALL),
    x AS (SELECT p.*, total, amount, CAST(amount AS HUGEINT) * b AS m FROM p JOIN t USING (case_id, sender)),
    y AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE m // total END AS base, CASE WHEN total = 0 THEN 0 ELSE m % total END AS rem FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY case_id, sender ORDER BY rem DESC, key) AS n, amount - sum(base) OVER (PARTITION BY case_id, sender) AS rest FROM y)"""


@_register("largest_remainder", _with(f"{_POOL} SELECT case_id, sender, key, CAST(base + CASE WHEN n <= rest THEN 1 ELSE 0 END AS BIGINT) AS amount FROM z", dense=True))
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d, dense=True))
    pool = moves.groupBy("case_id", "sender", F.concat(F.lit("r"), "receiver").alias("key")).agg(F.sum("amount_minor_units").alias("balance"))
    pool = pool.groupBy("case_id", "sender").agg(F.collect_list(F.struct("key", "balance")).alias("parts"), F.expr("sum(balance) * 37 div 100").alias("amount"))
    shared = pool.select("case_id", "sender", F.explode(proportional_allocation(F.col("amount"), F.col("parts"))).alias("p"))
    return shared.select("case_id", "sender", "p.key", "p.amount")


# one step an event: clean and tainted balances of all accounts as lists
def _taint_sql(accounts: str = "20") -> str:
    return f""", {_SEEDS}, o AS (SELECT a.*, row_number() OVER (PARTITION BY a.case_id ORDER BY a.occurred_at, a.ingest_seq) AS n, s.transaction_id IS NOT NULL AS is_seed, coalesce(s.tainted_amount, 0) AS inj
        FROM a LEFT JOIN s USING (case_id, transaction_id)),
    f AS (SELECT case_id, CAST(0 AS BIGINT) AS n, CAST(list_transform(range({accounts}), lambda i: 0) AS BIGINT[]) AS c, CAST(list_transform(range({accounts}), lambda i: 0) AS BIGINT[]) AS t,
            CAST(NULL AS BIGINT) AS event_id, CAST(0 AS BIGINT) AS bal, CAST(0 AS BIGINT) AS tb, CAST(0 AS BIGINT) AS mt, CAST(0 AS BIGINT) AS mc, CAST(0 AS BIGINT) AS un FROM s
        UNION ALL SELECT case_id, n, list_transform(c, lambda x, i: x + CASE WHEN i = r + 1 THEN mc + un ELSE 0 END - CASE WHEN i = q + 1 AND NOT is_seed THEN mc ELSE 0 END),
            list_transform(t, lambda x, i: x + CASE WHEN i = r + 1 THEN mt ELSE 0 END - CASE WHEN i = q + 1 AND NOT is_seed THEN mt ELSE 0 END), event_id, bal, tb, mt, mc, un FROM (
            SELECT *, CASE WHEN is_seed THEN inj ELSE CAST(pt + CASE WHEN cov - pt - pc > 0 AND rt > rc THEN 1 ELSE 0 END AS BIGINT) END AS mt,
                CASE WHEN is_seed THEN amt - inj ELSE CAST(pc + CASE WHEN cov - pt - pc > 0 AND rt <= rc THEN 1 ELSE 0 END AS BIGINT) END AS mc,
                CASE WHEN is_seed THEN 0 ELSE amt - cov END AS un, CASE WHEN is_seed THEN 0 ELSE before END AS bal, CASE WHEN is_seed THEN inj ELSE t[q + 1] END AS tb FROM (
                SELECT *, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] // before END AS pt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] // before END AS pc,
                    CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] % before END AS rt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] % before END AS rc FROM (
                    SELECT f.case_id, o.n, f.c, f.t, o.event_id, o.sender AS q, o.receiver AS r, o.amount_minor_units AS amt, o.is_seed, o.inj, f.c[o.sender + 1] + f.t[o.sender + 1] AS before,
                        least(o.amount_minor_units, f.c[o.sender + 1] + f.t[o.sender + 1]) AS cov FROM f JOIN o ON o.case_id = f.case_id AND o.n = f.n + 1))))"""


_TAINT = _taint_sql()
_ALLOC = f"{_TAINT}, al AS (SELECT f.case_id, CAST(f.n - 1 AS INTEGER) AS sequence, f.event_id, o.sender, o.receiver, o.amount_minor_units, o.occurred_at, o.transaction_id, bal AS balance_before, tb AS tainted_before, mt AS tainted, mc AS clean, un AS unattributed, o.is_seed FROM f JOIN o ON o.case_id = f.case_id AND o.n = f.n)"
_END = "en AS (SELECT case_id, arg_max(c, n) AS c, arg_max(t, n) AS t FROM f GROUP BY ALL), ba AS (SELECT case_id, unnest(range(20)) AS account, unnest(c) AS clean, unnest(t) AS tainted FROM en)"


def _dense(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    moves = transfers(spark, d, dense=True)
    marked = seeds(moves)
    return moves, marked, taint.allocations(moves, marked)


@_register("taint_allocations", _with(f"{_ALLOC} SELECT case_id, sequence, event_id, balance_before, tainted_before, tainted, clean, unattributed, is_seed FROM al", dense=True, recursive=True))
def taint_allocations(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d)[2].select("case_id", "sequence", "event_id", "balance_before", "tainted_before", "tainted", "clean", "unattributed", "is_seed")


@_register("taint_balances", _with(f"{_ALLOC}, {_END} SELECT * FROM ba WHERE clean + tainted > 0", dense=True, recursive=True))
def taint_balances(spark: SparkSession, d: str) -> DataFrame:
    return taint.balances(_dense(spark, d)[2]).select("case_id", "account", "clean", "tainted")


@_register("taint_conservation", _with(f"{_ALLOC}, {_END} SELECT case_id, source_id, tainted_amount AS injected, v AS edge_volume, r AS remaining, CAST(0 AS BIGINT) AS terminated, tainted_amount - r AS error FROM s JOIN (SELECT case_id, CAST(sum(tainted) AS BIGINT) AS v FROM al GROUP BY 1) USING (case_id) JOIN (SELECT case_id, CAST(sum(tainted) AS BIGINT) AS r FROM ba GROUP BY 1) USING (case_id)", dense=True, recursive=True))
def taint_conservation(spark: SparkSession, d: str) -> DataFrame:
    _, marked, allocated = _dense(spark, d)
    return taint.conservation(allocated, marked)


@_register("taint_shortfalls", _with(f"{_ALLOC} SELECT case_id, sequence, event_id, sender AS account, amount_minor_units, balance_before, unattributed AS shortfall FROM al WHERE unattributed > 0", dense=True, recursive=True))
def taint_shortfalls(spark: SparkSession, d: str) -> DataFrame:
    return taint.shortfalls(_dense(spark, d)[2])


@_register("taint_trace", _with(f"{_ALLOC}, fr AS (SELECT case_id, receiver AS account, min(sequence) AS sequence FROM al WHERE tainted > 0 GROUP BY ALL) SELECT fr.case_id, source_id, CAST(row_number() OVER (PARTITION BY fr.case_id ORDER BY sequence) AS INTEGER) AS step, account, sequence FROM fr JOIN s USING (case_id)", dense=True, recursive=True))
def taint_trace(spark: SparkSession, d: str) -> DataFrame:
    return taint.trace(_dense(spark, d)[2])


@_register("inactive_events", _with("SELECT case_id, event_id, status FROM transfers WHERE status <> 'completed'"))
def inactive_events(spark: SparkSession, d: str) -> DataFrame:
    return taint.inactive(transfers(spark, d))


# ---- counterfactuals, chokepoints, selection -----------------------------------------------------


@_register("edge_hold_collateral", _with(f"{_ALLOC} SELECT case_id, event_id, clean + unattributed AS collateral FROM al JOIN times USING (case_id) WHERE occurred_at > as_of", dense=True, recursive=True))
def edge_hold_collateral(spark: SparkSession, d: str) -> DataFrame:
    moves, _, allocated = _dense(spark, d)
    return counterfactual.edge_hold_collateral(allocated, times_of(moves))


@_register(
    "counterfactual_candidates",
    _with(f"""{_ALLOC}, {_END} SELECT case_id, 'account_hold' AS kind, account AS target_account, CAST(NULL AS BIGINT) AS target_event FROM ba WHERE tainted > 0 AND EXISTS (SELECT 1 FROM a JOIN times USING (case_id) WHERE a.case_id = ba.case_id AND sender = account AND occurred_at > as_of)
        UNION ALL SELECT case_id, 'edge_hold', NULL, event_id FROM al JOIN times USING (case_id) WHERE occurred_at > as_of AND tainted > 0""", dense=True, recursive=True),
)
def counterfactual_candidates(spark: SparkSession, d: str) -> DataFrame:
    moves, _, allocated = _dense(spark, d)
    return counterfactual.candidates(moves, allocated, times_of(moves))


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Dense transfers, their seeds and allocations, and the decision times."""
    moves, marked, allocated = _dense(spark, d)
    return moves, marked, traverse.cut_lineage(allocated), times_of(moves)


# every candidate's world from the decision time on: blocked events leave the lists as they are
_CANDIDATES = """cd AS (SELECT case_id, 'account_hold' AS kind, account AS target_account, CAST(NULL AS BIGINT) AS target_event FROM ba WHERE tainted > 0 AND EXISTS (SELECT 1 FROM a JOIN times USING (case_id) WHERE a.case_id = ba.case_id AND sender = account AND occurred_at > as_of)
    UNION ALL SELECT case_id, 'edge_hold', NULL, event_id FROM al JOIN times USING (case_id) WHERE occurred_at > as_of AND tainted > 0),
    ids AS (SELECT cd.*, as_of, 'cf-' || left(sha256(kind || ':' || coalesce(target_account, target_event) || ':' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 16) AS intervention_id FROM cd JOIN times USING (case_id))"""
_WORLDS = f"""{_ALLOC}, {_END}, {_CANDIDATES},
    st AS (SELECT f.case_id, max(f.n) AS n FROM f LEFT JOIN o ON o.case_id = f.case_id AND o.n = f.n JOIN times ON times.case_id = f.case_id WHERE f.n = 0 OR o.occurred_at <= as_of GROUP BY ALL),
    ev AS (SELECT ids.case_id, intervention_id, o.n, o.sender AS q, o.receiver AS r, o.event_id, o.amount_minor_units AS amt, o.is_seed, o.inj,
        occurred_at > as_of AND (CASE kind WHEN 'account_hold' THEN o.sender = target_account ELSE o.event_id = target_event END) AS stop FROM ids JOIN o USING (case_id)),
    g AS (SELECT ids.case_id, intervention_id, f.n, f.c, f.t FROM ids JOIN st USING (case_id) JOIN f ON f.case_id = st.case_id AND f.n = st.n
        UNION ALL SELECT case_id, intervention_id, n, list_transform(c, lambda x, i: x + CASE WHEN stop THEN 0 ELSE CASE WHEN i = r + 1 THEN mc + un ELSE 0 END - CASE WHEN i = q + 1 AND NOT is_seed THEN mc ELSE 0 END END),
            list_transform(t, lambda x, i: x + CASE WHEN stop THEN 0 ELSE CASE WHEN i = r + 1 THEN mt ELSE 0 END - CASE WHEN i = q + 1 AND NOT is_seed THEN mt ELSE 0 END END) FROM (
            SELECT *, CASE WHEN is_seed THEN inj ELSE CAST(pt + CASE WHEN cov - pt - pc > 0 AND rt > rc THEN 1 ELSE 0 END AS BIGINT) END AS mt,
                CASE WHEN is_seed THEN amt - inj ELSE CAST(pc + CASE WHEN cov - pt - pc > 0 AND rt <= rc THEN 1 ELSE 0 END AS BIGINT) END AS mc, CASE WHEN is_seed THEN 0 ELSE amt - cov END AS un FROM (
                SELECT *, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] // before END AS pt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] // before END AS pc,
                    CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] % before END AS rt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] % before END AS rc FROM (
                    SELECT g.case_id, g.intervention_id, ev.n, g.c, g.t, ev.q, ev.r, ev.amt, ev.is_seed, ev.inj, ev.stop, g.c[ev.q + 1] + g.t[ev.q + 1] AS before,
                        least(ev.amt, g.c[ev.q + 1] + g.t[ev.q + 1]) AS cov FROM g JOIN ev ON ev.case_id = g.case_id AND ev.intervention_id = g.intervention_id AND ev.n = g.n + 1)))),
    ge AS (SELECT case_id, intervention_id, unnest(range(20)) AS account, unnest(arg_max(t, n)) AS kept FROM g GROUP BY case_id, intervention_id),
    rs AS (SELECT case_id, intervention_id, CAST(sum(greatest(0, tainted - kept)) AS BIGINT) AS intercepted, CAST(sum(kept) AS BIGINT) AS residual FROM ge JOIN ba USING (case_id, account) GROUP BY ALL)"""


@_register(
    "counterfactual_outcomes",
    _with(f"""{_WORLDS}, sc AS (SELECT ev.case_id, intervention_id, CAST(sum(clean + unattributed) AS BIGINT) AS legitimate, count(*) AS affected_edges, max(unattributed) AS un, len(list_distinct(flatten(list([q, r])))) AS affected_accounts
            FROM ev JOIN al USING (case_id, event_id) WHERE stop GROUP BY ALL)
        SELECT ids.case_id, intervention_id, kind, target_account, target_event, intercepted, legitimate, residual AS remaining, affected_edges, CAST(affected_accounts AS INTEGER) AS affected_accounts, CAST(CASE WHEN un > 0 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS provenance_confidence
        FROM ids JOIN rs USING (case_id, intervention_id) JOIN sc USING (case_id, intervention_id)""", dense=True, recursive=True),
)
def counterfactual_outcomes(spark: SparkSession, d: str) -> DataFrame:
    moves, marked, allocated, times = _decided(spark, d)
    options = traverse.cut_lineage(counterfactual.with_id(counterfactual.candidates(moves, allocated, times), times))
    found = counterfactual.outcomes(moves, marked, allocated, options, times)
    return found.select("case_id", "intervention_id", "kind", "target_account", "target_event", "intercepted", "legitimate", "remaining", "affected_edges", "affected_accounts", "provenance_confidence")


_COLLATERAL = "CAST(event_id % 97 AS BIGINT)"


@_register("encoded_costs", _with(f", g AS (SELECT a.case_id, event_id, {_COLLATERAL} AS collateral, count(*) OVER (PARTITION BY a.case_id) AS n FROM a JOIN times USING (case_id) WHERE occurred_at > as_of) SELECT case_id, event_id, collateral, CAST(collateral * (n + 1) + 1 AS BIGINT) AS cost FROM g"))
def encoded_costs(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d))
    later = scan.eligible(moves.join(times_of(moves), "case_id"), F.col("as_of"))
    found = chokepoint.encoded_costs(moves, later, moves.select("case_id", "event_id", (F.col("event_id") % 97).alias("collateral")))
    return found.select("case_id", "event_id", "collateral", F.col("cost").cast("bigint").alias("cost"))


def _network(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Active transfers, costs of those after noon, accounts 0 to 4 and 7 to 11 of every case."""
    moves = scan.active(transfers(spark, d))
    later = scan.eligible(moves.join(times_of(moves), "case_id"), F.col("as_of"))
    costs = chokepoint.encoded_costs(moves, later, moves.select("case_id", "event_id", (F.col("event_id") % 97).alias("collateral")))
    cases = moves.select("case_id").distinct()
    side = lambda first: cases.select("case_id", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(first + 4).cast("bigint"))).alias("account"))
    return moves, costs, side(0), side(7)


@_register(
    "network_arcs",
    _with(f""", g AS (SELECT a.case_id, event_id, {_COLLATERAL} * (count(*) OVER (PARTITION BY a.case_id) + 1) + 1 AS cost FROM a JOIN times USING (case_id) WHERE occurred_at > as_of), ii AS (SELECT case_id, sum(cost) + 1 AS inf FROM g GROUP BY ALL),
        m AS (SELECT a.case_id, event_id, sender, receiver, epoch_us(occurred_at) AS t, coalesce(inf, 1) AS inf FROM a LEFT JOIN ii USING (case_id)),
        tt AS (SELECT *, lag(t) OVER w AS b, lead(t) OVER w AS n FROM (SELECT case_id, inf, sender AS ac, t FROM m UNION SELECT case_id, inf, receiver, t FROM m) WINDOW w AS (PARTITION BY case_id, ac ORDER BY t)),
        r AS (SELECT m.case_id, 'event' AS kind, 'i:' || event_id AS from_node, 'o:' || event_id AS to_node, coalesce(cost, inf) AS capacity FROM m LEFT JOIN g USING (case_id, event_id)
            UNION ALL SELECT case_id, 'wait', 'v:' || ac || ':' || t, 'v:' || ac || ':' || n, inf FROM tt WHERE n IS NOT NULL
            UNION ALL SELECT case_id, 'arrive', 'o:' || event_id, 'v:' || receiver || ':' || t, inf FROM m
            UNION ALL SELECT m.case_id, 'depart', 'v:' || sender || ':' || b, 'i:' || event_id, m.inf FROM m JOIN tt ON tt.case_id = m.case_id AND ac = sender AND tt.t = m.t WHERE b IS NOT NULL
            UNION ALL SELECT case_id, 'source', 'S', 'i:' || event_id, inf FROM m WHERE sender BETWEEN 0 AND 4
            UNION ALL SELECT case_id, 'sink', 'o:' || event_id, 'T', inf FROM m WHERE receiver BETWEEN 7 AND 11)
        SELECT case_id, kind, from_node, to_node, CAST(capacity AS BIGINT) AS capacity FROM r"""),
)
def network_arcs(spark: SparkSession, d: str) -> DataFrame:
    return chokepoint.network_arcs(*_network(spark, d)).select("case_id", "kind", "from_node", "to_node", F.col("capacity").cast("bigint").alias("capacity"))


@_register("min_cut")
def min_cut(spark: SparkSession, d: str) -> DataFrame:
    return chokepoint.min_cut(*_network(spark, d)).withColumn("cost", F.col("cost").cast("string"))


@_register(
    "flow_certificate",
    _with(""", arrived AS (SELECT case_id, receiver AS ac, min(occurred_at) AS t FROM a WHERE receiver NOT BETWEEN 7 AND 11 GROUP BY ALL)
        SELECT a.case_id, count(*) FILTER (WHERE sender BETWEEN 0 AND 4 OR t < occurred_at) AS events, 0 AS over_capacity, 0 AS unbalanced, 0 AS gap
        FROM a LEFT JOIN arrived ON arrived.case_id = a.case_id AND ac = sender GROUP BY a.case_id"""),
)
def flow_certificate(spark: SparkSession, d: str) -> DataFrame:
    """The flow of every case proves the cut of every case: nothing above capacity, nothing lost, as much as the cut costs."""
    moves, costs, *ends = _network(spark, d)
    flowed, side = flow.max_flow(flow.contracted(flow.on_paths(moves, *ends), costs, *ends))
    found = flow.certificate(flowed, flow.least_cut(moves, flowed, side), flow.entered(moves, *ends))
    return found.select("case_id", "events", "over_capacity", "unbalanced", F.col("gap").cast("bigint").alias("gap"))


_OPTIONS = """, c AS (SELECT case_id, 'cf-' || sender AS intervention_id, sender, CAST(sum(CASE WHEN channel IN ('upi', 'neft', 'wire') THEN amount_minor_units ELSE 0 END) AS BIGINT) AS intercepted,
    CAST(sum(CASE WHEN channel IN ('card', 'cash') THEN amount_minor_units ELSE 0 END) AS BIGINT) AS legitimate, count(DISTINCT receiver) AS affected_accounts, count(*) AS affected_edges FROM a GROUP BY ALL),
    j AS (SELECT *, legitimate <= 12000 AND affected_edges <= 40 AS feasible, intercepted / greatest(1, legitimate) AS eff FROM c),
    fr AS (SELECT * FROM j b WHERE feasible AND NOT EXISTS (SELECT 1 FROM j a2 WHERE a2.feasible AND a2.case_id = b.case_id AND a2.intercepted >= b.intercepted AND a2.legitimate <= b.legitimate AND a2.affected_accounts <= b.affected_accounts AND a2.affected_edges <= b.affected_edges
        AND (a2.intercepted > b.intercepted OR a2.legitimate < b.legitimate OR a2.affected_accounts < b.affected_accounts OR a2.affected_edges < b.affected_edges)))"""
LIMITS = pareto.Limits(maximum_legitimate_capital_affected=12_000, maximum_affected_edges=40)


def _options(spark: SparkSession, d: str) -> DataFrame:
    """Senders as candidates: volume of some channels stands for recovery, of others for collateral."""
    moves = scan.active(transfers(spark, d, dense=True))
    sum_of = lambda *c: F.sum(F.when(F.col("channel").isin(*c), F.col("amount_minor_units")).otherwise(0))
    return moves.groupBy("case_id", F.concat(F.lit("cf-"), "sender").alias("intervention_id"), F.col("sender")).agg(
        sum_of("upi", "neft", "wire").alias("intercepted"), sum_of("card", "cash").alias("legitimate"), F.count_distinct("receiver").alias("affected_accounts"), F.count("*").alias("affected_edges")
    )


@_register("policy_violations", _with(f"{_OPTIONS} SELECT case_id, intervention_id, concat_ws(',', CASE WHEN legitimate > 12000 THEN 'maximum_legitimate_capital_affected' END, CASE WHEN affected_edges > 40 THEN 'maximum_affected_edges' END) AS violations FROM c", dense=True))
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    return pareto.judged(_options(spark, d), LIMITS).select("case_id", "intervention_id", F.array_join("violations", ",").alias("violations"))


@_register("pareto_frontier", _with(f"{_OPTIONS} SELECT case_id, intervention_id, intercepted, legitimate, affected_accounts, affected_edges FROM fr", dense=True))
def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    rows = pareto.judged(_options(spark, d), LIMITS)
    return pareto.frontier(rows.where("feasible")).select("case_id", "intervention_id", *pareto.OBJECTIVES)


@_register(
    "pareto_ranks",
    _with(f"""{_OPTIONS}, sl AS (SELECT case_id, intervention_id, row_number() OVER (PARTITION BY case_id ORDER BY intercepted DESC, legitimate, eff DESC, affected_accounts, affected_edges, intervention_id) = 1 AS sel FROM fr)
        SELECT j.case_id, j.intervention_id, CASE WHEN sl.sel IS NOT NULL THEN 0 WHEN feasible THEN 1 END AS pareto_rank, coalesce(sl.sel, false) AS selected,
        coalesce((SELECT string_agg(x.intervention_id, ',' ORDER BY x.intervention_id) FROM fr x WHERE x.case_id = j.case_id AND x.intercepted >= j.intercepted AND x.legitimate <= j.legitimate AND x.affected_accounts <= j.affected_accounts AND x.affected_edges <= j.affected_edges
        AND (x.intercepted > j.intercepted OR x.legitimate < j.legitimate OR x.affected_accounts < j.affected_accounts OR x.affected_edges < j.affected_edges)), '') AS dominated_by FROM j LEFT JOIN sl USING (case_id, intervention_id)""", dense=True),
)
def pareto_ranks(spark: SparkSession, d: str) -> DataFrame:
    return pareto.ranked(_options(spark, d), LIMITS).select("case_id", "intervention_id", "pareto_rank", "selected", F.array_join("dominated_by", ",").alias("dominated_by"))


@_register("baseline_choices", _with(f"{_OPTIONS}, b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY intercepted DESC, intervention_id) AS n FROM j WHERE feasible) SELECT case_id, intervention_id, intercepted FROM b WHERE n = 1", dense=True))
def baseline_choices(spark: SparkSession, d: str) -> DataFrame:
    rows = pareto.judged(_options(spark, d), LIMITS)
    return pareto.baseline_choice(rows, "intercepted", account_holds_only=False).select("case_id", "intervention_id", "intercepted")


@_register("highest_taint_edge", _with(f"{_ALLOC}, h AS (SELECT al.*, row_number() OVER (PARTITION BY case_id ORDER BY tainted DESC, sequence) AS k FROM al JOIN times USING (case_id) WHERE occurred_at > as_of) SELECT case_id, event_id, tainted FROM h WHERE k = 1", dense=True, recursive=True))
def highest_taint_edge(spark: SparkSession, d: str) -> DataFrame:
    moves, _, allocated = _dense(spark, d)
    return pareto.highest_taint_edge(allocated, times_of(moves), scan.active(moves))


# ---- forecasts, models, evaluation ---------------------------------------------------------------


def _forecast(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    moves = transfers(spark, d)
    marked, times = seeds(moves), times_of(moves)
    sources, paths = forecast.paths_from(moves, marked, times, institutions_of(moves))
    return moves, marked, times, sources, paths


def _beam_level(depth: int) -> str:
    """SQL of one level: ``g`` (three best hops of each path), ``x`` (paths without a hop) and ``b`` (three best of each source)."""
    last = f"b{depth - 1}"
    return f"""g{depth} AS (SELECT * FROM (SELECT w.case_id, w.source, w.amount, rk.candidate AS at_, w.cum * round(rk.p, 4) AS cum, list_append(w.acc, rk.candidate) AS acc, row_number() OVER (PARTITION BY w.case_id, w.acc ORDER BY round(rk.p, 4) DESC, rk.candidate) AS n
            FROM {last} w JOIN rk ON rk.case_id = w.case_id AND rk.source = w.at_ AND rk.rank <= 6 AND round(rk.p, 4) >= 0.01 WHERE NOT list_contains(w.acc, rk.candidate) AND NOT EXISTS (SELECT 1 FROM anc WHERE anc.case_id = w.case_id AND anc.account = w.source AND anc.ancestor = rk.candidate)) WHERE n <= 3),
        x{depth} AS (SELECT case_id, source, amount, at_, cum, acc FROM {last} w WHERE len(acc) > 1 AND NOT EXISTS (SELECT 1 FROM g{depth} g WHERE g.case_id = w.case_id AND g.acc[1:{depth}] = w.acc)),
        b{depth} AS (SELECT case_id, source, amount, at_, cum, acc FROM (SELECT *, row_number() OVER (PARTITION BY case_id, source ORDER BY cum DESC, acc) AS k FROM g{depth}) WHERE k <= 3)"""


_PATHS = f"""{_RANKED}{_taint_sql("(SELECT max(user_id) + 1 FROM events)").replace("f AS (SELECT case_id, CAST(0", "fo AS (SELECT case_id, CAST(0").replace("SELECT f.case_id, o.n, f.c, f.t", "SELECT fo.case_id, o.n, fo.c, fo.t").replace("f.c[", "fo.c[").replace("f.t[", "fo.t[").replace("FROM f JOIN o ON o.case_id = f.case_id AND o.n = f.n + 1", "FROM fo JOIN o ON o.case_id = fo.case_id AND o.n = fo.n + 1")},
    sn AS (SELECT o.case_id, max(o.n) AS n FROM o JOIN times USING (case_id) WHERE occurred_at <= as_of GROUP BY ALL),
    hd AS (SELECT fo.case_id, unnest(range(len(t))) AS source, unnest(t) AS amount FROM fo JOIN sn ON sn.case_id = fo.case_id AND sn.n = fo.n), b0 AS (SELECT case_id, source, amount, source AS at_, CAST(1.0 AS DOUBLE) AS cum, [source] AS acc FROM hd WHERE amount > 0),
    {_beam_level(1)}, {_beam_level(2)}, {_beam_level(3)},
    dn AS (SELECT * FROM x2 UNION ALL SELECT * FROM x3 UNION ALL SELECT * FROM b3), pk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY cum DESC, len(acc), acc) AS path_rank FROM dn) WHERE path_rank <= 3)"""
_PATH_ROWS = """SELECT case_id, CAST(path_rank AS INTEGER) AS path_rank, 'path-' || left(sha256(source || ':' || array_to_string(acc, '->') || ':' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 12) AS path_id, source, amount, array_to_string(acc, ',') AS accounts,
        round(cum, 9) AS cumulative, CAST(len(acc) - 1 AS INTEGER) AS hops FROM pk JOIN times USING (case_id)"""


@_register("forecast_paths", _with(f"{_PATHS} {_PATH_ROWS}", recursive=True))
def forecast_paths(spark: SparkSession, d: str) -> DataFrame:
    paths = _forecast(spark, d)[-1]
    return paths.select("case_id", "path_rank", "path_id", "source", "amount", _joined("accounts").alias("accounts"), F.round("cumulative", 9).alias("cumulative"), F.size("hops").alias("hops"))


# worlds of one path each: the state at the time, then the path's hops, but for those that leave a held account (target -1: none held)
_FUTURES = f"""{_PATHS}, ct AS (SELECT case_id, source AS target FROM hd WHERE amount > 0 UNION SELECT case_id, unnest(acc) FROM pk),
    wo AS (SELECT case_id, path_rank, acc, amount, target FROM pk JOIN (SELECT * FROM ct UNION ALL SELECT DISTINCT case_id, -1 FROM pk) USING (case_id)),
    fw AS (SELECT wo.case_id, path_rank, target, acc, amount AS amt, 0 AS k, fo.c, fo.t, CAST(0 AS BIGINT) AS lg, CAST(0 AS BIGINT) AS mc, CAST(0 AS BIGINT) AS mt, CAST(0 AS BIGINT) AS un FROM wo JOIN sn USING (case_id) JOIN fo ON fo.case_id = sn.case_id AND fo.n = sn.n
        UNION ALL SELECT case_id, path_rank, target, acc, amt, k + 1, list_transform(c, lambda x, i: x + CASE WHEN stop THEN 0 ELSE CASE WHEN i = r + 1 THEN mc + un ELSE 0 END - CASE WHEN i = q + 1 THEN mc ELSE 0 END END),
            list_transform(t, lambda x, i: x + CASE WHEN stop THEN 0 ELSE CASE WHEN i = r + 1 THEN mt ELSE 0 END - CASE WHEN i = q + 1 THEN mt ELSE 0 END END), mc + un, mc, mt, un FROM (
            SELECT *, CAST(pt + CASE WHEN cov - pt - pc > 0 AND rt > rc THEN 1 ELSE 0 END AS BIGINT) AS mt, CAST(pc + CASE WHEN cov - pt - pc > 0 AND rt <= rc THEN 1 ELSE 0 END AS BIGINT) AS mc, amt - cov AS un FROM (
                SELECT *, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] // before END AS pt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] // before END AS pc,
                    CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * t[q + 1] % before END AS rt, CASE WHEN before = 0 THEN 0 ELSE CAST(cov AS HUGEINT) * c[q + 1] % before END AS rc FROM (
                    SELECT case_id, path_rank, target, acc, amt, k, c, t, acc[k + 1] AS q, acc[k + 2] AS r, acc[k + 1] = target AS stop, c[acc[k + 1] + 1] + t[acc[k + 1] + 1] AS before, least(amt, c[acc[k + 1] + 1] + t[acc[k + 1] + 1]) AS cov FROM fw WHERE k < len(acc) - 1)))),
    fe AS (SELECT case_id, path_rank, target, arg_max(t, k) AS t FROM fw GROUP BY ALL),
    oc AS (SELECT w.case_id, w.path_rank, w.target, CAST(list_sum(list_transform(list_zip(b.t, w.t), lambda z: greatest(0, z[1] - z[2]))) AS BIGINT) AS i,
            (SELECT CAST(coalesce(sum(lg), 0) AS BIGINT) FROM fw h WHERE h.case_id = w.case_id AND h.path_rank = w.path_rank AND h.target = -1 AND h.k > 0 AND h.acc[h.k] = w.target) AS l
        FROM fe w JOIN fe b ON b.case_id = w.case_id AND b.path_rank = w.path_rank AND b.target = -1 WHERE w.target >= 0),
    ww AS (SELECT case_id, path_rank, cum / sum(cum) OVER (PARTITION BY case_id) AS w FROM pk),
    fx AS (SELECT case_id, target, count(*) AS futures, CAST(round(sum(w * i), 0) AS BIGINT) AS e, min(i) AS lo, max(i) AS hi, max(l) AS wl, sum(CASE WHEN i > 0 THEN w ELSE 0 END) AS ep FROM oc JOIN ww USING (case_id, path_rank) GROUP BY ALL)
    SELECT ct.case_id, 'cf-' || left(sha256('account_hold:' || ct.target || ':' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 16) AS intervention_id, ct.target AS target_account, CASE WHEN ct.case_id IN (SELECT case_id FROM pk) THEN 'ready' ELSE 'no_candidate_paths' END AS forecast_status,
        coalesce(futures, 0) AS futures, coalesce(e, 0) AS expected_intercepted, coalesce(lo, 0) AS worst_intercepted, coalesce(hi, 0) AS best_intercepted, coalesce(wl, 0) AS worst_legitimate, round(coalesce(ep, 0.0), 9) AS effective_probability
    FROM ct JOIN times USING (case_id) LEFT JOIN fx USING (case_id, target)"""


@_register("forecast_evaluation", _with(_FUTURES, recursive=True))
def forecast_evaluation(spark: SparkSession, d: str) -> DataFrame:
    moves, marked, times, sources, paths = _forecast(spark, d)
    found = forecast.evaluate(moves, marked, paths, forecast.forecast_candidates(sources, paths), times)
    return found.select("case_id", "intervention_id", "target_account", "forecast_status", "futures", "expected_intercepted", "worst_intercepted", "best_intercepted", "worst_legitimate", F.round("effective_probability", 9).alias("effective_probability"))


@_register(
    "risk_metrics",
    """WITH r AS (SELECT strftime(ts, '%Y-%m-%d') AS case_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y, (event_id * 37 % 101) / 100.0 AS s FROM events),
        b AS (SELECT case_id, count(*) AS n, sum(y) AS p, sum(CASE WHEN s >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN s >= 0.5 THEN 1 - y ELSE 0 END) AS fp, avg((s - y) * (s - y)) AS brier FROM r GROUP BY 1),
        auc AS (SELECT x.case_id, sum(CASE WHEN x.s > z.s THEN 1.0 WHEN x.s = z.s THEN 0.5 ELSE 0 END) AS w FROM r x JOIN r z ON x.case_id = z.case_id AND x.y = 1 AND z.y = 0 GROUP BY 1),
        st AS (SELECT case_id, s, sum(y) AS p, count(*) AS c FROM r GROUP BY ALL), cu AS (SELECT *, sum(p) OVER w AS cp, sum(c) OVER w AS cc FROM st WINDOW w AS (PARTITION BY case_id ORDER BY s DESC)),
        ap AS (SELECT case_id, sum(p * cp / cc) AS a FROM cu GROUP BY 1)
        SELECT case_id, n, CAST(p AS BIGINT) AS positives, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(p - tp AS BIGINT) AS fn, CAST(n - p - fp AS BIGINT) AS tn, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall,
            round(2 * tp / (tp + fp + p), 6) AS f1, round(w / (p * (n - p)), 6) AS roc_auc, round(a / p, 6) AS average_precision, round(brier, 6) AS brier FROM b JOIN auc USING (case_id) JOIN ap USING (case_id)""",
)
def risk_metrics(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").select(
        F.date_format("ts", "yyyy-MM-dd").alias("case_id"), (F.col("event_type") == "error").cast("int").alias("label"), (F.col("event_id") * 37 % 101 / 100.0).alias("score")
    )
    found = risk.binary_metrics(rows, by=("case_id",))
    return found.select("case_id", "n", "positives", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "roc_auc", "average_precision", "brier")))


@_register("strategy_benchmark")
def strategy_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every strategy over the observed transfers, each choosing among all simulated holds at noon."""
    moves, marked, _, times = _decided(spark, d)
    totals = evaluate.strategy_totals(evaluate.strategies(moves, marked, times)[0])
    return totals.withColumns({"efficiency": F.col("efficiency").cast("string"), "compliance": F.col("compliance").cast("string")})


@_register("forecast_benchmark")
def forecast_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Choices by forecast against choices that know the future, over the observed transfers: sums, and how often each note is given."""
    moves, marked, times, sources, paths = _forecast(spark, d)
    allocated = traverse.cut_lineage(taint.allocations(moves, marked))
    holds = forecast.forecast_candidates(sources, paths)
    expected = pareto.judged(forecast.evaluate(moves, marked, paths, holds, times))
    own = counterfactual.candidates(moves, allocated, times)
    known = traverse.cut_lineage(counterfactual.outcomes(moves, marked, allocated, counterfactual.with_id(own.unionByName(holds).distinct(), times), times))
    best = pareto.ranked(known.join(counterfactual.with_id(own, times).select("case_id", "intervention_id"), ["case_id", "intervention_id"], "left_semi"), named=False).where("selected")
    compared = traverse.cut_lineage(evaluate.forecast_comparison(best, pareto.robust_choice(expected.where("forecast_status = 'ready'")), known, times))
    notes = compared.select("strategy", F.explode("notes").alias("note")).groupBy("strategy", "note").count()
    noted = notes.groupBy("strategy").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "note", "count"))), ",").alias("notes"))
    return evaluate.forecast_totals(compared).join(noted, "strategy")


def _risk_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Features of the observed accounts at noon, labelled by whether a failed transfer reaches them that day: even days to learn from, odd ones to score."""
    moves = transfers(spark, d)
    failing = moves.where("status = 'failed'").select("case_id", F.col("receiver").alias("account")).distinct()
    rows = traverse.cut_lineage(risk.labelled_features(moves, times_of(moves), failing, institutions_of(moves)))
    even = F.substring("case_id", 9, 2).cast("int") % 2 == 0
    return rows.where(even), rows.where(~even)


@_register("next_hop_fitted")
def next_hop_fitted(spark: SparkSession, d: str) -> DataFrame:
    """Most likely next receivers of every sender of the odd days at noon, by a model of which pairs of the even days send later."""
    moves = scan.active(transfers(spark, d))
    times, banks = times_of(moves), institutions_of(moves)
    later = moves.join(times, "case_id").where("occurred_at > as_of").select("case_id", F.col("sender").alias("source"), F.col("receiver").alias("candidate"))
    even = F.substring("case_id", 9, 2).cast("int") % 2 == 0
    related = traverse.cut_lineage(features.next_hop_features(moves, times, None, banks, alike_alone=False))
    candidates = traverse.cut_lineage(features.institution_candidates(moves, times, banks))
    model = risk.next_hop_model().fit(traverse.cut_lineage(risk.weighted_pairs(related.where(even), candidates.where(even), later.where(even))), weight="weight")
    known = moves.join(times, "case_id").where("occurred_at <= as_of").where(~even).drop("as_of")
    ancestors = traverse.cut_lineage(traverse.upstream(known, scan.accounts(known)))
    return risk.fitted_next_hops_by_institution(related.where(~even), candidates.where(~even), model, ancestors, top_k=3)


@_register("mule_risk_scores")
def mule_risk_scores(spark: SparkSession, d: str) -> DataFrame:
    """Risk of every account of the odd days by a model of the even days."""
    known, asked = _risk_rows(spark, d)
    return risk.risk_predictions(risk.risk_model().fit(known).score(asked)).drop("signals")


@_register("investigation_report")
def investigation_report(spark: SparkSession, d: str) -> DataFrame:
    """All seven stages over the observed transfers: the selected intervention of every case, with its reason, cut and forecast."""
    moves = transfers(spark, d)
    flows = scan.legs(moves).groupBy("case_id", "account").agg(F.count_if(F.col("direction") == "out").alias("outs"))
    model = risk.risk_model().fit(_risk_rows(spark, d)[0])
    report = investigate(moves, Request(times_of(moves), seeds(moves), sinks=flows.where("outs = 0").select("case_id", "account"), institutions=institutions_of(moves), model=model)).frames
    cut = report["chokepoint_report"].select("case_id", F.col("status").alias("cut_status"), "cut_size", "verified")
    ahead = report["paths"].groupBy("case_id").agg(F.count("*").alias("forecast_paths"))
    risky = report["risk"].groupBy("case_id").agg(F.max("risk_score").alias("highest_risk"))
    told = report["selected"].select("case_id", "intervention_id", "kind", "target_account", "intercepted", "legitimate", "reason", F.array_join("binding", ",").alias("binding"))
    return told.join(cut, "case_id", "left").join(ahead, "case_id", "left").join(risky, "case_id", "left")


@_register("institution_participation", _with("SELECT institution, count(*) AS legs, CAST(sum(amt) AS BIGINT) AS volume FROM (SELECT sender_inst AS institution, amount_minor_units AS amt FROM transfers UNION ALL SELECT receiver_inst, amount_minor_units FROM transfers) GROUP BY ALL"))
def institution_participation(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.institution_participation(transfers(spark, d))


# ---- windows over time and extensions -------------------------------------------------------------


@_register("window_velocity", _with("SELECT sender AS account, time_bucket(INTERVAL 1 HOUR, occurred_at) AS window_start, count(*) AS transfers, CAST(sum(amount_minor_units) AS BIGINT) AS volume FROM a GROUP BY ALL"))
def window_velocity(spark: SparkSession, d: str) -> DataFrame:
    found = stream.velocity(transfers(spark, d), "1 hour")
    return found.select("account", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "transfers", "volume")


@_register(
    "session_bursts",
    _with(""", g AS (SELECT *, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY sender ORDER BY occurred_at) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM a), h AS (SELECT *, sum(fresh) OVER (PARTITION BY sender ORDER BY occurred_at) AS k FROM g)
        SELECT sender AS account, min(occurred_at) AS session_start, count(*) AS transfers, CAST(sum(amount_minor_units) AS BIGINT) AS volume FROM h GROUP BY sender, k"""),
)
def session_bursts(spark: SparkSession, d: str) -> DataFrame:
    found = stream.sessions(transfers(spark, d), "2 hours")
    return found.select("account", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "transfers", "volume")


@_register("volume_rollup", _with("SELECT sender_inst, channel, count(*) AS transfers, CAST(sum(amount_minor_units) AS BIGINT) AS volume, count(DISTINCT receiver) AS receivers FROM a GROUP BY ROLLUP (sender_inst, channel)"))
def volume_rollup(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d))
    return moves.rollup("sender_inst", "channel").agg(F.count("*").alias("transfers"), F.sum("amount_minor_units").alias("volume"), F.count_distinct("receiver").alias("receivers"))




# ---- texts and ids --------------------------------------------------------------------------------


@_register(
    "rupee_text",
    _with("""SELECT case_id, account, '₹' || CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(..)', '\\1,', 'g')), ',') || ',' || right(w, 3) END || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') AS volume
        FROM (SELECT *, CAST(m // 100 AS VARCHAR) AS w FROM (SELECT case_id, sender AS account, CAST(sum(amount_minor_units * 977) AS BIGINT) AS m FROM a GROUP BY ALL))"""),
)
def rupee_text(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d))
    return moves.groupBy("case_id", F.col("sender").alias("account")).agg(rupees(F.sum(F.col("amount_minor_units") * 977)).alias("volume"))


@_register("intervention_ids", _with("SELECT DISTINCT case_id, sender AS target_account, 'cf-' || left(sha256('account_hold:' || sender || ':' || strftime(as_of, '%Y-%m-%dT%H:%M:%S') || '+00:00'), 16) AS intervention_id FROM a JOIN times USING (case_id)"))
def intervention_ids(spark: SparkSession, d: str) -> DataFrame:
    moves = scan.active(transfers(spark, d))
    types = dict(moves.dtypes)
    holds = moves.select("case_id", F.lit("account_hold").alias("kind"), F.col("sender").alias("target_account"), F.lit(None).cast(types["event_id"]).alias("target_event")).distinct()
    return counterfactual.with_id(counterfactual.valid(holds), times_of(moves)).select("case_id", "target_account", "intervention_id")


@_register(
    "selection_explained",
    _with(f"""{_OPTIONS}, sl AS (SELECT case_id, intervention_id, row_number() OVER (PARTITION BY case_id ORDER BY intercepted DESC, legitimate, eff DESC, affected_accounts, affected_edges, intervention_id) AS n FROM fr)
        SELECT j.case_id, j.intervention_id, round(eff, 6) AS efficiency, CASE WHEN n = 1 THEN 'recommended: feasible and Pareto-efficient, first by recovery, collateral, efficiency, scope and id' WHEN n > 1 THEN 'Pareto-efficient, but later by the tie-breaking order'
            WHEN feasible THEN 'dominated on one or more objectives' ELSE 'infeasible: ' || concat_ws(', ', CASE WHEN legitimate > 12000 THEN 'maximum_legitimate_capital_affected' END, CASE WHEN affected_edges > 40 THEN 'maximum_affected_edges' END) END AS reason
        FROM j LEFT JOIN sl USING (case_id, intervention_id)""", dense=True),
)
def selection_explained(spark: SparkSession, d: str) -> DataFrame:
    rows = pareto.explained(_options(spark, d), LIMITS)
    return rows.select("case_id", "intervention_id", F.round(F.col("efficiency").cast("double"), 6).alias("efficiency"), "reason")


@_register("candidate_table", _with(f"{_OPTIONS} SELECT case_id, intervention_id, legitimate, CAST(row_number() OVER (PARTITION BY case_id ORDER BY legitimate, intervention_id) AS INTEGER) AS place FROM j WHERE feasible", dense=True))
def candidate_table(spark: SparkSession, d: str) -> DataFrame:
    rows = pareto.candidate_table(pareto.judged(_options(spark, d), LIMITS), "legitimate", ascending=True, feasible_only=True)
    return rows.select("case_id", "intervention_id", "legitimate", "place")


@_register("source_interception", _with(f"{_WORLDS} SELECT ids.case_id, intervention_id, source_id, intercepted, residual FROM ids JOIN rs USING (case_id, intervention_id) JOIN s ON s.case_id = ids.case_id", dense=True, recursive=True))
def source_interception(spark: SparkSession, d: str) -> DataFrame:
    moves, marked, allocated, times = _decided(spark, d)
    options = traverse.cut_lineage(counterfactual.with_id(counterfactual.candidates(moves, allocated, times), times))
    return counterfactual.source_details(moves, marked, allocated, options, times)


@_register("chokepoint_edges")
def chokepoint_edges(spark: SparkSession, d: str) -> DataFrame:
    """Least-collateral cuts between each case's seed receiver and five other accounts, of events after the seed, with the search's report."""
    moves, marked, allocated, _ = _decided(spark, d)
    first = marked.join(moves, ["case_id", "transaction_id"])
    times = first.select("case_id", F.col("occurred_at").alias("as_of"))
    origin = first.select("case_id", F.col("receiver").alias("account"))
    five = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))).alias("account")
    sinks = moves.select("case_id").distinct().select("case_id", five).join(origin, ["case_id", "account"], "left_anti")
    later = scan.active(moves).join(times, "case_id").where("occurred_at > as_of")
    report, edges = chokepoint.reports(moves, later, counterfactual.edge_hold_collateral(allocated, times), origin, sinks)
    told = report.select("case_id", "verified", "initial_paths", "residual_paths", "cut_size")
    return edges.select("case_id", "status", F.col("cost").cast("string").alias("cost"), "residual_path", "event_id", "collateral", "position").join(told, "case_id")
