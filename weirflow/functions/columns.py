"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLEAN = "__clean__"
RATIO = "decimal(38,18)"


def proportional_allocation(amount: Column, components: Column) -> Column:
    """Split ``amount`` over ``components`` (array of struct ``key``, ``balance``) by largest remainder.

    Each part is ``amount * balance div total``; units left over go one each by
    larger remainder, then smaller key (code-point order). Nothing is allotted
    of an empty pool or a zero amount. An amount beyond the pool, or a negative
    number, is an error. Products are decimals, so they do not overflow.
    """
    wide = "decimal(38,0)"
    total = F.aggregate(components, F.lit(0).cast(wide), lambda a, c: (a + c["balance"].cast(wide)).cast(wide))
    negative = (amount < 0) | F.exists(components, lambda c: c["balance"] < 0)
    product = lambda c: (amount.cast("decimal(19,0)") * c["balance"].cast("decimal(19,0)")).cast(wide)
    safe = F.greatest(total, F.lit(1).cast(wide))
    parts = F.transform(
        components,
        lambda c: F.struct(
            (-(product(c) % safe)).alias("order"), c["key"].alias("key"),
            ((product(c) - product(c) % safe) / safe).cast(wide).alias("base"),
        ),
    )
    sorted_ = F.array_sort(parts)
    given = F.aggregate(sorted_, F.lit(0).cast(wide), lambda a, p: (a + p["base"]).cast(wide))
    left = amount.cast(wide) - given
    shared = F.transform(
        sorted_, lambda p, i: F.struct(p["key"].alias("key"), (p["base"] + F.when((total > 0) & (i < left), 1).otherwise(0)).cast("bigint").alias("amount"))
    )
    return (
        F.when(negative, F.raise_error(F.lit("amounts and balances must not be negative")))
        .when((amount > total) & (total > 0), F.raise_error(F.lit("amount is larger than the pool")))
        .otherwise(F.array_sort(shared))
    )


def intervention_id(kind: Column, target: Column, time: Column) -> Column:
    """``cf-`` and 16 hex digits of the SHA-256 of ``kind:target:time`` (ISO 8601, UTC)."""
    return F.concat(F.lit("cf-"), F.substring(F.sha2(F.concat_ws(":", kind, target.cast("string"), iso(time)), 256), 1, 16))


def iso(time: Column) -> Column:
    """ISO 8601 with offset; microseconds only where there are any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(time, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", F.lit("")).otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def recovery_efficiency(intercepted: Column, collateral: Column) -> Column:
    """Intercepted per unit of collateral, at least one unit; negatives are an error."""
    ratio = intercepted.cast(RATIO) / F.greatest(F.lit(1), collateral).cast(RATIO)
    return F.when((intercepted < 0) | (collateral < 0), F.raise_error(F.lit("capital values must not be negative")).cast(RATIO)).otherwise(ratio.cast(RATIO))


def benchmark_efficiency(intercepted: Column, collateral: Column) -> Column:
    """As reported by benchmarks: null if both are zero, the recovery itself if nothing is affected."""
    return F.when(collateral > 0, F.try_divide(intercepted.cast(RATIO), collateral.cast(RATIO)).cast(RATIO)).when(intercepted > 0, intercepted.cast(RATIO))


def confidence(score: Column, maturity: Column, total: Column) -> Column:
    """Confidence of a risk score by evidence maturity (0 limited, 1 flow, 2 history), four decimals, half to even."""
    margin = F.abs(score - 0.5) * 2.0
    limited = F.least(F.lit(0.55), 0.35 + 0.20 * margin)
    flow = F.least(F.lit(0.90), F.greatest(F.lit(0.40), 0.50 + 0.40 * margin * F.least(F.lit(1.0), total / 4.0)))
    strong = F.least(F.lit(0.98), F.greatest(F.lit(0.50), 0.60 + 0.38 * margin))
    return F.bround(F.when(maturity == 0, limited).when(maturity == 1, flow).otherwise(strong), 4)


def evidence_signals() -> Column:
    """Rule-based signals over account features: array of (feature, value, contribution)."""
    c = F.col
    # fixed values: thresholds and contributions of the rules
    rules = [
        ("forwarding_ratio", c("forwarding_ratio"), 0.35, c("forwarding_ratio") >= 0.85),
        ("forwarding_ratio", c("forwarding_ratio"), -0.25, (c("forwarding_ratio") < 0.15) & (c("in_degree") > 3)),
        ("min_pass_through_seconds", c("min_pass_through_seconds"), 0.30, (c("has_rapid_pass_through") == 1) & (c("min_pass_through_seconds") < 300)),
        ("fan_in_ratio", c("fan_in_ratio"), 0.20, (c("in_degree") >= 3) & (c("fan_in_ratio") > 0.65)),
        ("fan_out_ratio", c("fan_out_ratio"), 0.20, (c("out_degree") >= 3) & (c("fan_out_ratio") > 0.65)),
        ("is_cold_start", F.lit(1.0), 0.15, c("is_cold_start") == 1),
        ("historical_tx_count", c("historical_tx_count"), -0.15, (c("is_cold_start") == 0) & (c("historical_tx_count") >= 5)),
        ("burst_ratio_1h", c("burst_ratio_1h"), 0.15, (c("burst_ratio_1h") > 0.8) & (c("total_degree") >= 3)),
    ]
    return F.array_compact(
        F.array(*(F.when(when, F.struct(F.lit(n).alias("feature"), v.cast("double").alias("value"), F.lit(s).alias("contribution"))) for n, v, s, when in rules))
    )


def evidence_summary(signals: Column, score: Column) -> Column:
    """A sentence for each signal, or one for none."""
    pct = lambda v: F.format_number(v * 100, 1)

    def sentence(s: Column) -> Column:
        return (
            F.when((s["feature"] == "forwarding_ratio") & (s["contribution"] > 0), F.concat(F.lit("Forwards "), pct(s["value"]), F.lit("% of what comes in")))
            .when(s["feature"] == "forwarding_ratio", F.concat(F.lit("Keeps most of what comes in, forwards "), pct(s["value"]), F.lit("%")))
            .when(s["feature"] == "min_pass_through_seconds", F.concat(F.lit("Passes money on within "), F.format_number(s["value"], 0), F.lit(" s")))
            .when(s["feature"] == "fan_in_ratio", F.lit("Many incoming flows converge"))
            .when(s["feature"] == "fan_out_ratio", F.lit("Disperses to many recipients"))
            .when(s["feature"] == "is_cold_start", F.lit("No history before the incident"))
            .when(s["feature"] == "historical_tx_count", F.concat(F.format_number(s["value"], 0), F.lit(" earlier transactions")))
            .otherwise(F.concat(pct(s["value"]), F.lit("% of activity in the last hour")))
        )

    none = F.when(score > 0.5, F.lit("Unusual activity across the graph")).otherwise(F.lit("In line with usual transaction flow"))
    return F.when(F.size(signals) > 0, F.array_join(F.transform(signals, sentence), "; ")).otherwise(none)


def rupees(minor: Column) -> Column:
    """Minor units in Indian digit grouping: 1234567890 -> 1,23,45,678.90."""
    whole = F.floor(F.abs(minor) / 100).cast("string")
    head, tail = F.substr(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0))), F.right(whole, F.lit(3))
    grouped = F.regexp_replace(head, r"(?<=\d)(?=(\d\d)+$)", ",")
    text = F.when(head == "", tail).otherwise(F.concat(grouped, F.lit(","), tail))
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.lit("₹"), text, F.lit("."), F.lpad((F.abs(minor) % 100).cast("string"), 2, "0"))


def compact_rupees(minor: Column) -> Column:
    """Minor units in crore, lakh or thousand."""
    value = F.abs(minor) / 100.0
    text = (
        F.when(value >= 1e7, F.concat(F.format_number(value / 1e7, 2), F.lit("Cr"))).when(value >= 1e5, F.concat(F.format_number(value / 1e5, 2), F.lit("L")))
        .when(value >= 1e3, F.concat(F.format_number(value / 1e3, 1), F.lit("K"))).otherwise(F.format_number(value, 0))
    )
    return F.concat(F.when(minor < 0, "-").otherwise(""), F.lit("₹"), text)


# fixed values: how the status of an investigation stage is shown
_BADGES = {
    "completed": ("Available", "success"),
    "available": ("Available", "success"),
    "insufficient_evidence": ("Insufficient Evidence", "warning"),
    "infeasible": ("Policy Infeasible", "warning"),
    "unavailable": ("Unavailable", "neutral"),
    "failed": ("Failed", "danger"),
    "skipped": ("Skipped", "neutral"),
}


def stage_badge(status: Column) -> Column:
    """``label`` and ``variant`` of a stage's status; an unknown status is its own label."""
    table = F.create_map(*(x for k, (a, b) in _BADGES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("label"), F.lit(b).alias("variant")))))
    return F.coalesce(F.try_element_at(table, status), F.struct(status.alias("label"), F.lit("neutral").alias("variant")))


def is_stale(analysed_at: Column, decision_time: Column) -> Column:
    """Whether there is an analysis and it was made for another time."""
    return F.coalesce(analysed_at != decision_time, F.lit(False))


def trade_off(intercepted: Column, legitimate: Column) -> Column:
    """What a hold recovers, and at what cost."""
    ratio = F.format_number(intercepted / F.greatest(F.lit(1), legitimate), 1)
    return F.when(legitimate == 0, F.concat(F.lit("Recovers "), rupees(intercepted), F.lit(" and affects nobody else"))).otherwise(
        F.concat(F.lit("Recovers "), rupees(intercepted), F.lit(" and affects "), rupees(legitimate), F.lit(" ("), ratio, F.lit("x)"))
    )


def as_list(value: Column, is_list: bool) -> Column:
    """A list from a value that may be one or a single item; null gives an empty list."""
    return F.coalesce(value if is_list else F.when(value.isNotNull(), F.array(value)), F.array())
