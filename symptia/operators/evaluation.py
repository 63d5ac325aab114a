"""Scoring of predictions against scenarios, metrics and the release gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.operators.ordering import order_statistic

SKIPPED = f"Skipped: {fv.OUTAGE_MARKER}."
BY_RULES = f"{fv.OUTAGE_MARKER}: answered by rules"


def score(scenarios: DataFrame, predictions: DataFrame) -> DataFrame:
    """One scored row per scenario; a scenario without prediction was skipped.

    ``scenarios`` (id, expected_level, should_escalate, should_ask_followup,
    ...), ``predictions`` (id, blocked, is_emergency, used_fallback, level,
    needs_clarification, latency_ms, quality, error).
    """
    joined = scenarios.join(predictions.withColumn("_ran", F.lit(True)), "id", "left")
    blocked = F.coalesce(F.col("blocked"), F.lit(False))
    error = F.when(F.col("_ran").isNull(), SKIPPED).when(~blocked & F.col("used_fallback"), BY_RULES).when(~blocked, F.col("error"))
    rows = joined.withColumn("guardrail_blocked", blocked).withColumn("error", error)
    ok, failed = F.col("error").isNull(), F.col("error").isNotNull()
    escalated = F.when(blocked, F.col("is_emergency")).otherwise(F.col("level") == "RED")
    actual = F.when(blocked, F.when(F.col("is_emergency"), "RED").otherwise("YELLOW")).when(ok, F.col("level"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumn("actual_level", actual).select(
        *[c for c in scenarios.columns],
        "actual_level",
        yes(ok & (F.col("actual_level") == F.col("expected_level"))).alias("level_correct"),
        yes(ok & (F.col("should_escalate") == escalated)).alias("escalation_correct"),
        yes(ok & ~blocked & (F.col("should_ask_followup") == F.col("needs_clarification"))).alias("followup_correct"),
        F.when(ok & ~blocked, F.col("quality")).alias("response_quality"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"),
        "error", "guardrail_blocked",
    )


def aggregate(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and rates; errored rows are counted and excluded. A rate over
    nothing is NULL, not zero."""
    by = by or []
    ran = F.col("error").isNull()
    expected, actual = F.col("expected_level"), F.col("actual_level")
    n = lambda c: F.count_if(ran & c)
    counts = scored.groupBy(*by).agg(
        F.count("*").alias("scenarios"),
        F.count_if(~ran).alias("error_count"),
        F.count_if(ran).alias("total"),
        n(F.col("level_correct")).alias("level_correct"),
        n(expected == "RED").alias("red_total"),
        n((expected == "RED") & (actual == "RED")).alias("red_correct"),
        n(expected == "GREEN").alias("green_total"),
        n((expected == "GREEN") & (actual == "RED")).alias("green_false_alarm"),
        n(F.col("should_ask_followup")).alias("followup_should_ask"),
        n(F.col("should_ask_followup") & F.col("followup_correct")).alias("followup_asked"),
        F.avg(F.when(ran, F.col("response_quality"))).alias("avg_quality"),
        F.coalesce(F.avg(F.when(ran, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if(F.contains("error", F.lit(fv.OUTAGE_MARKER))).alias("outages"),
    )
    return counts.withColumns({
        "triage_accuracy": F.try_divide("level_correct", "total"),
        "escalation_recall": F.try_divide("red_correct", "red_total"),
        "false_alarm_rate": F.try_divide("green_false_alarm", "green_total"),
        # named precision by convention; it is asked over should-ask
        "followup_precision": F.try_divide("followup_asked", "followup_should_ask"),
    })


def p95_latency(df: DataFrame, by: list[str], value: str = "latency_ms", out: str = "p95_latency_ms") -> DataFrame:
    """Position ``max(0, int(n * 0.95) - 1)`` of the sorted values."""
    return order_statistic(df, by, value, F.greatest(F.lit(1), F.floor(F.col("n") * 0.95)), out=out)


def outcome(error_count: Column, total: Column, recall: Column, red_total: Column,
            max_error_rate: float = fv.MAX_ERROR_RATE) -> Column:
    """pass, inconclusive or safety_failure. Too many errors or too few RED
    rows prove nothing either way."""
    error_rate = F.coalesce(F.try_divide(error_count, total), F.lit(1.0))
    return (
        F.when(error_rate > max_error_rate, "inconclusive")
        .when(recall.isNull() | (red_total < fv.MIN_RED), "inconclusive")
        .when(recall >= fv.RECALL_TARGET, "pass")
        .otherwise("safety_failure")
    )


def exit_code(label: Column) -> Column:
    return F.when(label == "pass", 0).when(label == "inconclusive", 1).otherwise(2)


def level_breakdown(scored: DataFrame) -> DataFrame:
    """Per expected level: rows, correct rows, wrong rows without an error.
    Errored rows stay in the denominator."""
    return scored.groupBy("expected_level").agg(
        F.count("*").alias("rows"), F.count_if("level_correct").alias("correct"),
        F.count_if(~F.col("level_correct") & F.col("error").isNull()).alias("failures"),
    )


def missed_red(scored: DataFrame) -> DataFrame:
    """RED scenarios that got another level without an error."""
    return scored.filter(
        (F.col("expected_level") == "RED") & F.col("error").isNull() & ~F.col("actual_level").eqNullSafe(F.lit("RED"))
    )


def id_subset(scored: DataFrame, prefix: str) -> DataFrame:
    return scored.filter(F.startswith(F.col("id").cast("string"), F.lit(prefix)))


def summary(scored: DataFrame, by: list[str] | None = None, max_error_rate: float = fv.MAX_ERROR_RATE) -> DataFrame:
    """The summary of a report, one row per group: rounded rates, the gate and
    latencies. Undefined values stay NULL."""
    by = by or []
    m = aggregate(scored, by)
    ran = scored.filter(F.col("error").isNull())
    if by:
        m = m.join(p95_latency(ran, by), by, "left")
    else:
        whole = p95_latency(ran.withColumn("_all", F.lit(0)), ["_all"])
        m = m.withColumn("_all", F.lit(0)).join(whole, "_all", "left").drop("_all")
    label = outcome(F.col("error_count"), F.col("scenarios"), F.col("escalation_recall"), F.col("red_total"), max_error_rate)
    return m.select(
        *by, F.col("scenarios").alias("total_scenarios"), (F.col("total") + F.col("error_count")).alias("ran"),
        F.col("error_count").alias("errors"), label.alias("outcome"),
        *[text.rounded(c, 4).alias(c) for c in ("triage_accuracy", "escalation_recall")],
        (F.col("escalation_recall") >= fv.RECALL_TARGET).alias("escalation_recall_pass"),
        F.col("red_total").alias("red_scenarios_evaluated"),
        *[text.rounded(c, 4).alias(c) for c in ("false_alarm_rate", "followup_precision")],
        text.rounded(F.nullif("avg_quality", F.lit(0.0)), 2).alias("avg_response_quality"),
        text.rounded("avg_latency_ms", 1).alias("avg_latency_ms"),
        text.rounded(F.coalesce("p95_latency_ms", F.lit(0.0)), 1).alias("p95_latency_ms"),
        F.col("outages"),
    )
