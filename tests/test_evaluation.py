import json

import pytest
from pyspark.sql import functions as F

from symptia.operators import evaluation
from symptia.plans import evaluate

SCENARIO = "id string, expected_level string, should_escalate boolean, should_ask_followup boolean"
PREDICTION = ("id string, blocked boolean, is_emergency boolean, used_fallback boolean, level string, needs_clarification boolean, "
              "latency_ms double, quality double, error string")


def run(spark, rows):
    """rows: (expected, should_ask, prediction tuple or None)."""
    s = spark.createDataFrame([(str(i), e, e == "RED", a) for i, (e, a, _) in enumerate(rows)], SCENARIO)
    p = spark.createDataFrame([(str(i), *p) for i, (_, _, p) in enumerate(rows) if p], PREDICTION)
    return evaluation.score(s, p)


def pred(level, blocked=False, emergency=False, fallback=False, ask=False, ms=10.0, quality=None, error=None):
    return blocked, emergency, fallback, level, ask, ms, quality, error


def test_scoring(spark):
    rows = [("RED", True, pred(None, blocked=True, emergency=True)), ("GREEN", True, pred(None, blocked=True, ask=True)),
            ("RED", False, pred("RED", quality=4.0)), ("YELLOW", False, pred("YELLOW", fallback=True)), ("GREEN", False, None),
            ("GREEN", True, pred("GREEN", ask=True)), ("GREEN", False, pred(None, error="timeout"))]
    got = {r.id: r for r in run(spark, rows).collect()}
    flags = {i: (r.actual_level, r.level_correct, r.escalation_correct, r.followup_correct) for i, r in got.items()}
    assert flags["0"] == ("RED", True, True, False) and flags["1"] == ("YELLOW", False, True, False)
    assert flags["2"] == ("RED", True, True, True) and flags["5"] == ("GREEN", True, True, True)
    assert flags["3"][0] is None and "All providers failed" in got["3"].error and "All providers failed" in got["4"].error
    assert got["6"].error == "timeout" and flags["6"] == (None, False, False, False)


def test_undefined_is_not_zero(spark):
    m = evaluation.summary(run(spark, [("RED", False, pred(None, error="x"))])).collect()[0]
    assert m.triage_accuracy is None and m.escalation_recall is None and m.escalation_recall_pass is None and m.avg_response_quality is None
    assert (m.outcome, m.avg_latency_ms, m.p95_latency_ms, m.errors) == ("inconclusive", 0.0, 0.0, 1)
    empty = evaluation.summary(run(spark, [("RED", False, pred("RED"))]).filter("false")).collect()[0]
    assert (empty.total_scenarios, empty.outcome) == (0, "inconclusive")


@pytest.mark.parametrize("hits, misses, errors, want", [(20, 0, 0, "pass"), (19, 1, 0, "pass"), (18, 2, 0, "safety_failure"), (4, 0, 0, "inconclusive"), (20, 0, 3, "inconclusive"), (20, 0, 2, "pass")])
def test_gate(spark, hits, misses, errors, want):
    rows = [("RED", False, pred("RED"))] * hits + [("RED", False, pred("GREEN"))] * misses + [("GREEN", False, pred(None, error="e"))] * errors
    assert evaluation.summary(run(spark, rows)).collect()[0].outcome == want


def test_report(spark, tmp_path):
    rows = [("GREEN", True, pred("RED", ms=float(i))) for i in range(20)] + [("RED", False, pred("YELLOW"))]
    summary, scored = evaluate.evaluate(*[spark.createDataFrame(d, s) for d, s in (
        ([(f"edge_{i}", e, e == "RED", a) for i, (e, a, _) in enumerate(rows)], SCENARIO), ([(f"edge_{i}", *p) for i, (_, _, p) in enumerate(rows)], PREDICTION))])
    evaluate.write_report(summary, scored, str(tmp_path))
    line = json.loads(next((tmp_path / "summary").glob("*.json")).read_text())
    assert (line["false_alarm_rate"], line["escalation_recall"], line["avg_response_quality"], line["p95_latency_ms"]) == (1.0, 0.0, None, 17.0)
    assert [r.id for r in evaluation.missed_red(scored).collect()] == ["edge_20"]
    assert evaluation.id_subset(scored, "edge_2").count() == 2
    levels = {r.expected_level: (r.rows, r.correct, r.failures) for r in evaluation.level_breakdown(scored).collect()}
    assert levels == {"GREEN": (20, 0, 20), "RED": (1, 0, 1)}
    assert scored.filter(F.col("error").isNotNull()).count() == 0
