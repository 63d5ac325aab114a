"""Evaluation of a rule or model triage against expected levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.operators import evaluation
from symptia.session import materialise


def predictions_from(triaged: DataFrame, id_col: str) -> DataFrame:
    """Triage rows as predictions, without latencies, ratings and errors."""
    return triaged.select(
        F.col(id_col).alias("id"), (F.col("step") == "blocked").alias("blocked"), "is_emergency", "used_fallback",
        "level", "needs_clarification",
    )


def evaluate(scenarios: DataFrame, predictions: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, scored rows)."""
    # written once: the summary reads it several times, the report once more
    scored = materialise(evaluation.score(scenarios, predictions), "scored")
    return evaluation.summary(scored, by), scored


def write_report(summary: DataFrame, scored: DataFrame, folder: str) -> None:
    """Summary and per-scenario rows as JSON lines; NULL stays visible."""
    for name, df in [("summary", summary), ("results", scored)]:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
