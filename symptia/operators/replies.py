"""Checks and rewrites on model text, and replies built from a classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import messages
from symptia.functions.regexes import java, matches


def has_diagnosis(t: Column) -> Column:
    return matches(t, fv.DIAGNOSIS_PATTERNS)


def has_medication(t: Column) -> Column:
    return matches(t, [fv.DOSAGE_PATTERN, fv.DRUG_PATTERN, fv.TAKE_DRUG_PATTERN])


def response_violation(t: Column) -> Column:
    """diagnosis_language, medication_reference or NULL."""
    return F.when(has_diagnosis(t), "diagnosis_language").when(
        has_medication(t), "medication_reference"
    )


def redact(t: Column) -> Column:
    """Soften diagnoses and remove doses and drug names; the order matters."""
    for pattern, replacement in fv.REDACTIONS:
        t = F.regexp_replace(t, java(pattern), replacement)
    return t


def needs_hedge(t: Column) -> Column:
    return has_diagnosis(t) & ~matches(t, fv.HEDGING_PATTERN)


def with_hedge(t: Column) -> Column:
    return F.when(needs_hedge(t), F.concat(F.lit(messages.HEDGE_NOTICE + "\n\n"), t)).otherwise(t)


def reply_from_classification(
    script: Column, level: Column, conditions: Column, actions: Column
) -> Column:
    """Fixed copy for RED or when there are no details; else labelled lists."""
    comma = F.when(script == "arabic", "، ").otherwise(", ")
    joined_conditions = F.array_join(conditions, "\u001f")
    listed = F.concat_ws(
        ".\n",
        F.when(
            F.size(conditions) > 0,
            F.concat(
                messages.fallback(script, F.lit("CONDITIONS")),
                F.replace(joined_conditions, F.lit("\u001f"), comma),
            ),
        ),
        F.when(
            F.size(actions) > 0,
            F.concat(messages.fallback(script, F.lit("ACTIONS")), F.array_join(actions, "; ")),
        ),
    )
    return (
        F.when(level == "RED", messages.fallback(script, F.lit("RED")))
        .when((F.size(conditions) == 0) & (F.size(actions) == 0), messages.fallback(script, level))
        .otherwise(F.concat(listed, F.lit(".")))
    )
