"""Input rules: predicates, the priority cascade and the refusal texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import messages, text
from symptia.functions.regexes import extract_all, has_literal, matches


# ---------------------------------------------------------------- predicates
def is_suicidal(q: Column) -> Column:
    return has_literal(q, fv.SUICIDAL_LITERALS)


def is_overdose(q: Column) -> Column:
    return matches(q, fv.OVERDOSE_PATTERNS)


def months_mentioned(q: Column) -> Column:
    """Ages in months stated in the text; an age without a number is ''."""
    digits = text.plain_digits(q)
    first, second = fv.AGE_IN_MONTHS_PATTERNS
    return F.concat(extract_all(digits, first, 1), extract_all(digits, second, 1))


def is_infant(q: Column) -> Column:
    young = F.exists(
        months_mentioned(q),
        lambda m: (m == "") | (m.try_cast("int") < fv.INFANT_MONTHS),
    )
    return has_literal(q, fv.INFANT_LITERALS) | matches(q, fv.INFANT_AGE_PATTERNS) | young


def is_pregnancy(q: Column) -> Column:
    return matches(q, fv.PREGNANCY_PATTERNS)


def is_lab_result(q: Column) -> Column:
    return has_literal(q, fv.LAB_LITERALS)


def is_medication_request(q: Column) -> Column:
    return matches(q, fv.MEDICATION_REQUEST_PATTERNS)


def is_refusal(q: Column) -> Column:
    return has_literal(q, fv.REFUSAL_LITERALS)


def compound_flag(q: Column) -> Column:
    """Name of the first compound flag with both sides present, else NULL."""
    flag = F.lit(None).cast("string")
    for name, side_a, side_b in reversed(fv.COMPOUND_FLAGS):
        b = has_literal(q, side_b)
        if name == fv.JAW_FLAG:
            b = b | matches(q, fv.JAW_PATTERN)
        flag = F.when(has_literal(q, side_a) & b, name).otherwise(flag)
    return flag


# ------------------------------------------------------------------- cascade
# rule, violation type, escalates to RED; in order of priority
CASCADE = [
    ("suicidal", "suicidal_ideation", False, is_suicidal),
    ("overdose", "emergency_red_flag", True, is_overdose),
    ("infant", "scope_infant", True, is_infant),
    ("pregnancy", "scope_pregnancy", True, is_pregnancy),
    ("lab", "scope_lab_results", False, is_lab_result),
    ("compound", "emergency_red_flag", True, lambda q: compound_flag(q).isNotNull()),
    ("medication", "scope_medication", False, is_medication_request),
]
EMERGENCY_VIOLATIONS = ["emergency_red_flag", "suicidal_ideation"]


def first_rule(q: Column) -> Column:
    """Id of the first rule that fires, NULL when the text is safe. ``when``
    stops at the first hit, so later rules cost nothing on decided rows."""
    chain = F
    for rule, _, _, predicate in CASCADE:
        chain = chain.when(predicate(q), rule)
    return chain.otherwise(F.lit(None).cast("string"))


def _from_rule(rule: Column, position: int, otherwise) -> Column:
    mapping = F.create_map(*[F.lit(x) for r in CASCADE for x in (r[0], r[position])])
    return F.coalesce(mapping[rule], F.lit(otherwise))


def check_messages(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds rule, is_safe, violation_type, force_red and is_emergency.

    The alef-folded text is searched together with the original. Narrow: one
    pass over the rows, no shuffle.
    """
    violation = F.create_map(*[F.lit(x) for r in CASCADE for x in (r[0], r[1])])
    return (
        df.withColumn("rule", first_rule(text.with_folded(text_col)))
        .withColumn("is_safe", F.col("rule").isNull())
        .withColumn("violation_type", violation[F.col("rule")])
        .withColumn("force_red", _from_rule(F.col("rule"), 2, False))
        .withColumn("is_emergency", is_emergency_violation(F.col("force_red"), F.col("violation_type")))
    )


def is_emergency_violation(force_red: Column, violation: Column) -> Column:
    return force_red | F.coalesce(violation.isin(EMERGENCY_VIOLATIONS), F.lit(False))


def ensure_notice(reply: Column, emergency: Column, script: Column) -> Column:
    """Append the notice for script and severity unless already contained."""
    return text.bind(
        F.struct(reply.alias("reply"), messages.notice(script, emergency).alias("notice")),
        lambda s: F.when(F.contains(s["reply"], s["notice"]), s["reply"]).otherwise(
            F.concat(s["reply"], F.lit("\n\n"), s["notice"])
        ),
    )


def refusal_text(violation: Column, emergency: Column, script: Column) -> Column:
    message = F.coalesce(messages.refusal(violation, script), F.lit(""))
    return F.when(violation == "suicidal_ideation", message).otherwise(
        ensure_notice(message, emergency, script)
    )
