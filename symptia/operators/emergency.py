"""Emergency detection on a single message."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.functions.regexes import extract_all, has_literal, matches


def keyword_emergency(q: Column) -> Column:
    """An emergency phrase or red-flag wording, in the text or its folded form."""
    folded = text.fold_alef(q)

    def hit(t: Column) -> Column:
        return has_literal(t, fv.EMERGENCY_LITERALS) | matches(t, fv.RED_FLAG_PATTERNS)

    return hit(q) | ((folded != q) & hit(folded))


def glucose_readings(q: Column) -> Column:
    found = extract_all(q, fv.GLUCOSE_PATTERN, 1)
    return F.filter(F.transform(found, lambda m: text.plain_digits(m).try_cast("int")), lambda v: v.isNotNull())


def extreme_glucose(q: Column) -> Column:
    """A blood-sugar reading at or beyond either limit, in the original text."""
    return F.exists(
        glucose_readings(q), lambda v: (v >= fv.GLUCOSE_HIGH) | (v <= fv.GLUCOSE_LOW)
    )


def is_emergency(q: Column) -> Column:
    return keyword_emergency(q) | extreme_glucose(q)
