"""Tolerant parsing of model output: structured verdicts, scores, ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text

VERDICT_SCHEMA = (
    "triage_level string, possible_conditions array<string>, recommended_actions array<string>"
)
_CORRUPT = "_broken"


def _count(c: Column, sign: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))


def _closed(c: Column) -> Column:
    """Exactly one object and nothing after it; Spark's reader by itself would
    ignore trailing text. Strings are blanked before looking at brackets."""
    bare = F.regexp_replace(c, r'"(?:[^"\\]|\\.)*"', '""')
    return text.bind(
        text.strip(bare),
        lambda b: (_count(b, "{") == _count(b, "}"))
        & (_count(b, "[") == _count(b, "]"))
        & b.endswith("}")
        & ~b.rlike(r"\}\s*[^\s,\]\}]"),
    )


def _read(c: Column) -> Column:
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": _CORRUPT,
        "allowSingleQuotes": "false",
    }
    parsed = F.from_json(c, f"{VERDICT_SCHEMA}, {_CORRUPT} string", options)
    return text.bind(parsed, lambda p: F.when(_closed(c) & p[_CORRUPT].isNull(), p))


def json_body(c: Column) -> Column:
    """Text from the first brace on, code fences removed; NULL without one."""
    clean = text.strip(F.regexp_replace(c, "```(?:json)?", ""))
    return text.bind(
        clean, lambda t: F.when(F.contains(t, F.lit("{")), t.substr(F.instr(t, "{"), F.length(t)))
    )


def repair(c: Column) -> Column:
    """Close what a cut-off answer left open: string, arrays, objects."""

    def closed_by(sign_open: str, sign: str):
        missing = lambda t: F.greatest(_count(t, sign_open) - _count(t, sign), F.lit(0))
        return lambda t: F.concat(t, F.repeat(F.lit(sign), missing(t)))

    steps = [
        lambda t: F.when(t.endswith(","), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t),
        lambda t: F.when(_count(t, '"') % 2 != 0, F.concat(t, F.lit('"'))).otherwise(t),
        closed_by("[", "]"),
        closed_by("{", "}"),
    ]
    c = F.rtrim(c, F.lit(fv.WHITESPACE))
    for step in steps:
        c = text.bind(c, step)
    return c


def cap_list(c: Column) -> Column:
    return F.slice(c, 1, fv.LIST_CAP)


def parse_verdict(c: Column) -> Column:
    """Struct (level, conditions, actions); anything unreadable is YELLOW."""
    none = F.array().cast("array<string>")

    def verdict(data: Column) -> Column:
        level = F.upper(text.strip(data["triage_level"]))
        return F.struct(
            F.when(level.isin(fv.LEVELS), level).otherwise("YELLOW").alias("level"),
            F.coalesce(cap_list(data["possible_conditions"]), none).alias("conditions"),
            F.coalesce(cap_list(data["recommended_actions"]), none).alias("actions"),
        )

    read = text.bind(json_body(c), lambda b: F.coalesce(_read(b), _read(repair(b))))
    return text.bind(read, verdict)


def parse_score(c: Column) -> Column:
    """First token as a number clamped to [0, 1]; -1.0 when there is none."""
    number_form = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    token = F.try_element_at(text.words(c), F.lit(1))
    number = text.bind(token, lambda t: F.when(t.rlike(number_form), t.try_cast("double")))
    # greatest() and least() skip NULL, so the missing case is decided first
    return text.bind(
        number,
        lambda v: F.when(v.isNull(), fv.UNSCORED).otherwise(
            F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        ),
    )


def parse_rating(c: Column) -> Column:
    """First character as a rating from 1 to 5, else NULL."""
    digit = text.strip(c).substr(1, 1).try_cast("double")
    return F.when(digit.between(1, 5), digit)
