"""Triage of messages: by rules alone, with model outputs, and as events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import messages as copy
from symptia.functions import parsing, text
from symptia.functions.rows import explode_rows, join_on
from symptia.operators import conversation, emergency, guardrails, lexicon, replies

NONE = "array<string>"


def _no_strings() -> Column:
    return F.array().cast(NONE)


def with_symptoms(df: DataFrame, entries: DataFrame, id_cols: list[str], text_col: str, needed: Column) -> DataFrame:
    """Adds ``symptoms``, an ordered array of matches, for the rows that need
    them. A small dictionary is applied inside the row; a larger one is joined."""
    inside = lexicon.symptom_array(entries, F.col(text_col))
    if inside is not None:
        return df.withColumn("symptoms", F.when(needed, inside))
    found = lexicon.gather(lexicon.extract_symptoms(df.filter(needed), entries, id_cols, text_col), id_cols)
    joined = join_on(df, found, id_cols, "left")
    empty = F.from_json(F.lit("[]"), joined.schema["symptoms"].dataType.simpleString())
    return joined.withColumn("symptoms", F.when(needed, F.coalesce("symptoms", empty)))


def decide(df: DataFrame, entries: DataFrame, id_cols: list[str], context_col: str | None = None,
           judge_invalid: bool = True) -> DataFrame:
    """Adds the verdict columns and ``step``: which rule settles the message.

    invalid, blocked, refusal, emergency, vague or open; only ``open`` rows
    need a model. Cheap rules run first and the dictionary only on what is
    left. ``context_col`` is the text symptoms are looked up in (the message
    with its history); emergencies are judged on the message alone. With
    ``judge_invalid`` false the rules do not read invalid messages, whose step
    they never change: their verdict columns are those of a safe message.
    """
    context_col = context_col or "text"
    q = F.col("text")
    checked = df.withColumn("reason", conversation.request_problem(q))
    if judge_invalid:
        checked = guardrails.check_messages(checked)
    else:
        checked = guardrails.check_messages(checked.withColumn("_judged", F.when(F.col("reason").isNull(), q)), "_judged").drop("_judged")
    early = (
        F.when(F.col("reason").isNotNull(), "invalid")
        .when(~F.col("is_safe"), "blocked")
        .when(guardrails.is_refusal(q), "refusal")
        .when(emergency.is_emergency(q), "emergency")
    )
    marked = checked.withColumn("step", early)
    found = with_symptoms(marked, entries, id_cols, context_col, F.col("step").isNull() | (F.col("step") == "emergency"))
    vague = conversation.is_vague(F.col("symptoms"), F.col(context_col))
    return found.withColumn("step", F.coalesce("step", F.when(vague, "vague").otherwise("open")))


def triage_rules(df: DataFrame, entries: DataFrame, id_cols: list[str], script: Column, context_col: str | None = None,
                 judge_invalid: bool = True) -> DataFrame:
    """Triage without a model: level, reply, actions, notice."""
    d = decide(df, entries, id_cols, context_col, judge_invalid).withColumn("script", script)
    step, s = F.col("step"), F.col("script")
    level = (
        F.when(step == "refusal", "YELLOW").when(step == "emergency", "RED").when(step == "vague", "GREEN")
        .when(step == "open", lexicon.rule_level(F.col("symptoms")))
    )
    d = d.withColumn("level", level)
    red = F.col("level") == "RED"
    kind = F.when(step == "vague", "CLARIFY").when(red, "RED").otherwise("YELLOW")
    reply = (
        F.when(step == "invalid", F.lit(None))
        .when(step == "blocked", guardrails.refusal_text(F.col("violation_type"), F.col("is_emergency"), s))
        .when(step == "refusal", copy.REFUSAL_TEXT)
        .otherwise(copy.fallback(s, kind))
    )
    decided = ~step.isin("invalid", "blocked")
    actions = F.when(step == "refusal", F.array(F.lit(copy.REFUSAL_ACTION))).when(
        step.isin("emergency", "open"), copy.fallback_actions(s, F.col("level"))).otherwise(_no_strings())
    return d.select(
        *id_cols, "step", "rule", "violation_type", "force_red", "is_emergency", "level", reply.alias("reply"),
        F.when(red & decided, F.array(F.lit(copy.EMERGENCY_CONDITION))).otherwise(_no_strings()).alias("conditions"),
        actions.alias("actions"),
        F.when(decided, copy.result_notice(s, red)).alias("notice"),
        (step == "vague").alias("needs_clarification"), (step == "open").alias("used_fallback"), "script",
    )


def triage_with_model(df: DataFrame, outputs: DataFrame, entries: DataFrame, id_cols: list[str], script: Column,
                      context_col: str | None = None) -> DataFrame:
    """Triage with model outputs as a table (ids, verdict_text, reply_text); a
    NULL text means no provider answered. Replies are redacted and get the
    notice appended, as does the result's own notice."""
    d = join_on(decide(df, entries, id_cols, context_col).withColumn("script", script), outputs, id_cols, "left")
    step, s = F.col("step"), F.col("script")
    parsed = F.when((step == "open") & F.col("verdict_text").isNotNull(), parsing.parse_verdict(F.col("verdict_text")))
    d = d.withColumn("_v", parsed).withColumn("used_fallback", (step == "open") & F.col("verdict_text").isNull())
    fallback = F.col("used_fallback")
    level = (
        F.when(step == "refusal", "YELLOW").when(step == "emergency", "RED").when(step == "vague", "GREEN")
        .when(fallback, lexicon.rule_level(F.col("symptoms"))).when(step == "open", F.col("_v.level"))
    )
    d = d.withColumn("level", level)
    red = F.col("level") == "RED"
    alarm = F.array(F.lit(copy.EMERGENCY_CONDITION))
    conditions = F.when((step == "emergency") | (fallback & red), alarm).when((step == "open") & ~fallback, F.col("_v.conditions")).otherwise(_no_strings())
    actions = (
        F.when(step == "refusal", F.array(F.lit(copy.REFUSAL_ACTION)))
        .when((step == "emergency") | fallback, copy.fallback_actions(s, F.col("level")))
        .when(step == "open", F.col("_v.actions")).otherwise(_no_strings())
    )
    d = d.withColumn("conditions", conditions).withColumn("actions", actions)
    written = text.strip("reply_text")
    reply = (
        F.when(step == "refusal", copy.REFUSAL_TEXT)
        .when(step == "emergency", F.coalesce(written, copy.fallback(s, F.lit("RED"))))
        .when(step == "vague", F.coalesce(written, copy.fallback(s, F.lit("CLARIFY"))))
        .when(fallback, copy.fallback(s, F.when(red, "RED").otherwise("YELLOW")))
        .when(step == "open", F.coalesce(
            written, replies.reply_from_classification(s, F.col("level"), F.col("conditions"), F.col("actions"))))
    )
    english, is_red = F.lit("english"), F.coalesce(red, F.lit(False))
    safe = guardrails.ensure_notice(replies.redact(F.col("_reply")), is_red, english)
    blocked = guardrails.refusal_text(F.col("violation_type"), F.col("is_emergency"), s)
    return d.withColumn("_reply", reply).select(
        *id_cols, "step", "violation_type", "force_red", "is_emergency", "level",
        F.when(step == "blocked", blocked).otherwise(safe).alias("reply"), "conditions", "actions",
        F.when(~step.isin("invalid", "blocked"), guardrails.ensure_notice(copy.result_notice(s, red), is_red, english)).alias("notice"),
        (step == "vague").alias("needs_clarification"), "used_fallback", "script",
    )


# -------------------------------------------------------------------- events
_WORD_CUT = "(?<=[.!?؟،])(?=[^.!?؟، ]* )"
_TEXT_CUT = "(?s)(?<=[" + fv.SENTENCE_END + "])(?=[^" + fv.SENTENCE_END + "]*\\z)"


def _flushed(step: Column, reply: Column) -> Column:
    """The chunks a reader sees: fixed copy streams word by word, other copy
    in one piece; both are cut at sentence ends and redacted."""
    by_word = F.concat(F.array_join(text.words(reply), " "), F.lit(" "))
    cut = F.when(step.isin("refusal", "vague"), F.split(by_word, _WORD_CUT)).otherwise(F.split(reply, _TEXT_CUT))
    return F.transform(F.filter(cut, lambda c: c != ""), replies.redact)


def triage_events(triaged: DataFrame, id_cols: list[str]) -> DataFrame:
    """Event rows (ids, seq, type, ...) of triaged messages, in reading order:
    start, blocked; or start, triage_classified, chunk..., complete. Built in
    the row and exploded, so no ordering step is needed."""
    fields = {
        "type": "string", "content": "string", "triage_level": "string", "possible_conditions": NONE,
        "recommended_actions": NONE, "disclaimer": "string", "needs_clarification": "boolean",
        "follow_up_question": "string", "reason": "string", "message": "string", "force_red": "boolean",
    }

    def event(kind: str, **given: Column) -> Column:
        given["type"] = F.lit(kind)
        return F.struct(*[(given.get(n, F.lit(None))).cast(t).alias(n) for n, t in fields.items()])

    verdict = dict(triage_level=F.col("level"), possible_conditions=F.col("conditions"), recommended_actions=F.col("actions"),
                   needs_clarification=F.col("needs_clarification"))
    question = F.when(F.col("needs_clarification"), F.col("reply"))
    answered = F.concat(
        F.array(event("start"), event("triage_classified", **verdict)),
        F.transform(_flushed(F.col("step"), F.col("reply")), lambda c: event("chunk", content=c)),
        F.array(event("complete", disclaimer=F.col("notice"), follow_up_question=question, **verdict)),
    )
    blocked = F.array(event("start"), event(
        "blocked", reason=F.col("violation_type"), message=F.col("reply"), force_red=F.col("force_red")))
    every = F.when(F.col("step") == "blocked", blocked).when(F.col("step") != "invalid", answered)
    return explode_rows(triaged, id_cols, every, "e", "seq").select(*id_cols, "seq", "e.*")
