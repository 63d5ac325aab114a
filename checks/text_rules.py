"""Queries and SQL twins for text functions, input rules and output rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    MESSAGES, REPLIES, TRIM, messages, q, re2, read, replies, sql_any, sql_doubled, sql_fold,
    sql_language, sql_literals, sql_normalize, sql_script, sql_strip, sql_words, values,
)
from symptia.functions import fixed_values as fv
from symptia.functions import messages as copy
from symptia.functions import parsing, text
from symptia.functions.regexes import has_literal
from symptia.operators import emergency, guardrails
from symptia.operators import replies as rep

QUERIES, SQL = {}, {}


def register(name, query, sql):
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def per_message(name, column, spark_expr, sql_expr):
    register(
        name,
        lambda spark, sf: messages(spark, sf).select("conv_id", "turn", spark_expr().alias(column)),
        f"WITH {MESSAGES} SELECT conv_id, turn, {sql_expr} AS {column} FROM messages",
    )


def per_reply(name, column, spark_expr, sql_expr):
    register(
        name,
        lambda spark, sf: replies(spark, sf).select("conv_id", "turn", spark_expr().alias(column)),
        f"WITH {REPLIES} SELECT conv_id, turn, {sql_expr} AS {column} FROM replies",
    )


def per_document(name, select, sql):
    register(name, lambda spark, sf: read(spark, sf, "documents").select(*select()), sql)


# ------------------------------------------------------------ text functions
per_message("normalize_arabic", "normalized", lambda: text.normalize("text"), sql_normalize("text"))
per_message("fold_alef_doubling", "searched", lambda: text.with_folded("text"), sql_doubled("text"))
per_message(
    "arabic_digits_to_ascii", "digits", lambda: text.ascii_digits("text"),
    f"translate(text, {q(fv.ARABIC_DIGITS)}, {q(fv.ASCII_DIGITS)})",
)
per_message("language_identification", "language", lambda: text.detect_language("text"), sql_language("text"))
per_message("script_identification", "script", lambda: text.detect_script("text"), sql_script("text"))



def preference():
    return F.element_at(F.array(F.lit("auto"), F.lit("english"), F.lit("arabic")), (F.col("turn") % 3 + 1).cast("int"))




def response():
    return F.when(F.col("conv_id") % 2 == 0, "arabic").otherwise("franco")


SQL_PREFERENCE = "CASE turn % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'english' ELSE 'arabic' END"
SQL_RESPONSE = "CASE WHEN conv_id % 2 = 0 THEN 'arabic' ELSE 'franco' END"
SQL_OUTPUT_SCRIPT = (
    f"CASE WHEN {SQL_PREFERENCE} = 'english' THEN 'english' WHEN {SQL_RESPONSE} = 'franco' THEN 'franco' "
    f"WHEN {SQL_PREFERENCE} = 'auto' THEN {sql_script('text')} ELSE 'arabic' END"
)


def output_script():
    return text.output_script(preference(), response(), F.col("text"))


per_message("output_script_choice", "script", lambda: output_script(), SQL_OUTPUT_SCRIPT)


def sql_transliterate(col: str) -> str:
    out = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    for latin, arabic in [*fv.DIGRAPHS, ("x", "كس")]:
        out = f"replace({out}, {q(latin)}, {q(arabic)})"
    single = [s for s in fv.SINGLES if len(s[1]) == 1]
    out = f"translate({out}, {q(''.join(s for s, _ in single) + 'e')}, {q(''.join(d for _, d in single))})"
    share = f"length(regexp_replace(t, '[^{fv.ARABIC_BLOCK}]', '', 'g')) / greatest(length(t), 1)"
    return (
        f"array_to_string(list_transform({sql_words(col)}, lambda t: "
        f"CASE WHEN {share} > {fv.ARABIC_SHARE} THEN t ELSE {out} END), ' ')"
    )


per_document(
    "transliterate_latin",
    lambda: ["doc_id", text.transliterate("text").alias("arabic")],
    f"SELECT doc_id, {sql_transliterate('text')} AS arabic FROM documents",
)

SQL_KEYWORDS = (
    "list_filter(list_transform(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), "
    "lambda w: length(w) > 2), lambda w: lower(w)), lambda w: NOT list_contains(["
    + ", ".join(q(w) for w in fv.STOP_WORDS) + "], w))"
)
per_document(
    "retrieval_tokens",
    lambda: ["doc_id", F.size(text.keyword_tokens("text")).alias("n_tokens"),
     F.md5(F.array_join(text.keyword_tokens("text"), " ")).alias("tokens_md5")],
    f"SELECT doc_id, len({SQL_KEYWORDS.format('text')}) AS n_tokens, "
    f"md5(coalesce(array_to_string({SQL_KEYWORDS.format('text')}, ' '), '')) AS tokens_md5 FROM documents",
)

SQL_TOKENS = f"regexp_extract_all(text, '[{fv.ARABIC_BLOCK}]+|[a-zA-Z0-9]+')"


def sql_ngrams(tokens: str, n: int) -> str:
    shifted = ", ".join(f"{tokens}[{i + 1}:]" for i in range(1, n))
    if n == 1:
        return tokens
    joined = " || ' ' || ".join(f"p[{i + 1}]" for i in range(n))
    return f"list_transform(list_zip({tokens}, {shifted}, true), lambda p: {joined})"


def symptom_windows(spark, sf):
    df = read(spark, sf, "documents").select("doc_id", text.symptom_tokens("text").alias("tokens"))
    grams = [text.ngrams(F.col("tokens"), n) for n in (1, 2, 3)]
    return df.select(
        "doc_id",
        *[F.size(g).alias(f"n{n}") for n, g in zip((1, 2, 3), grams)],
        F.md5(F.array_join(F.concat(*grams), "|")).alias("windows_md5"),
    )


register(
    "symptom_windows", symptom_windows,
    f"WITH t AS (SELECT doc_id, {SQL_TOKENS} AS tokens FROM documents), "
    f"g AS (SELECT doc_id, {sql_ngrams('tokens', 1)} AS g1, {sql_ngrams('tokens', 2)} AS g2, "
    f"{sql_ngrams('tokens', 3)} AS g3 FROM t) "
    "SELECT doc_id, len(g1) AS n1, len(g2) AS n2, len(g3) AS n3, "
    "md5(coalesce(array_to_string(list_concat(list_concat(g1, g2), g3), '|'), '')) AS windows_md5 FROM g",
)

# --------------------------------------------------------------- projections


def symptoms():
    return F.element_at(F.array(F.lit("headache"), F.lit(""), F.lit("fever, cough")), (F.col("turn") % 3 + 1).cast("int"))




def prompts(spark, sf):
    known = F.when(symptoms() == "", F.col("text")).otherwise(symptoms())
    rendered = {
        "rerank": text.fill(copy.PROMPTS["rerank"], query=symptoms(), chunk=text.truncate("text", fv.RERANK_CHARS)),
        "triage": text.fill(copy.PROMPTS["triage"], symptoms_text=known, context=F.lit(copy.NO_CONTEXT),
                            output_script=copy.output_script_name(output_script())),
        "response": text.fill(copy.PROMPTS["response"], symptoms_text=known, triage_level=F.lit("GREEN"),
                              conditions=F.lit("unspecified"), actions=F.lit("follow up with doctor")),
        "clarification": text.fill(copy.PROMPTS["clarification"], query=F.col("text"), symptoms_text=F.lit("nothing specific")),
        "quality": text.fill(copy.PROMPTS["quality"], input_text=F.col("text"), expected_level=F.lit("RED"),
                             actual_level=F.lit("unknown"), response_text=text.truncate("text", fv.JUDGED_CHARS)),
    }
    return messages(spark, sf).select("conv_id", "turn", *[F.sha2(v, 256).alias(k) for k, v in rendered.items()])


def sql_fill(name, **slots):
    out = q(copy.PROMPTS[name])
    for slot, expr in slots.items():
        out = f"replace({out}, {q('{' + slot + '}')}, {expr})"
    return f"sha256({out}) AS {name}"


SQL_SYM = "CASE turn % 3 WHEN 0 THEN 'headache' WHEN 1 THEN '' ELSE 'fever, cough' END"
SQL_SYM_TEXT = f"CASE WHEN {SQL_SYM} = '' THEN text ELSE {SQL_SYM} END"
SQL_SCRIPT_NAME = (
    f"CASE {SQL_OUTPUT_SCRIPT} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in copy.OUTPUT_SCRIPTS) + " END"
)
register(
    "prompt_rendering", prompts,
    f"WITH {MESSAGES} SELECT conv_id, turn, "
    + ", ".join([
        sql_fill("rerank", query=SQL_SYM, chunk=f"substr(text, 1, {fv.RERANK_CHARS})"),
        sql_fill("triage", symptoms_text=SQL_SYM_TEXT, context=q(copy.NO_CONTEXT), output_script=SQL_SCRIPT_NAME),
        sql_fill("response", symptoms_text=SQL_SYM_TEXT, triage_level="'GREEN'", conditions="'unspecified'",
                 actions="'follow up with doctor'"),
        sql_fill("clarification", query="text", symptoms_text="'nothing specific'"),
        sql_fill("quality", input_text="text", expected_level="'RED'", actual_level="'unknown'",
                 response_text=f"substr(text, 1, {fv.JUDGED_CHARS})"),
    ]) + " FROM messages",
)
per_document(
    "prefix_truncation",
    lambda: ["doc_id", text.truncate("text", fv.TITLE_CHARS).alias("title"),
     F.md5(text.truncate("text", fv.CONTEXT_CHARS)).alias("context_md5"),
     F.md5(text.truncate("text", fv.RERANK_CHARS)).alias("rerank_md5"),
     text.ellipsis("text").alias("shown")],
    f"SELECT doc_id, substr(text, 1, {fv.TITLE_CHARS}) AS title, md5(substr(text, 1, {fv.CONTEXT_CHARS})) AS context_md5, "
    f"md5(substr(text, 1, {fv.RERANK_CHARS})) AS rerank_md5, "
    f"CASE WHEN length(text) > {fv.ERROR_CHARS} THEN substr(text, 1, {fv.ERROR_CHARS}) || '...' ELSE text END AS shown FROM documents",
)

KINDS = ["GREEN", "YELLOW", "RED", "CLARIFY"]


def kind():
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))


SQL_KIND = "CASE (conv_id + turn) % 4 " + " ".join(f"WHEN {i} THEN {q(k)}" for i, k in enumerate(KINDS)) + " END"


def some_script():
    return F.element_at(F.array(*[F.lit(s) for s in [*copy.SCRIPTS, "klingon"]]), (F.col("conv_id") % 4 + 1).cast("int"))


SQL_SOME_SCRIPT = "CASE conv_id % 4 WHEN 0 THEN 'arabic' WHEN 1 THEN 'franco' WHEN 2 THEN 'english' ELSE 'klingon' END"


def fallback_copy(spark, sf):
    return messages(spark, sf).select(
        "conv_id", "turn", copy.fallback(some_script(), kind()).alias("reply"),
        F.array_join(copy.fallback_actions(some_script(), kind()), "; ").alias("actions"),
        copy.result_notice(some_script(), kind() == "RED").alias("notice"),
    )


register(
    "fallback_copy", fallback_copy,
    f"WITH {MESSAGES}, {values('fb', ['script', 'kind', 'reply'], copy.FALLBACKS)}, "
    f"{values('act', ['script', 'kind', 'actions'], copy.ACTIONS)}, "
    f"{values('nt', ['script', 'severity', 'notice'], copy.RESULT_NOTICES)}, "
    f"k AS (SELECT conv_id, turn, {SQL_KIND} AS kind, CASE WHEN {SQL_SOME_SCRIPT} = 'klingon' THEN 'arabic' "
    f"ELSE {SQL_SOME_SCRIPT} END AS script FROM messages) "
    "SELECT conv_id, turn, fb.reply, act.actions, nt.notice FROM k JOIN fb USING (script, kind) "
    "JOIN act ON act.script = k.script AND act.kind = CASE WHEN k.kind = 'RED' THEN 'RED' ELSE 'YELLOW' END "
    "JOIN nt ON nt.script = k.script AND nt.severity = CASE WHEN k.kind = 'RED' THEN 'emergency' ELSE 'routine' END",
)



def level():
    return F.element_at(F.array(*[F.lit(k) for k in fv.LEVELS]), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))


SQL_LEVEL = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END"


def no_strings():
    return F.array().cast("array<string>")




def conditions():
    return F.when(F.col("turn") % 4 < 2, F.array(F.lit("flu"), F.col("role"))).otherwise(no_strings())




def action_list():
    return F.when(F.col("conv_id") % 3 > 0, F.array(F.lit("rest"), F.lit("drink"))).otherwise(no_strings())


SQL_PARTS = (
    "CASE WHEN turn % 4 < 2 THEN (SELECT text FROM fb WHERE kind = 'CONDITIONS' AND fb.script = k.script) || 'flu' || "
    "CASE WHEN k.script = 'arabic' THEN '، ' ELSE ', ' END || role END",
    "CASE WHEN conv_id % 3 > 0 THEN (SELECT text FROM fb WHERE kind = 'ACTIONS' AND fb.script = k.script) || 'rest; drink' END",
)
register(
    "reply_from_classification",
    lambda spark, sf: messages(spark, sf).select(
        "conv_id", "turn", rep.reply_from_classification(output_script(), level(), conditions(), action_list()).alias("reply")),
    f"WITH {MESSAGES}, {values('fb', ['script', 'kind', 'text'], copy.FALLBACKS)}, "
    f"k AS (SELECT conv_id, turn, role, {SQL_LEVEL} AS level, {SQL_OUTPUT_SCRIPT} AS script FROM messages) "
    f"SELECT conv_id, turn, CASE WHEN level = 'RED' OR (turn % 4 >= 2 AND conv_id % 3 = 0) "
    "THEN (SELECT text FROM fb WHERE fb.kind = k.level AND fb.script = k.script) "
    f"ELSE concat_ws('.' || chr(10), {SQL_PARTS[0]}, {SQL_PARTS[1]}) || '.' END AS reply FROM k",
)
register(
    "output_rounding",
    lambda spark, sf: read(spark, sf, "events").select(
        "event_id", text.rounded(F.col("value") / 7, 4).alias("score"),
        text.rounded(F.col("value") * 1.371313, 1).alias("latency_ms"), text.rounded(F.col("value") / 3, 2).alias("quality")),
    "SELECT event_id, CAST(printf('%.4f', CAST(value / 7 AS DOUBLE)) AS DOUBLE) AS score, CAST(printf('%.1f', CAST(value * 1.371313 AS DOUBLE)) AS DOUBLE) AS latency_ms, "
    "CAST(printf('%.2f', CAST(value / 3 AS DOUBLE)) AS DOUBLE) AS quality FROM events",
)

# --------------------------------------------------------------- input rules
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
D2 = f"({sql_doubled('text')})"
per_message("literal_set_predicate", "hit", lambda: has_literal(F.col("text"), fv.EMERGENCY_LITERALS), sql_literals("text", fv.EMERGENCY_LITERALS))
SQL_RULES = {
    "suicidal": sql_literals(D2, fv.SUICIDAL_LITERALS),
    "overdose": sql_any(D2, fv.OVERDOSE_PATTERNS),
    "infant": "(" + sql_literals(D2, fv.INFANT_LITERALS) + " OR " + sql_any(D2, fv.INFANT_AGE_PATTERNS)
    + " OR len(list_filter(list_concat("
    + ", ".join(
        f"regexp_extract_all(translate({D2}, {q(fv.ARABIC_DIGITS + PERSIAN_DIGITS)}, {q(fv.ASCII_DIGITS * 2)}), {q('(?i)' + re2(p))}, 1)"
        for p in fv.AGE_IN_MONTHS_PATTERNS)
    + f"), lambda m: coalesce(m, '') = '' OR try_cast(m AS INTEGER) < {fv.INFANT_MONTHS})) > 0)",
    "pregnancy": sql_any(D2, fv.PREGNANCY_PATTERNS),
    "lab": sql_literals(D2, fv.LAB_LITERALS),
    "medication": sql_any(D2, fv.MEDICATION_REQUEST_PATTERNS),
}
SQL_COMPOUND = "CASE " + " ".join(
    f"WHEN {sql_literals(D2, a)} AND ({sql_literals(D2, b)}"
    + (f" OR {sql_any(D2, fv.JAW_PATTERN)}" if name == fv.JAW_FLAG else "")
    + f") THEN {q(name)}"
    for name, a, b in fv.COMPOUND_FLAGS
) + " END"
SQL_RULES["compound"] = f"({SQL_COMPOUND}) IS NOT NULL"
for rule_name, label in [
    ("suicidal", "suicidal_predicate"), ("overdose", "overdose_predicate"), ("infant", "infant_predicate"),
    ("pregnancy", "pregnancy_predicate"), ("lab", "lab_result_predicate"), ("medication", "medication_request_predicate"),
]:
    predicate = dict((r[0], r[3]) for r in guardrails.CASCADE)[rule_name]
    per_message(label, "hit", lambda p=predicate: p(text.with_folded("text")), SQL_RULES[rule_name])
per_message("compound_red_flags", "flag", lambda: guardrails.compound_flag(text.with_folded("text")), SQL_COMPOUND)

SQL_VERDICT = (
    "checked AS (SELECT *, CASE " + " ".join(f"WHEN {SQL_RULES[r[0]]} THEN {q(r[0])}" for r in guardrails.CASCADE)
    + " END AS rule FROM messages), verdict AS (SELECT c.*, c.rule IS NULL AS is_safe, r.violation_type, "
    "coalesce(r.force_red, FALSE) AS force_red, coalesce(r.force_red OR r.violation_type IN "
    "('emergency_red_flag', 'suicidal_ideation'), FALSE) AS is_emergency FROM checked c LEFT JOIN cascade r ON c.rule = r.rule)"
)
CASCADE_TABLE = values("cascade", ["rule", "violation_type", "force_red"], [r[:3] for r in guardrails.CASCADE])
VERDICT = f"{MESSAGES}, {CASCADE_TABLE}, {SQL_VERDICT}"
register(
    "guardrail_cascade",
    lambda spark, sf: guardrails.check_messages(messages(spark, sf)).select(
        "conv_id", "turn", "rule", "is_safe", "violation_type", "force_red"),
    f"WITH {VERDICT} SELECT conv_id, turn, rule, is_safe, violation_type, force_red FROM verdict",
)
register(
    "emergency_violation_flag",
    lambda spark, sf: guardrails.check_messages(messages(spark, sf)).select("conv_id", "turn", "is_emergency"),
    f"WITH {VERDICT} SELECT conv_id, turn, is_emergency FROM verdict",
)


def sql_notice(text_expr, script, emergency_expr, table="notices"):
    n = f"(SELECT notice FROM {table} n WHERE n.script = {script} AND n.severity = CASE WHEN {emergency_expr} THEN 'emergency' ELSE 'routine' END)"
    return f"CASE WHEN contains({text_expr}, {n}) THEN {text_expr} ELSE {text_expr} || chr(10) || chr(10) || {n} END"


NOTICES = values("notices", ["script", "severity", "notice"], copy.NOTICES)
REFUSALS = values("refusals", ["violation_type", "script", "message"], copy.REFUSALS)
SQL_REJECTION = (
    f"rejected AS (SELECT v.*, {SQL_OUTPUT_SCRIPT} AS script FROM verdict v WHERE NOT is_safe), "
    "rejection AS (SELECT j.*, m.message FROM rejected j LEFT JOIN refusals m USING (violation_type, script))"
)
register(
    "rejection_rendering",
    lambda spark, sf: guardrails.check_messages(messages(spark, sf)).filter(~F.col("is_safe")).select(
        "conv_id", "turn", "violation_type",
        guardrails.refusal_text(F.col("violation_type"), F.col("is_emergency"), output_script()).alias("message")),
    f"WITH {VERDICT}, {NOTICES}, {REFUSALS}, {SQL_REJECTION} SELECT conv_id, turn, violation_type, "
    f"CASE WHEN violation_type = 'suicidal_ideation' THEN message ELSE {sql_notice('message', 'rejection.script', 'is_emergency')} END AS message FROM rejection",
)

# ----------------------------------------------------------------- emergency
FOLDED = sql_fold("text")
SQL_KEYWORD_EMERGENCY = "(" + " OR ".join(
    f"{sql_literals(t, fv.EMERGENCY_LITERALS)} OR {sql_any(t, fv.RED_FLAG_PATTERNS)}" for t in ("text", FOLDED)) + ")"
SQL_READINGS = (
    f"list_transform(regexp_extract_all(text, {q('(?i)' + re2(fv.GLUCOSE_PATTERN)[:-2] + '(?:$|[^\\p{L}\\p{N}_])')}, 1), "
    f"lambda m: CAST(translate(m, {q(fv.ARABIC_DIGITS + PERSIAN_DIGITS)}, {q(fv.ASCII_DIGITS * 2)}) AS INTEGER))"
)
SQL_GLUCOSE = f"len(list_filter({SQL_READINGS}, lambda v: v >= {fv.GLUCOSE_HIGH} OR v <= {fv.GLUCOSE_LOW})) > 0"
SQL_EMERGENCY = f"({SQL_KEYWORD_EMERGENCY} OR {SQL_GLUCOSE})"
per_message("keyword_emergency", "emergency", lambda: emergency.keyword_emergency(F.col("text")), SQL_KEYWORD_EMERGENCY)
register(
    "glucose_extremes",
    lambda spark, sf: messages(spark, sf).select(
        "conv_id", "turn", F.array_join(emergency.glucose_readings(F.col("text")).cast("array<string>"), ",").alias("readings"),
        emergency.extreme_glucose(F.col("text")).alias("emergency")),
    f"WITH {MESSAGES} SELECT conv_id, turn, coalesce(array_to_string({SQL_READINGS}, ','), '') AS readings, {SQL_GLUCOSE} AS emergency FROM messages",
)
register(
    "refusal_predicate",
    lambda spark, sf: messages(spark, sf).select(
        "conv_id", "turn", guardrails.is_refusal(F.col("text")).alias("refused"),
        F.when(guardrails.is_refusal(F.col("text")), copy.REFUSAL_TEXT).alias("reply")),
    f"WITH {MESSAGES} SELECT conv_id, turn, {sql_literals('text', fv.REFUSAL_LITERALS)} AS refused, "
    f"CASE WHEN {sql_literals('text', fv.REFUSAL_LITERALS)} THEN {q(copy.REFUSAL_TEXT)} END AS reply FROM messages",
)

# -------------------------------------------------------------- output rules
per_reply(
    "disclaimer_append", "reply",
    lambda: guardrails.ensure_notice(
        guardrails.ensure_notice(F.col("text"), F.col("turn") % 2 == 0, F.when(F.col("conv_id") % 2 == 0, "arabic").otherwise("franco")),
        F.col("turn") % 2 == 0, F.lit("arabic")),
    "(" + sql_notice("first", "'arabic'", "turn % 2 = 0") + ")",
)
SQL["disclaimer_append"] = (
    f"WITH {REPLIES}, {NOTICES}, once AS (SELECT conv_id, turn, "
    f"{sql_notice('text', SQL_RESPONSE, 'turn % 2 = 0')} AS reply FROM replies) "
    f"SELECT conv_id, turn, {sql_notice('reply', chr(39) + 'arabic' + chr(39), 'turn % 2 = 0')} AS reply FROM once"
)
SQL_DIAGNOSIS = sql_any("text", fv.DIAGNOSIS_PATTERNS)
# the Arabic alternatives start a word, which an ASCII boundary cannot see
TAKE_RE2 = re2(fv.TAKE_DRUG_PATTERN).replace(r"\b(?:take", r"(?:^|[^\p{L}\p{N}_])(?:take", 1)
HEDGE_RE2 = r"(?:^|[^\p{L}\p{N}_])" + re2(fv.HEDGING_PATTERN)[2:-2] + r"(?:$|[^\p{L}\p{N}_])"
register(
    "response_check",
    lambda spark, sf: replies(spark, sf).select(
        "conv_id", "turn", rep.response_violation(F.col("text")).alias("violation_type"), rep.has_diagnosis(F.col("text")).alias("add_uncertainty")),
    f"WITH {REPLIES} SELECT conv_id, turn, CASE WHEN {SQL_DIAGNOSIS} THEN 'diagnosis_language' "
    f"WHEN {sql_any('text', [fv.DOSAGE_PATTERN, fv.DRUG_PATTERN, TAKE_RE2])} THEN 'medication_reference' END AS violation_type, "
    f"{SQL_DIAGNOSIS} AS add_uncertainty FROM replies",
)


def sql_redact(col: str) -> str:
    for pattern, replacement in fv.REDACTIONS:
        if pattern == fv.TAKE_DRUG_PATTERN:
            pattern = re2(pattern).replace(r"\b(?:take", r"(^|[^\p{L}\p{N}_])(?:take", 1)
            replacement = "\\1" + replacement
        col = f"regexp_replace({col}, {q('(?i)' + re2(pattern))}, {q(replacement)}, 'g')"
    return col


per_reply("response_redaction", "reply", lambda: rep.redact(F.col("text")), sql_redact("text"))
SQL_NEEDS_HEDGE = f"({SQL_DIAGNOSIS} AND NOT regexp_matches(text, {q('(?i)' + HEDGE_RE2)}))"
register(
    "uncertainty_notice",
    lambda spark, sf: replies(spark, sf).select(
        "conv_id", "turn", rep.needs_hedge(F.col("text")).alias("needs_hedge"), rep.with_hedge(F.col("text")).alias("reply")),
    f"WITH {REPLIES} SELECT conv_id, turn, {SQL_NEEDS_HEDGE} AS needs_hedge, CASE WHEN {SQL_NEEDS_HEDGE} "
    f"THEN {q(copy.HEDGE_NOTICE)} || chr(10) || chr(10) || text ELSE text END AS reply FROM replies",
)

# ------------------------------------------------------------------- parsing


def score_text():
    return F.element_at(
    F.array(F.concat(F.col("value") / 100, F.lit(" ok")), F.concat(F.lit("-"), F.col("value")), F.lit("none"),
            F.concat(F.col("value"), F.lit("f")), F.lit(" ")), (F.col("event_id") % 5 + 1).cast("int"))


register(
    "score_parse",
    lambda spark, sf: read(spark, sf, "events").select("event_id", parsing.parse_score(score_text()).alias("score")),
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN least(greatest(value / 100, 0), 1) WHEN 1 THEN "
    "CASE WHEN value >= 0 THEN 0.0 ELSE least(-value, 1.0) END ELSE -1.0 END AS score FROM events",
)


def rating_text():
    return F.element_at(
    F.array(F.concat(F.lit(" "), F.floor(F.col("value")), F.lit("/5")), F.lit("great"), F.lit("0"), F.lit("")),
    (F.col("event_id") % 4 + 1).cast("int"))


register(
    "rating_parse",
    lambda spark, sf: read(spark, sf, "events").select("event_id", parsing.parse_rating(rating_text()).alias("rating")),
    "WITH d AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN try_cast(substr(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR), 1, 1) AS DOUBLE) END AS r FROM events) "
    "SELECT event_id, CASE WHEN r BETWEEN 1 AND 5 THEN r END AS rating FROM d",
)


def well_formed():
    return F.to_json(F.struct(
    level().alias("triage_level"),
    text.words("text").alias("possible_conditions"),
    F.array(F.lit("rest")).alias("recommended_actions")))




def json_text():
    return F.element_at(
    F.array(well_formed(), F.concat(F.lit("```json\n"), well_formed(), F.lit("\n```")),
            F.concat(F.lit("Sure: "), well_formed().substr(F.lit(1), F.length(well_formed()) - 1), F.lit(",")),
            F.concat(well_formed(), F.lit(" hope this helps")), F.lit("no object")),
    ((F.col("conv_id") + 2 * F.col("turn")) % 5 + 1).cast("int"))




def structured_output(spark, sf):
    parsed = messages(spark, sf).select("conv_id", "turn", parsing.parse_verdict(json_text()).alias("v"))
    return parsed.select(
        "conv_id", "turn", "v.level", F.array_join("v.conditions", "|").alias("conditions"),
        F.array_join("v.actions", "|").alias("actions"))


SQL_READABLE = "(conv_id + 2 * turn) % 5 < 3"
register(
    "structured_output_parse", structured_output,
    f"WITH {MESSAGES} SELECT conv_id, turn, CASE WHEN {SQL_READABLE} THEN {SQL_LEVEL} ELSE 'YELLOW' END AS level, "
    f"CASE WHEN {SQL_READABLE} THEN coalesce(array_to_string({sql_words('text')}[1:5], '|'), '') ELSE '' END AS conditions, "
    f"CASE WHEN {SQL_READABLE} THEN 'rest' ELSE '' END AS actions FROM messages",
)
register(
    "list_caps",
    lambda spark, sf: messages(spark, sf).select(
        "conv_id", "turn", F.array_join(parsing.cap_list(text.words("text")), " ").alias("capped")),
    f"WITH {MESSAGES} SELECT conv_id, turn, coalesce(array_to_string({sql_words('text')}[1:{fv.LIST_CAP}], ' '), '') AS capped FROM messages",
)
register(
    "ordered_distinct_queries",
    lambda spark, sf: messages(spark, sf).select(
        "conv_id", "turn",
        F.array_join(text.ordered_distinct(text.strip("text"), text.strip(symptoms()), text.strip("text")), "|").alias("queries"),
        F.array_join(F.array_distinct(text.keyword_tokens("text")), " ").alias("terms")),
    f"WITH {MESSAGES}, k AS (SELECT conv_id, turn, text, {SQL_SYM} AS sym, {SQL_KEYWORDS.format('text')} AS terms FROM messages) "
    f"SELECT conv_id, turn, concat_ws('|', {sql_strip('text')}, nullif(sym, '')) AS queries, "
    "coalesce(array_to_string(list_transform(list_filter(range(1, len(terms) + 1), lambda i: list_position(terms, terms[i]) = i), lambda i: terms[i]), ' '), '') AS terms FROM k",
)
