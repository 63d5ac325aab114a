"""Queries and SQL twins for conversations, triage, events and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    CORPUS, MESSAGES, REPLIES, USER_PHRASES, corpus, lexicon, messages, q, read, replies, sql_literals, sql_script, sql_strip, sql_words, values,
)
from checks.lexicon_rules import EXTRACT_CTES, SYMPTOM_LISTS
from checks.text_rules import (
    CASCADE_TABLE, NOTICES, REFUSALS, SQL_EMERGENCY, SQL_VERDICT, sql_notice, sql_redact,
)
from symptia.functions import fixed_values as fv
from symptia.functions import messages as copy
from symptia.functions import parsing, text
from symptia.operators import admission, chunking, conversation, evaluation, events, guardrails, hooks, ordering
from symptia.plans import evaluate, triage
from symptia.session import shared_dir
from symptia.sources import corpus as src

QUERIES, SQL = {}, {}
ID = ["conv_id", "turn"]
R = 6

# ------------------------------------------------------------- conversations
QUERIES["history_frames"] = lambda spark, sf: conversation.history_frames(read(spark, sf, "conversations")).select(*ID, "context_text")
FRAMES = (
    "frames AS (SELECT conv_id, turn, text, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context_text FROM {0} WHERE role = 'user')"
)
SQL["history_frames"] = f"WITH {FRAMES.format('conversations')} SELECT conv_id, turn, context_text FROM frames"


def _dated(spark, sf):
    """Turns with the time of the event of the same number."""
    starts = read(spark, sf, "events").select(F.col("event_id").alias("conv_id"), "ts")
    return read(spark, sf, "conversations").join(starts, "conv_id", "left")


QUERIES["conversation_list"] = lambda spark, sf: conversation.conversation_list(_dated(spark, sf), "ts").select(
    "conv_id", "title", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "created").alias("created"), "n_messages")
SQL["conversation_list"] = (
    "SELECT conv_id, substr(arg_min(text, turn), 1, 50) AS title, epoch_us(min(ts)) AS created, count(*) AS n_messages "
    "FROM conversations LEFT JOIN events ON event_id = conv_id GROUP BY conv_id"
)


def usable(spark, sf):
    turns = read(spark, sf, "conversations").withColumns({
        "is_streaming": F.col("turn") % 7 == 5, "is_error": F.length("text") % 10 == 0,
        "text": F.when(F.length("text") % 11 == 0, " \n").otherwise(F.col("text"))})
    return conversation.usable_history(turns, 3).select(*ID, "role")


QUERIES["usable_history"] = usable
SQL["usable_history"] = (
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations "
    "WHERE turn % 7 <> 5 AND length(text) % 10 <> 0 AND length(text) % 11 <> 0 AND trim(text) <> '') WHERE r <= 3"
)
QUERIES["conversation_delete"] = lambda spark, sf: conversation.delete_conversations(
    read(spark, sf, "conversations"), read(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("conv_id"))).select(*ID)
SQL["conversation_delete"] = "SELECT conv_id, turn FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"
QUERIES["vague_input"] = lambda spark, sf: read(spark, sf, "conversations").select(
    *ID, conversation.is_vague(F.when(F.length("text") % 2 == 0, F.array()).otherwise(F.array(F.lit("x"))),
                               F.col("text")).alias("vague"))
SQL["vague_input"] = f"SELECT conv_id, turn, length(text) % 2 = 0 AND len({sql_words(chr(39) * 0 + 'p')}) < 2 AS vague FROM (SELECT *, text AS p FROM conversations)"


def requests(spark, sf):
    """Documents as requests; the history is all their words."""
    docs = read(spark, sf, "documents")
    history = F.transform(text.words("text"), lambda w, i: F.struct(
        F.when(i % 9 == 8, "system").when(i % 2 == 0, "user").otherwise("assistant").alias("role"), w.alias("content")))
    problem = conversation.request_problem(
        F.when(F.col("n_chars") % 13 == 0, "").otherwise(F.col("text")), history,
        F.when(F.col("lang") == "es", "spanish").otherwise("auto"), F.when(F.col("lang") == "de", "latin").otherwise("franco"))
    valid, rejected = conversation.split_requests(docs, problem)
    return valid.select("doc_id", F.lit("ok").alias("reason")).unionByName(rejected.select("doc_id", "reason"))


QUERIES["request_validity"] = requests
SQL["request_validity"] = (
    f"WITH w AS (SELECT *, len({sql_words('text')}) AS h FROM documents) SELECT doc_id, "
    "CASE WHEN n_chars % 13 = 0 OR length(text) = 0 THEN 'message is empty' WHEN length(text) > 2000 THEN 'message is too long' WHEN h > 20 THEN 'history is too long' "
    "WHEN h > 8 THEN 'history role is unknown' WHEN lang = 'es' THEN 'language preference is unknown' WHEN lang = 'de' THEN 'response script is unknown' ELSE 'ok' END AS reason FROM w"
)

# -------------------------------------------------------------------- triage


def script():
    return text.detect_script(F.col("text"))


def rules(spark, sf):
    return triage.triage_rules(messages(spark, sf), lexicon(spark), ID, script())


TRIAGE_OUT = ["step", "rule", "level", "reply", "notice", "needs_clarification"]
QUERIES["triage_rules"] = lambda spark, sf: rules(spark, sf).select(*ID, *TRIAGE_OUT, F.array_join("actions", "; ").alias("actions"))
FB = values("fb", ["script", "kind", "copy"], copy.FALLBACKS)
ACT = values("act", ["script", "kind", "actions"], copy.ACTIONS)
RN = values("rn", ["script", "severity", "notice"], copy.RESULT_NOTICES)


def sql_of(table, col, script, kind, key="kind"):
    return f"(SELECT t.{col} FROM {table} t WHERE t.script = {script} AND t.{key} = {kind})"


SQL_STEP = (
    f"CASE WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'invalid' WHEN NOT is_safe THEN 'blocked' WHEN {sql_literals('text', fv.REFUSAL_LITERALS)} THEN 'refusal' "
    f"WHEN {SQL_EMERGENCY} THEN 'emergency' END"
)
DECIDE = (
    f"{EXTRACT_CTES}, {SYMPTOM_LISTS}, {CASCADE_TABLE}, {SQL_VERDICT}, {NOTICES}, {REFUSALS}, {FB}, {ACT}, {RN}, "
    f"early AS (SELECT v.*, {sql_script('v.text')} AS script, s.n_symptoms, s.critical, {SQL_STEP.replace('text', 'v.text')} AS step0 FROM verdict v JOIN sym s USING (conv_id, turn)), "
    f"decided AS (SELECT *, coalesce(step0, CASE WHEN n_symptoms = 0 AND len({sql_words('text')}) < 2 THEN 'vague' ELSE 'open' END) AS step FROM early)"
)
REFUSED = (
    "refused AS (SELECT d.conv_id, d.turn, CASE WHEN d.violation_type = 'suicidal_ideation' THEN m.message ELSE "
    + sql_notice("m.message", "d.script", "d.is_emergency") + " END AS refusal FROM decided d JOIN refusals m ON m.violation_type = d.violation_type AND m.script = d.script WHERE step = 'blocked')"
)
RULED = (
    f"{DECIDE}, {REFUSED}, leveled AS (SELECT *, CASE step WHEN 'refusal' THEN 'YELLOW' WHEN 'emergency' THEN 'RED' WHEN 'vague' THEN 'GREEN' WHEN 'open' THEN CASE WHEN critical THEN 'RED' ELSE 'YELLOW' END END AS level FROM decided), "
    "ruled AS (SELECT l.conv_id, l.turn, l.script, l.step, l.rule, l.violation_type, l.force_red, l.is_emergency, l.level, CASE WHEN step = 'invalid' THEN NULL WHEN step = 'blocked' THEN r.refusal WHEN step = 'refusal' THEN "
    + q(copy.REFUSAL_TEXT) + " ELSE " + sql_of("fb", "copy", "l.script", "CASE WHEN l.step = 'vague' THEN 'CLARIFY' WHEN l.level = 'RED' THEN 'RED' ELSE 'YELLOW' END")
    + " END AS reply, CASE WHEN step NOT IN ('invalid', 'blocked') THEN " + sql_of("rn", "notice", "l.script", "CASE WHEN l.level = 'RED' THEN 'emergency' ELSE 'routine' END", "severity")
    + " END AS notice, step = 'vague' AS needs_clarification, CASE WHEN step = 'refusal' THEN " + q(copy.REFUSAL_ACTION)
    + " WHEN step IN ('emergency', 'open') THEN " + sql_of("act", "actions", "l.script", "l.level") + " ELSE '' END AS actions "
    "FROM leveled l LEFT JOIN refused r USING (conv_id, turn))"
)
SQL["triage_rules"] = f"WITH {RULED} SELECT conv_id, turn, {', '.join(TRIAGE_OUT)}, actions FROM ruled"


def overview(spark, sf):
    checked = guardrails.check_messages(messages(spark, sf))
    from symptia.operators.emergency import is_emergency

    level = F.when(F.col("force_red") | is_emergency(F.col("text")), "RED").when(~F.col("is_safe"), "YELLOW").otherwise("OPEN")
    return checked.groupBy(F.coalesce("violation_type", F.lit("none")).alias("violation_type"), level.alias("level")).agg(F.count("*").alias("n"))


QUERIES["triage_overview"] = overview
SQL["triage_overview"] = (
    f"WITH {MESSAGES}, {CASCADE_TABLE}, {SQL_VERDICT} SELECT coalesce(violation_type, 'none') AS violation_type, "
    f"CASE WHEN force_red OR {SQL_EMERGENCY} THEN 'RED' WHEN NOT is_safe THEN 'YELLOW' ELSE 'OPEN' END AS level, count(*) AS n FROM verdict GROUP BY 1, 2"
)


def model_outputs(spark, sf):
    """Stand-in model texts: some missing, some cut off, some with doses."""
    n = F.col("conv_id") + F.col("turn")
    level = F.element_at(F.array(*[F.lit(x) for x in fv.LEVELS]), (n % 3 + 1).cast("int"))
    verdict = F.concat(F.lit('{"triage_level": "'), level, F.lit('", "possible_conditions": ["cold", "flu"], "recommended_actions": ["rest"]'))
    return messages(spark, sf).select(
        *ID, F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, verdict).otherwise(F.concat(verdict, F.lit("}"))).alias("verdict_text"),
        F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, " You have flu, take 20 mg of aspirin. ").otherwise("Rest a little.").alias("reply_text"))


QUERIES["triage_with_model"] = lambda spark, sf: triage.triage_with_model(
    messages(spark, sf), model_outputs(spark, sf), lexicon(spark), ID, script()).select(
    *ID, "step", "level", "reply", "notice", "used_fallback", F.array_join("conditions", "|").alias("conditions"), F.array_join("actions", "; ").alias("actions"))
SQL["triage_with_model"] = (
    f"WITH {DECIDE}, {REFUSED}, mo AS (SELECT *, (conv_id + turn) % 5 = 0 AS no_verdict, CASE (conv_id + turn) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'You have flu, take 20 mg of aspirin.' ELSE 'Rest a little.' END AS written, "
    "CASE (conv_id + turn) % 3 WHEN 0 THEN 'GREEN' WHEN 1 THEN 'YELLOW' ELSE 'RED' END AS mlevel FROM decided), "
    "lv AS (SELECT *, step = 'open' AND no_verdict AS used_fallback, CASE step WHEN 'refusal' THEN 'YELLOW' WHEN 'emergency' THEN 'RED' WHEN 'vague' THEN 'GREEN' WHEN 'open' THEN CASE WHEN no_verdict THEN CASE WHEN critical THEN 'RED' ELSE 'YELLOW' END ELSE mlevel END END AS level FROM mo), "
    "rp AS (SELECT l.*, r.refusal, CASE WHEN step = 'refusal' THEN " + q(copy.REFUSAL_TEXT) + " WHEN used_fallback THEN " + sql_of("fb", "copy", "l.script", "l.level")
    + " WHEN step = 'vague' THEN coalesce(written, " + sql_of("fb", "copy", "l.script", "'CLARIFY'") + ") WHEN step = 'emergency' OR (step = 'open' AND level = 'RED') THEN coalesce(written, " + sql_of("fb", "copy", "l.script", "'RED'")
    + ") WHEN step = 'open' THEN coalesce(written, " + sql_of("fb", "copy", "l.script", "'CONDITIONS'") + " || 'cold' || CASE WHEN l.script = 'arabic' THEN '، ' ELSE ', ' END || 'flu.' || chr(10) || " + sql_of("fb", "copy", "l.script", "'ACTIONS'") + " || 'rest.') END AS raw, "
    "CASE WHEN step NOT IN ('invalid', 'blocked') THEN " + sql_of("rn", "notice", "l.script", "CASE WHEN l.level = 'RED' THEN 'emergency' ELSE 'routine' END", "severity") + " END AS own FROM lv l LEFT JOIN refused r USING (conv_id, turn)), "
    f"sf AS (SELECT *, {sql_redact('raw')} AS safe FROM rp) "
    "SELECT conv_id, turn, step, level, CASE WHEN step = 'blocked' THEN refusal ELSE " + sql_notice("safe", "'english'", "level = 'RED'") + " END AS reply, "
    + sql_notice("own", "'english'", "level = 'RED'") + " AS notice, used_fallback, CASE WHEN step = 'emergency' OR (used_fallback AND level = 'RED') THEN 'emergency' WHEN step = 'open' AND NOT used_fallback THEN 'cold|flu' ELSE '' END AS conditions, "
    "CASE WHEN step = 'refusal' THEN " + q(copy.REFUSAL_ACTION) + " WHEN step = 'emergency' OR used_fallback THEN " + sql_of("act", "actions", "sf.script", "sf.level") + " WHEN step = 'open' THEN 'rest' ELSE '' END AS actions FROM sf"
)

# -------------------------------------------------------------------- events
EVENT_OUT = ["type", "content", "triage_level", "disclaimer", "follow_up_question", "reason", "message", "force_red"]
QUERIES["event_sequence"] = lambda spark, sf: triage.triage_events(rules(spark, sf), ID).select(*ID, "seq", *EVENT_OUT)
SQL_BY_WORD = f"array_to_string({sql_words('reply')}, ' ') || ' '"
EVENT_ROWS = (
    f"{RULED}, cut AS (SELECT *, CASE WHEN step IN ('refusal', 'vague') THEN list_filter(regexp_extract_all({SQL_BY_WORD}, '(?s)(?:[^.!?؟،]*[.!?؟،]+)|[^.!?؟،]+$'), lambda c: c <> '') "
    "ELSE list_filter([regexp_extract(reply, '(?s)^(.*[.!?؟،\\n])', 1), substr(reply, length(regexp_extract(reply, '(?s)^(.*[.!?؟،\\n])', 1)) + 1)], lambda c: c <> '') END AS chunks FROM ruled WHERE step <> 'invalid'), "
    "ev AS (SELECT conv_id, turn, 0 AS seq, 'start' AS type, NULL AS content, NULL AS triage_level, NULL AS disclaimer, NULL AS follow_up_question, NULL AS reason, NULL AS message, CAST(NULL AS BOOLEAN) AS force_red FROM cut "
    "UNION ALL SELECT conv_id, turn, 1, 'blocked', NULL, NULL, NULL, NULL, violation_type, reply, force_red FROM cut WHERE step = 'blocked' "
    "UNION ALL SELECT conv_id, turn, 1, 'triage_classified', NULL, level, NULL, NULL, NULL, NULL, NULL FROM cut WHERE step <> 'blocked' "
    f"UNION ALL SELECT conv_id, turn, 1 + i, 'chunk', {sql_redact('chunks[i]')}, NULL, NULL, NULL, NULL, NULL, NULL FROM (SELECT *, unnest(range(1, len(chunks) + 1)) AS i FROM cut WHERE step <> 'blocked') "
    "UNION ALL SELECT conv_id, turn, 2 + len(chunks), 'complete', NULL, level, notice, CASE WHEN needs_clarification THEN reply END, NULL, NULL, NULL FROM cut WHERE step <> 'blocked')"
)
SQL["event_sequence"] = f"WITH {EVENT_ROWS} SELECT conv_id, turn, seq, {', '.join(EVENT_OUT)} FROM ev"


def frames(spark, sf):
    e = triage.triage_events(rules(spark, sf), ID)
    return e.select(*ID, "seq", events.to_frame(F.struct("type", "content", "triage_level", "follow_up_question")).alias("frame"))


def sql_json(*cols):
    part = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE CAST(to_json({c}) AS VARCHAR) END"
    return "'{' || " + " || ',' || ".join(f"'\"{c}\":' || {part(c)}" for c in cols) + " || '}'"


QUERIES["event_frame_sink"] = frames
SQL["event_frame_sink"] = (
    f"WITH {EVENT_ROWS} SELECT conv_id, turn, seq, 'data: ' || {sql_json('type', 'content', 'triage_level', 'follow_up_question')} || chr(10) || chr(10) AS frame FROM ev"
)


def frame_logs(spark, sf):
    """One log per assistant turn: a frame per line of text, some of them
    malformed, with lines after the terminator that must not be read."""
    chunk = F.transform(F.split("text", "\n"), lambda l, i: F.when(
        i % 4 == 3, F.concat(F.lit("data: {broken "), i.cast("string"))).when(
        i % 4 == 2, F.concat(F.lit(": note "), i.cast("string"))).otherwise(
        F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("chunk").alias("type"), l.alias("content"))))))
    raw = F.concat(F.array_join(chunk, "\n\n"), F.lit('\n\ndata: [DONE]\n\ndata: {"type":"chunk","content":"late"}\n'))
    return replies(spark, sf).select(*ID, raw.alias("raw"))


QUERIES["event_frame_scan"] = lambda spark, sf: events.read_frames(frame_logs(spark, sf), ID).select(*ID, "line_no", "type", "content")
SQL["event_frame_scan"] = (
    f"WITH {REPLIES}, l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM replies) "
    "SELECT conv_id, turn, i * 2 AS line_no, 'chunk' AS type, content FROM l WHERE i % 4 < 2"
)


def word_chunks(spark, sf):
    """Assistant turns as a stream of words, each followed by a blank."""
    return replies(spark, sf).select(*ID, F.posexplode(text.words("text")).alias("seq", "w")).select(
        *ID, "seq", F.concat("w", F.lit(" ")).alias("content"))


QUERIES["sentence_segments"] = lambda spark, sf: events.segment_chunks(word_chunks(spark, sf), ID)
WORDS = (
    f"wl AS (SELECT conv_id, turn, {sql_words('text')} AS ws FROM replies), "
    "wc AS (SELECT conv_id, turn, unnest(range(0, len(ws))) AS seq, unnest(ws) || ' ' AS content FROM wl)"
)
TERM = "[.!?؟،\\n]"
SEGMENTS = (
    f"{WORDS}, wn AS (SELECT *, regexp_matches(content, '{TERM}') AS ends, count(*) FILTER (regexp_matches(content, '{TERM}')) OVER (PARTITION BY conv_id, turn ORDER BY seq) AS cuts, "
    f"regexp_extract(content, '(?s)^(.*{TERM})', 1) AS head FROM wc), "
    "pc AS (SELECT conv_id, turn, cuts AS segment, seq * 2 AS ord, content AS piece FROM wn WHERE NOT ends UNION ALL SELECT conv_id, turn, cuts - 1, seq * 2, head FROM wn WHERE ends "
    "UNION ALL SELECT conv_id, turn, cuts, seq * 2 + 1, substr(content, length(head) + 1) FROM wn WHERE ends), "
    "sg AS (SELECT conv_id, turn, segment, string_agg(piece, '' ORDER BY ord) AS content FROM pc GROUP BY 1, 2, 3)"
)
SQL["sentence_segments"] = f"WITH {REPLIES}, {SEGMENTS} SELECT conv_id, turn, segment, {sql_redact('content')} AS content FROM sg WHERE content <> ''"


def reply_events(spark, sf):
    """Word chunks between a classification and an end that completes, fails
    or blocks."""
    chunks = word_chunks(spark, sf)
    ids = replies(spark, sf).select(*ID, F.size(text.words("text")).alias("n"))
    k = (F.col("conv_id") + F.col("turn")) % 5
    none = F.lit(None).cast("string")
    first = ids.select(*ID, F.lit(-1).alias("seq"), F.lit("triage_classified").alias("type"), none.alias("content"),
                       F.when(k == 1, none).otherwise("GREEN").alias("triage_level"), none.alias("message"), F.lit(False).alias("force_red"))
    last = ids.select(*ID, F.col("n").alias("seq"), F.when(k == 2, "blocked").when(k == 3, "error").otherwise("complete").alias("type"),
                      none.alias("content"), F.when(k == 4, "RED").alias("triage_level"),
                      F.when(k == 2, "stopped").alias("message"), ((k == 2) & (F.col("turn") % 2 == 0)).alias("force_red"))
    middle = chunks.select(*ID, "seq", F.lit("chunk").alias("type"), "content", none.alias("triage_level"), none.alias("message"), F.lit(False).alias("force_red"))
    return first.unionByName(middle).unionByName(last)


QUERIES["event_fold"] = lambda spark, sf: events.fold_messages(reply_events(spark, sf), ID)
SQL["event_fold"] = (
    f"WITH {REPLIES}, {WORDS}, k AS (SELECT conv_id, turn, (conv_id + turn) % 5 AS k, len(ws) AS n, array_to_string(list_transform(ws, lambda w: w || ' '), '') AS body FROM wl) "
    "SELECT conv_id, turn, CASE k WHEN 2 THEN 'stopped' WHEN 3 THEN 'An error occurred.' ELSE body END AS content, "
    "CASE WHEN k = 2 AND turn % 2 = 0 THEN 'RED' WHEN k = 4 THEN 'RED' WHEN k IN (0, 1) THEN 'YELLOW' ELSE 'GREEN' END AS triage_level, "
    "k = 2 AS is_blocked, k = 3 AS is_error, TRUE AS is_finished, n + 2 AS n_events FROM k"
)


def triage_log(spark, sf):
    """Triage events as frames, read back and folded into message states."""
    e = triage.triage_events(rules(spark, sf), ID)
    framed = e.select(*ID, "seq", events.to_frame(F.struct("type", "content", "triage_level", "message", "force_red")).alias("frame"))
    logs = events.concat_ordered(framed, ID, "seq", "frame", "raw")
    back = events.read_frames_in_row(logs, ID).withColumnRenamed("line_no", "seq")
    return events.fold_messages(back, ID).select(*ID, "content", "triage_level", "is_blocked", "n_events")


QUERIES["triage_event_log"] = triage_log
SQL["triage_event_log"] = (
    f"WITH {EVENT_ROWS} SELECT conv_id, turn, coalesce(max(message), '') || coalesce(string_agg(content, '' ORDER BY seq), '') AS content, "
    "coalesce(max(triage_level), CASE WHEN bool_or(force_red) THEN 'RED' END) AS triage_level, bool_or(type = 'blocked') AS is_blocked, count(*) AS n_events FROM ev GROUP BY 1, 2"
)


# ----------------------------------------------------------- calls and limits
def calls(spark, sf):
    e = read(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("call_id"), F.col("user_id").alias("trace_id"), "ts",
        F.when(F.col("event_type") == "click", "classification").otherwise("response").alias("step"),
        F.when(F.col("event_id") % 2 == 0, "primary").otherwise("backup").alias("provider"),
        (F.col("event_type") == "view").alias("streamed"), F.when(F.col("event_id") % 3 > 0, F.repeat("event_type", 700)).otherwise("").alias("system_prompt"),
        F.concat(F.repeat(F.lit("p"), 2990), "event_type", "props").alias("prompt"),
        F.concat(F.repeat(F.lit("r"), 3990), "props", "props").alias("response"),
        (F.col("value") * 1.371313).alias("latency_ms"), F.floor("value").cast("bigint").alias("total_tokens"),
        F.when(F.col("event_id") % 4 == 0, 0.4).otherwise(0.1).alias("temperature"))


QUERIES["call_log_projection"] = lambda spark, sf: events.call_log(calls(spark, sf)).select(
    "call_id", "trace_id", "name", F.coalesce(F.length("system_prompt"), F.lit(-1)).alias("n_system"), F.sha2("prompt", 256).alias("prompt"), F.sha2("response", 256).alias("response"), "latency_ms")
SQL["call_log_projection"] = (
    "SELECT event_id AS call_id, user_id AS trace_id, CASE WHEN event_type = 'click' THEN 'classification' ELSE 'response' END || ':' || CASE WHEN event_id % 2 = 0 THEN 'primary' ELSE 'backup' END || "
    "CASE WHEN event_type = 'view' THEN '(stream)' ELSE '' END AS name, CASE WHEN event_type <> 'view' AND event_id % 3 > 0 THEN least(2000, 700 * length(event_type)) ELSE -1 END AS n_system, "
    "sha256(substr(repeat('p', 2990) || event_type || props, 1, 3000)) AS prompt, sha256(substr(repeat('r', 3990) || props || props, 1, 4000)) AS response, CAST(printf('%.1f', CAST(value * 1.371313 AS DOUBLE)) AS DOUBLE) AS latency_ms FROM events"
)
QUERIES["tokens_per_trace"] = lambda spark, sf: events.tokens_per_trace(calls(spark, sf))
SQL["tokens_per_trace"] = "SELECT user_id AS trace_id, CAST(sum(floor(value)) AS BIGINT) AS total_tokens, count(*) AS n_calls FROM events GROUP BY 1"


def status(spark, sf):
    names = ["conversations", "documents", "embeddings", "labels", "events"]
    tables = {n: read(spark, sf, n) for n in names}
    tables["lexicon matches"] = read(spark, sf, "documents").filter(F.contains("text", F.lit("dizzy spells")))
    parts = events.component_status(tables)
    whole = events.overall_status(parts).select(F.lit("overall").alias("component"), F.col("n_not_ok").alias("n_rows"), "status")
    return parts.unionByName(whole)


QUERIES["component_status"] = status
SQL["component_status"] = (
    "WITH c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS component, count(*) AS n_rows FROM {n}" for n in ["conversations", "documents", "embeddings", "labels", "events"])
    + " UNION ALL SELECT 'lexicon matches', count(*) FROM documents WHERE contains(text, 'dizzy spells')), s AS (SELECT *, CASE WHEN n_rows > 0 THEN 'ok' ELSE 'degraded' END AS status FROM c) "
    "SELECT * FROM s UNION ALL SELECT 'overall', count(*) FILTER (status <> 'ok'), CASE WHEN bool_or(status <> 'ok') THEN 'degraded' ELSE 'ok' END FROM s"
)


def admitted(spark, sf):
    return admission.admit(read(spark, sf, "events").select("event_id", "ts", "user_id"), "user_id", "ts", "event_id", 3, 86400).select(
        "event_id", "user_id", "admitted", "retry_after")


def sql_admit(source, key, limit, seconds):
    """The fold as a recursion over the rows of a key, holding admitted times."""
    return (
        f"numbered AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY t, event_id) AS rn FROM {source}), "
        f"fold AS (SELECT {key}, event_id, rn, t, TRUE AS admitted, 0::BIGINT AS retry_after, [t] AS w FROM numbered WHERE rn = 1 UNION ALL "
        f"SELECT n.{key}, n.event_id, n.rn, n.t, len(n.live) < {limit}, CASE WHEN len(n.live) < {limit} THEN 0 ELSE ({seconds * 1_000_000} - (n.t - n.live[1])) // 1000000 + 1 END, "
        f"CASE WHEN len(n.live) < {limit} THEN list_append(n.live, n.t) ELSE n.live END FROM (SELECT m.*, list_filter(f.w, lambda x: m.t - x <= {seconds * 1_000_000}) AS live FROM fold f JOIN numbered m ON m.{key} = f.{key} AND m.rn = f.rn + 1) n)"
    )


QUERIES["sliding_window_admission"] = admitted
SQL["sliding_window_admission"] = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events), " + sql_admit("e", "user_id", 3, 86400)
    + " SELECT event_id, user_id, admitted, retry_after FROM fold"
)


def suppressed(spark, sf):
    c = calls(spark, sf).withColumn("prompt_key", admission.prompt_key(
        F.lit("sys"), F.concat_ws(" ", "step", (F.col("trace_id") % 20).cast("string")), F.col("temperature"), F.lit(8)))
    out = admission.suppress_repeats(c.select("call_id", "ts", "prompt_key", "temperature"), "prompt_key", "ts", "call_id", "temperature", 7200)
    return out.select("call_id", "prompt_key", "cached")


QUERIES["repeat_prompt_suppression"] = suppressed
SQL["repeat_prompt_suppression"] = (
    "WITH RECURSIVE c AS (SELECT event_id, epoch_us(ts) AS t, event_id % 4 <> 0 AS cold, sha256('sys||' || CASE WHEN event_type = 'click' THEN 'classification' ELSE 'response' END || ' ' || (user_id % 20) || '||' || "
    "CASE WHEN event_id % 4 = 0 THEN '0.4' ELSE '0.1' END || '||8') AS prompt_key FROM events), cold AS (SELECT * FROM c WHERE cold), " + sql_admit("cold", "prompt_key", 1, 7200)
    + " SELECT event_id AS call_id, prompt_key, NOT admitted AS cached FROM fold UNION ALL SELECT event_id, prompt_key, FALSE FROM c WHERE NOT cold"
)


def failure_streak(spark, sf):
    e = read(spark, sf, "events").select("event_id", "user_id", "ts", "event_type").withColumn("_bucket", F.to_date("ts"))
    out = ordering.streaks(e, ["user_id"], "_bucket", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("event_id", "user_id", "streak", (F.col("streak") >= fv.GIVE_UP_AFTER).alias("given_up"))


QUERIES["failure_streaks"] = failure_streak
SQL["failure_streaks"] = (
    "WITH e AS (SELECT *, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events), "
    "s AS (SELECT event_id, user_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM e) "
    "SELECT event_id, user_id, streak, streak >= 3 AS given_up FROM s"
)

# ---------------------------------------------------------------- evaluation


def scenarios(spark, sf):
    """Labelled documents as scenarios, by language."""
    labels = read(spark, sf, "labels")
    docs = read(spark, sf, "documents").select("doc_id", "lang")
    level = F.when(F.col("toxic") == 1, "RED").when(F.col("quality") == 1, "GREEN").otherwise("YELLOW")
    return labels.join(docs, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("input_type"), level.alias("expected_level"),
        (level == "RED").alias("should_escalate"), (F.col("doc_id") % 4 == 0).alias("should_ask_followup"))


def predictions(spark, sf):
    """Predictions drawn from the event of the same number; some are blocked,
    fallbacks or errors, and scenarios without an event have none."""
    e = read(spark, sf, "events")
    labels = read(spark, sf, "labels")
    n, v = F.col("event_id"), F.col("value")
    right = F.when(F.col("toxic") == 1, "RED").when(F.col("quality") == 1, "GREEN").otherwise("YELLOW")
    level = F.when(v > 40, "RED").when(n % 5 == 0, "YELLOW").otherwise(right)
    return e.join(labels, e.event_id == labels.doc_id).select(
        F.col("event_id").alias("id"), (n % 13 == 0).alias("blocked"), (n % 26 == 0).alias("is_emergency"), (n % 17 == 0).alias("used_fallback"),
        level.alias("level"), (n % 8 == 0).alias("needs_clarification"), (v * 1.371313).alias("latency_ms"),
        F.when(n % 3 > 0, n % 5 + 1.0).alias("quality"), F.when(n % 19 == 0, F.concat(F.lit("timeout "), n.cast("string"))).alias("error"))


def scored(spark, sf):
    return evaluation.score(scenarios(spark, sf), predictions(spark, sf))


SCORED = (
    "sc AS (SELECT l.doc_id AS id, d.lang AS input_type, CASE WHEN toxic = 1 THEN 'RED' WHEN quality = 1 THEN 'GREEN' ELSE 'YELLOW' END AS expected_level, toxic = 1 AS should_escalate, l.doc_id % 4 = 0 AS should_ask_followup FROM labels l JOIN documents d USING (doc_id)), "
    "pr AS (SELECT e.event_id AS id, e.event_id % 13 = 0 AS blocked, e.event_id % 26 = 0 AS is_emergency, e.event_id % 17 = 0 AS used_fallback, CASE WHEN value > 40 THEN 'RED' WHEN e.event_id % 5 = 0 THEN 'YELLOW' ELSE expected_level END AS level, "
    "e.event_id % 8 = 0 AS needs_clarification, value * 1.371313 AS latency, CASE WHEN e.event_id % 3 > 0 THEN CAST(e.event_id % 5 + 1 AS DOUBLE) END AS quality, CASE WHEN e.event_id % 19 = 0 THEN 'timeout ' || e.event_id END AS err FROM events e JOIN sc ON sc.id = e.event_id), "
    f"jn AS (SELECT sc.*, pr.id IS NULL AS missing, coalesce(blocked, FALSE) AS guardrail_blocked, is_emergency, level, needs_clarification, coalesce(latency, 0) AS latency_ms, quality, CASE WHEN pr.id IS NULL THEN {q(evaluation.SKIPPED)} WHEN NOT blocked AND used_fallback THEN {q(evaluation.BY_RULES)} WHEN NOT blocked THEN err END AS error FROM sc LEFT JOIN pr USING (id)), "
    "scored AS (SELECT id, input_type, expected_level, should_escalate, should_ask_followup, CASE WHEN error IS NOT NULL THEN NULL WHEN guardrail_blocked THEN CASE WHEN is_emergency THEN 'RED' ELSE 'YELLOW' END ELSE level END AS actual_level, "
    "latency_ms, error, guardrail_blocked, CASE WHEN error IS NULL AND NOT guardrail_blocked THEN quality END AS response_quality, "
    "coalesce(error IS NULL AND should_escalate = CASE WHEN guardrail_blocked THEN is_emergency ELSE level = 'RED' END, FALSE) AS escalation_correct, coalesce(error IS NULL AND NOT guardrail_blocked AND should_ask_followup = needs_clarification, FALSE) AS followup_correct FROM jn), "
    "sr AS (SELECT *, coalesce(actual_level = expected_level, FALSE) AS level_correct FROM scored)"
)
RESULT = ["id", "input_type", "expected_level", "actual_level", "level_correct", "escalation_correct", "followup_correct", "guardrail_blocked", "response_quality", "error"]
QUERIES["scenario_scoring"] = lambda spark, sf: scored(spark, sf).select(*RESULT, text.rounded("latency_ms", 1).alias("latency_ms"))
SQL["scenario_scoring"] = f"WITH {SCORED} SELECT {', '.join(RESULT)}, CAST(printf('%.1f', CAST(latency_ms AS DOUBLE)) AS DOUBLE) AS latency_ms FROM sr"

COUNTS = ["scenarios", "error_count", "total", "level_correct", "red_total", "red_correct", "green_total", "green_false_alarm", "followup_should_ask", "followup_asked", "outages"]
METRICS = (
    f"{SCORED}, m AS (SELECT input_type, count(*) AS scenarios, count(*) FILTER (error IS NOT NULL) AS error_count, count(*) FILTER (error IS NULL) AS total, count(*) FILTER (error IS NULL AND level_correct) AS level_correct, "
    "count(*) FILTER (error IS NULL AND expected_level = 'RED') AS red_total, count(*) FILTER (error IS NULL AND expected_level = 'RED' AND actual_level = 'RED') AS red_correct, count(*) FILTER (error IS NULL AND expected_level = 'GREEN') AS green_total, "
    "count(*) FILTER (error IS NULL AND expected_level = 'GREEN' AND actual_level = 'RED') AS green_false_alarm, count(*) FILTER (error IS NULL AND should_ask_followup) AS followup_should_ask, count(*) FILTER (error IS NULL AND should_ask_followup AND followup_correct) AS followup_asked, "
    f"count(*) FILTER (contains(error, {q(fv.OUTAGE_MARKER)})) AS outages, avg(response_quality) FILTER (error IS NULL) AS avg_quality, coalesce(avg(latency_ms) FILTER (error IS NULL), 0) AS avg_latency_ms, "
    "list_sort(list(latency_ms) FILTER (error IS NULL)) AS ls FROM {0} GROUP BY 1), "
    "r AS (SELECT *, level_correct / nullif(total, 0) AS triage_accuracy, red_correct / nullif(red_total, 0) AS escalation_recall, green_false_alarm / nullif(green_total, 0) AS false_alarm_rate, followup_asked / nullif(followup_should_ask, 0) AS followup_precision, "
    "coalesce(ls[greatest(1, CAST(floor(len(ls) * 0.95) AS BIGINT))], 0) AS p95 FROM m), "
    f"g AS (SELECT *, CASE WHEN coalesce(error_count / nullif(scenarios, 0), 1.0) > {fv.MAX_ERROR_RATE} THEN 'inconclusive' WHEN escalation_recall IS NULL OR red_total < {fv.MIN_RED} THEN 'inconclusive' WHEN escalation_recall >= {fv.RECALL_TARGET} THEN 'pass' ELSE 'safety_failure' END AS outcome FROM r)"
)
BY_TYPE = METRICS.replace("{0}", "sr")
OVERALL = METRICS.replace("{0}", "(SELECT * REPLACE ('all' AS input_type) FROM sr)")
QUERIES["metric_counts"] = lambda spark, sf: evaluation.aggregate(scored(spark, sf), ["input_type"]).select("input_type", *COUNTS)
SQL["metric_counts"] = f"WITH {BY_TYPE} SELECT input_type, {', '.join(COUNTS)} FROM g"
RATES = ["triage_accuracy", "escalation_recall", "false_alarm_rate", "followup_precision", "avg_quality", "avg_latency_ms"]
QUERIES["metric_rates"] = lambda spark, sf: evaluation.aggregate(scored(spark, sf), ["input_type", "guardrail_blocked"]).select(
    "input_type", "guardrail_blocked", *[F.round(c, R).alias(c) for c in RATES])
SQL["metric_rates"] = (
    f"WITH {METRICS.replace('SELECT input_type, count(*) AS scenarios', 'SELECT input_type, guardrail_blocked, count(*) AS scenarios').replace('{0} GROUP BY 1', 'sr GROUP BY 1, 2')} "
    f"SELECT input_type, guardrail_blocked, {', '.join(f'round({c}, {R}) AS {c}' for c in RATES)} FROM g"
)
QUERIES["p95_latency"] = lambda spark, sf: evaluation.p95_latency(
    read(spark, sf, "events").withColumn("latency_ms", F.col("value")), ["event_type"])
SQL["p95_latency"] = (
    "SELECT event_type, ls[greatest(1, CAST(floor(len(ls) * 0.95) AS BIGINT))] AS p95_latency_ms FROM (SELECT event_type, list_sort(list(value)) AS ls FROM events GROUP BY 1)"
)


def gate(spark, sf):
    m = evaluation.aggregate(scored(spark, sf), ["input_type"])
    label = evaluation.outcome(F.col("error_count"), F.col("scenarios"), F.col("escalation_recall"), F.col("red_total"))
    lenient = evaluation.outcome(F.col("error_count"), F.col("scenarios"), F.col("escalation_recall"), F.col("red_total"), 0.9)
    return m.select("input_type", label.alias("outcome"), lenient.alias("lenient"), evaluation.exit_code(lenient).alias("exit_code"))


QUERIES["outcome_gate"] = gate
LENIENT = BY_TYPE.replace(f"> {fv.MAX_ERROR_RATE} THEN", "> 0.9 THEN")
SQL["outcome_gate"] = (
    f"WITH {LENIENT} SELECT input_type, CASE WHEN error_count / scenarios > {fv.MAX_ERROR_RATE} THEN 'inconclusive' ELSE outcome END AS outcome, outcome AS lenient, "
    "CAST(CASE outcome WHEN 'pass' THEN 0 WHEN 'inconclusive' THEN 1 ELSE 2 END AS BIGINT) AS exit_code FROM g"
)
QUERIES["level_breakdown"] = lambda spark, sf: evaluation.level_breakdown(scored(spark, sf))
SQL["level_breakdown"] = (
    f"WITH {SCORED} SELECT expected_level, count(*) AS rows, count(*) FILTER (level_correct) AS correct, count(*) FILTER (NOT level_correct AND error IS NULL) AS failures FROM sr GROUP BY 1"
)
QUERIES["outage_count"] = lambda spark, sf: evaluation.aggregate(scored(spark, sf), ["expected_level"]).select("expected_level", "outages")
SQL["outage_count"] = f"WITH {SCORED} SELECT expected_level, count(*) FILTER (contains(error, {q(fv.OUTAGE_MARKER)})) AS outages FROM sr GROUP BY 1"
QUERIES["miss_list"] = lambda spark, sf: evaluation.missed_red(scored(spark, sf)).select("id", "actual_level", F.lit("missed").alias("section")).unionByName(
    evaluation.id_subset(scored(spark, sf), "1").select("id", "actual_level", F.lit("edge").alias("section"))).orderBy("section", "id")
SQL["miss_list"] = (
    f"WITH {SCORED} SELECT id, actual_level, 'missed' AS section FROM sr WHERE expected_level = 'RED' AND error IS NULL AND actual_level <> 'RED' "
    "UNION ALL SELECT id, actual_level, 'edge' FROM sr WHERE CAST(id AS VARCHAR) LIKE '1%'"
)
SUMMARY = ["total_scenarios", "ran", "errors", "outcome", "triage_accuracy", "escalation_recall", "escalation_recall_pass", "red_scenarios_evaluated",
           "false_alarm_rate", "followup_precision", "avg_response_quality", "avg_latency_ms", "p95_latency_ms", "outages"]
SQL_SUMMARY = (
    "scenarios AS total_scenarios, total + error_count AS ran, error_count AS errors, outcome, CAST(printf('%.4f', CAST(triage_accuracy AS DOUBLE)) AS DOUBLE) AS triage_accuracy, CAST(printf('%.4f', CAST(escalation_recall AS DOUBLE)) AS DOUBLE) AS escalation_recall, escalation_recall >= 0.95 AS escalation_recall_pass, "
    "red_total AS red_scenarios_evaluated, CAST(printf('%.4f', CAST(false_alarm_rate AS DOUBLE)) AS DOUBLE) AS false_alarm_rate, CAST(printf('%.4f', CAST(followup_precision AS DOUBLE)) AS DOUBLE) AS followup_precision, CAST(printf('%.2f', CAST(avg_quality AS DOUBLE)) AS DOUBLE) AS avg_response_quality, CAST(printf('%.1f', CAST(avg_latency_ms AS DOUBLE)) AS DOUBLE) AS avg_latency_ms, CAST(printf('%.1f', CAST(p95 AS DOUBLE)) AS DOUBLE) AS p95_latency_ms, outages"
)


def report(spark, sf):
    summary, rows = evaluate.evaluate(scenarios(spark, sf), predictions(spark, sf))
    folder = shared_dir(spark, "report")
    evaluate.write_report(summary, rows, folder)
    return spark.read.schema(summary.schema).json(f"{folder}/summary")


QUERIES["report_summary"] = report
SQL["report_summary"] = f"WITH {OVERALL} SELECT {SQL_SUMMARY} FROM g"
QUERIES["evaluate_by_type"] = lambda spark, sf: evaluate.evaluate(scenarios(spark, sf), predictions(spark, sf), ["input_type"])[0]
SQL["evaluate_by_type"] = f"WITH {BY_TYPE} SELECT input_type, {SQL_SUMMARY} FROM g"


def evaluated_rules(spark, sf):
    """The rule triage itself, against levels taken from the labels."""
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    phrases = F.array(*[F.lit(p) for p in USER_PHRASES])
    phrase = F.element_at(phrases, (F.col("doc_id") % len(USER_PHRASES) + 1).cast("int"))
    asked = docs.select("doc_id", F.concat("text", F.lit(" "), phrase).alias("text"))
    # an invalid message is not escalated, whatever the rules say of its text
    triaged = triage.triage_rules(asked, lexicon(spark), ["doc_id"], F.lit("english"), judge_invalid=False)
    predicted = evaluate.predictions_from(triaged, "doc_id").withColumns({
        "used_fallback": F.lit(False), "latency_ms": F.lit(0.0), "quality": F.lit(None).cast("double"), "error": F.lit(None).cast("string")})
    return evaluation.level_breakdown(evaluation.score(scenarios(spark, sf), predicted))


QUERIES["evaluate_rules"] = evaluated_rules


def scenario_scan(spark, sf):
    """Scenarios written as nested files of at most 500, then read back."""
    s = scenarios(spark, sf).select(
        F.col("id").cast("string").alias("id"), "input_type", F.col("expected_level").alias("expected_triage_level"),
        F.array(F.col("input_type")).alias("expected_conditions"), "should_escalate", "should_ask_followup")
    packed = s.groupBy("input_type", F.floor(F.col("id").cast("bigint") / 500).alias("file")).agg(F.collect_list(F.struct(*s.columns)).alias("scenarios"))
    folder = shared_dir(spark, "scenarios")
    packed.select("input_type", "file", F.to_json(F.struct("scenarios")).alias("value")).write.partitionBy("input_type", "file").text(folder)
    back = src.scan_scenarios(spark, folder)
    return back.select("id", "input_type", "expected_triage_level", "should_escalate", "should_ask_followup", F.array_join("expected_conditions", ",").alias("conditions"))


QUERIES["scenario_scan"] = scenario_scan
SQL["scenario_scan"] = f"WITH {SCORED} SELECT CAST(id AS VARCHAR) AS id, input_type, expected_level AS expected_triage_level, should_escalate, should_ask_followup, input_type AS conditions FROM sc"


# ------------------------------------------------- history, judging, tokenisers
def triage_with_history(spark, sf):
    """Symptoms from the message with its history; emergencies from the
    message alone."""
    framed = conversation.history_frames(messages(spark, sf))
    return triage.triage_rules(framed, lexicon(spark), ID, script(), "context_text").select(*ID, *TRIAGE_OUT)


HISTORY_CTES = EXTRACT_CTES.replace("toks AS (SELECT conv_id, turn, text,", "toks AS (SELECT conv_id, turn, context_text AS text,").replace(
    "FROM messages)", "FROM framed)", 1).replace("2, 0, 0, text FROM messages", "2, 0, 0, context_text FROM framed")
HISTORY_CTES = HISTORY_CTES.replace(MESSAGES, MESSAGES + ", framed AS (SELECT * FROM " + "(SELECT conv_id, turn, role, text, string_agg(text, chr(10)) OVER "
                                    "(PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS context_text FROM messages))", 1)
QUERIES["triage_with_history"] = triage_with_history
SQL["triage_with_history"] = "WITH " + RULED.replace(EXTRACT_CTES, HISTORY_CTES).replace(
    f"len({sql_words('text')}) < 2 THEN 'vague'", f"len({sql_words('context_text')}) < 2 THEN 'vague'").replace(
    "FROM verdict v JOIN sym s USING (conv_id, turn))", "FROM verdict v JOIN sym s USING (conv_id, turn) JOIN framed f USING (conv_id, turn))").replace(
    "AS step0 FROM verdict", "AS step0, f.context_text FROM verdict") + f" SELECT conv_id, turn, {', '.join(TRIAGE_OUT)} FROM ruled"


def _judge(prompts: list[str]) -> list[str]:
    return [f"{len(p) % 7}" for p in prompts]


def quality_ratings(spark, sf):
    prompt = text.fill(copy.PROMPTS["quality"], input_text=F.col("role"), expected_level=F.lit("RED"), actual_level=F.lit("unknown"),
                       response_text=text.truncate("text", fv.JUDGED_CHARS))
    judged = hooks.score(replies(spark, sf).select(*ID, prompt.alias("prompt")), "prompt", _judge)
    return judged.select(*ID, parsing.parse_rating(F.col("answer")).alias("quality"))


QUERIES["quality_ratings"] = quality_ratings
QUALITY_LENGTH = len(copy.PROMPTS["quality"].format(input_text="assistant", expected_level="RED", actual_level="unknown", response_text=""))
SQL["quality_ratings"] = (
    f"WITH {REPLIES}, r AS (SELECT conv_id, turn, ({QUALITY_LENGTH} + length(substr(text, 1, {fv.JUDGED_CHARS}))) % 7 AS r FROM replies) "
    "SELECT conv_id, turn, CAST(CASE WHEN r BETWEEN 1 AND 5 THEN r END AS DOUBLE) AS quality FROM r"
)


def paragraphs(c):
    """A tokeniser that takes each line with its line end as one token."""
    return F.split(c, "(?<=\n)")


QUERIES["custom_tokeniser_chunks"] = lambda spark, sf: chunking.chunk_pages(corpus(spark, sf), 3, 1, paragraphs).select(
    "chunk_id", "token_count", "char_start", "char_end")
SQL["custom_tokeniser_chunks"] = (
    f"WITH {CORPUS}, pieces AS (SELECT source_name, page_number, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i < len(l) THEN l[i] || chr(10) ELSE l[i] END), lambda s: TRUE) AS p "
    "FROM (SELECT *, string_split(text, chr(10)) AS l FROM corpus)), w AS (SELECT *, unnest(range(0, CAST(ceil(len(p) / 2.0) AS BIGINT))) AS j FROM pieces), "
    "r AS (SELECT *, length(coalesce(array_to_string(p[1:j * 2], ''), '')) AS char_start, array_to_string(p[j * 2 + 1:j * 2 + 3], '') AS raw FROM w) "
    "SELECT regexp_replace(source_name, '\\.[^.]*$', '') || '_' || page_number || '_' || j AS chunk_id, "
    f"1 + length({sql_strip('raw')}) - length(replace({sql_strip('raw')}, chr(10), '')) AS token_count, char_start, char_start + length(raw) AS char_end FROM r WHERE {sql_strip('raw')} <> ''"
)

ASKED = (
    "messages_phrases AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {q(p)})" for i, p in enumerate(USER_PHRASES)) + ") AS v(no, phrase)), "
    "messages AS (SELECT doc_id AS conv_id, CAST(0 AS BIGINT) AS turn, 'user' AS role, documents.text || ' ' || phrase AS text FROM labels JOIN documents USING (doc_id) "
    f"JOIN messages_phrases ON no = doc_id % {len(USER_PHRASES)})"
)
SQL["evaluate_rules"] = (
    f"WITH {RULED.replace(MESSAGES, ASKED, 1)}, {SCORED.split(', pr AS')[0]}, out AS (SELECT sc.expected_level, CASE WHEN step = 'blocked' THEN CASE WHEN is_emergency THEN 'RED' ELSE 'YELLOW' END ELSE level END AS actual "
    "FROM sc JOIN ruled ON ruled.conv_id = sc.id) SELECT expected_level, count(*) AS rows, count(*) FILTER (actual = expected_level) AS correct, count(*) FILTER (actual IS DISTINCT FROM expected_level) AS failures FROM out GROUP BY 1"
)
