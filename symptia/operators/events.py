"""Reply event streams as tables: frames, folds, call logs, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.functions.rows import explode_rows
from symptia.operators.ordering import running_totals
from symptia.operators.replies import redact

FRAME_PREFIX = "data: "
DONE = "[DONE]"
EVENT_FIELDS = (
    "type string, content string, triage_level string, possible_conditions array<string>, "
    "recommended_actions array<string>, disclaimer string, needs_clarification boolean, "
    "follow_up_question string, reason string, message string, force_red boolean"
)
SEQ_BUCKET = 1024
STATUS_BAD = ["degraded", "error"]


# -------------------------------------------------------------------- frames
def to_frame(event: Column) -> Column:
    """One event struct as a frame; explicit nulls are written."""
    return F.concat(F.lit(FRAME_PREFIX), F.to_json(event, {"ignoreNullFields": "false"}), F.lit("\n\n"))


def read_frames(logs: DataFrame, id_cols: list[str], raw: str = "raw") -> DataFrame:
    """Events of each log: lines with the prefix, up to the terminator.
    Frames that are not JSON disappear silently."""
    lines = explode_rows(logs, id_cols, F.split(F.col(raw), "\n"), "line", "line_no").filter(
        F.startswith("line", F.lit(FRAME_PREFIX))
    )
    payload = text.strip(F.substring("line", len(FRAME_PREFIX) + 1, 2**31 - 1))
    lines = lines.withColumn("payload", payload)
    ends = lines.filter(F.col("payload") == DONE).groupBy(*id_cols).agg(F.min("line_no").alias("_end"))
    parsed = F.from_json("payload", EVENT_FIELDS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        lines.join(ends, id_cols, "left")
        .filter(F.col("_end").isNull() | (F.col("line_no") < F.col("_end")))
        .withColumn("event", parsed)
        .filter(F.col("event").isNotNull() & F.col("event._bad").isNull())
        .select(*id_cols, "line_no", "event.*")
        .drop("_bad")
    )


def read_frames_in_row(logs: DataFrame, id_cols: list[str], raw: str = "raw") -> DataFrame:
    """:func:`read_frames` for logs that each fit a row anyway: the cut at the
    terminator happens in the array, so nothing is shuffled."""
    lines = F.filter(
        F.transform(F.split(F.col(raw), "\n"), lambda l, i: F.struct(i.alias("line_no"), l.alias("line"))),
        lambda s: F.startswith(s["line"], F.lit(FRAME_PREFIX)),
    )
    cleaned = F.transform(lines, lambda s: F.struct(
        s["line_no"].alias("line_no"), text.strip(F.substring(s["line"], len(FRAME_PREFIX) + 1, 2**31 - 1)).alias("payload")))
    until = text.bind(cleaned, lambda ps: text.bind(
        F.array_position(F.transform(ps, lambda p: p["payload"]), DONE),
        lambda at: F.when(at > 0, F.slice(ps, F.lit(1), at.cast("int") - 1)).otherwise(ps)))
    parsed = F.from_json("_p.payload", EVENT_FIELDS + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return (
        explode_rows(logs, id_cols, until, "_p")
        .select(*id_cols, "_p.line_no", parsed.alias("event"))
        .filter(F.col("event").isNotNull() & F.col("event._bad").isNull())
        .select(*id_cols, "line_no", "event.*")
        .drop("_bad")
    )


# --------------------------------------------------------- sentence segments
def ends_sentence(chunk: Column) -> Column:
    return chunk.rlike("[" + fv.SENTENCE_END + "]")


def cut_sentence(chunk: Column) -> tuple[Column, Column]:
    """(up to and with the last sentence end, the rest)."""
    head = F.regexp_extract(chunk, "(?s)^(.*[" + fv.SENTENCE_END + "])", 1)
    return head, F.substring(chunk, F.length(head) + 1, F.length(chunk))


def segment_chunks(chunks: DataFrame, id_cols: list[str]) -> DataFrame:
    """Chunks (ids, seq, content) regrouped at sentence ends and redacted, as
    a stream would flush them: ids, segment, content.

    A chunk with a sentence end closes a segment at its last one. Segments are
    numbered with bucketed running counts and concatenated by parts, so a long
    reply is not sorted in one place.
    """
    head, tail = cut_sentence(F.col("content"))
    marked = chunks.withColumn("_ends", ends_sentence(F.col("content")).cast("int")).withColumn(
        "_bucket", F.floor(F.col("seq") / SEQ_BUCKET))
    numbered = running_totals(marked, id_cols, "_bucket", ["seq"], {"_cuts": F.col("_ends")})
    pieces = numbered.select(*id_cols, "seq", F.explode(F.when(
        F.col("_ends") == 1,
        F.array(F.struct((F.col("_cuts") - 1).alias("segment"), F.lit(0).alias("part"), head.alias("piece")),
                F.struct(F.col("_cuts").alias("segment"), F.lit(1).alias("part"), tail.alias("piece"))),
    ).otherwise(F.array(F.struct(F.col("_cuts").alias("segment"), F.lit(0).alias("part"), F.col("content").alias("piece"))))).alias("p"))
    joined = concat_ordered(
        pieces.select(*id_cols, "p.segment", (F.col("seq") * 2 + F.col("p.part")).alias("seq"), "p.piece"),
        [*id_cols, "segment"], "seq", "piece", "content",
    )
    return joined.filter(F.col("content") != "").withColumn("content", redact(F.col("content")))


def concat_ordered(df: DataFrame, keys: list[str], seq: str, value: str, out: str, bucket: int = SEQ_BUCKET) -> DataFrame:
    """Strings of a key in order as one string, by way of partial strings per
    bucket; only the final cell itself holds a whole key."""
    glue = lambda s, v: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(s, v))), lambda x: x[v]), "")
    parts = df.withColumn("_part", F.floor(F.col(seq) / bucket)).groupBy(*keys, "_part").agg(glue(seq, value).alias("_piece"))
    return parts.groupBy(*keys).agg(glue("_part", "_piece").alias(out))


# ---------------------------------------------------------------------- fold
def fold_messages(events: DataFrame, id_cols: list[str]) -> DataFrame:
    """State of each message after its events (ids, seq, type, ...).

    Content is the chunks in order, unless a blocked or error event replaced
    it; the last classification wins, and a forced RED comes from a block.
    """
    seq, kind = F.col("seq"), F.col("type")
    override = F.when(kind == "blocked", F.coalesce("message", F.lit(""))).when(
        kind == "error", F.coalesce("message", F.lit("An error occurred.")))
    level = F.when(kind.isin("triage_classified", "complete"), F.coalesce(F.nullif("triage_level", F.lit("")), F.lit("YELLOW"))).when(
        (kind == "blocked") & F.col("force_red"), "RED")
    state = events.groupBy(*id_cols).agg(
        F.max_by(override, F.when(override.isNotNull(), seq)).alias("_override"),
        F.max(F.when(override.isNotNull(), seq)).alias("_override_seq"),
        F.max_by(level, F.when(level.isNotNull(), seq)).alias("triage_level"),
        F.bool_or(kind == "blocked").alias("is_blocked"),
        F.bool_or(kind == "error").alias("is_error"),
        F.bool_or(kind.isin("complete", "blocked", "error")).alias("is_finished"),
        F.count("*").alias("n_events"),
    )
    chunks = events.filter((kind == "chunk") & F.col("content").isNotNull() & (F.col("content") != ""))
    # a chunk after an override would append to it
    late = chunks.join(state.filter(F.col("_override_seq").isNotNull()).select(*id_cols, "_override_seq"), id_cols, "left").filter(
        F.col("_override_seq").isNull() | (seq > F.col("_override_seq")))
    written = concat_ordered(late.select(*id_cols, "seq", "content"), id_cols, "seq", "content", "_content")
    return state.join(written, id_cols, "left").select(
        *id_cols, F.concat(F.coalesce("_override", F.lit("")), F.coalesce("_content", F.lit(""))).alias("content"),
        "triage_level", "is_blocked", "is_error", "is_finished", "n_events",
    )


# ----------------------------------------------------------------- call logs
def call_log(calls: DataFrame) -> DataFrame:
    """Log projection of model calls (step, provider, streamed, system_prompt,
    prompt, response, latency_ms, ...): cut texts, one-decimal latency."""
    name = F.concat("step", F.lit(":"), "provider", F.when(F.col("streamed"), "(stream)").otherwise(""))
    system = F.when(~F.col("streamed"), F.nullif(text.truncate("system_prompt", fv.LOG_SYSTEM_CHARS), F.lit("")))
    return calls.select(
        "call_id", "trace_id", name.alias("name"), system.alias("system_prompt"),
        text.truncate("prompt", fv.LOG_PROMPT_CHARS).alias("prompt"),
        text.truncate("response", fv.LOG_RESPONSE_CHARS).alias("response"),
        text.rounded("latency_ms", 1).alias("latency_ms"), "total_tokens",
    )


def tokens_per_trace(calls: DataFrame) -> DataFrame:
    return calls.groupBy("trace_id").agg(F.sum("total_tokens").alias("total_tokens"), F.count("*").alias("n_calls"))


# -------------------------------------------------------------------- status
def component_status(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and status per table; an empty one is degraded."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("component"), "n_rows", F.when(F.col("n_rows") > 0, "ok").otherwise("degraded").alias("status"))
        for name, df in tables.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall_status(components: DataFrame) -> DataFrame:
    return components.agg(
        F.when(F.bool_or(F.col("status").isin(STATUS_BAD)), "degraded").otherwise("ok").alias("status"),
        F.count_if(F.col("status") != "ok").alias("n_not_ok"),
    )
