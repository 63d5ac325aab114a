"""The streaming jobs, each the twin of a batch operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.operators import chunking, replies
from symptia.plans import triage
from symptia.streaming.processors import Admission, MessageState, SentenceBuffer
from symptia.streaming.runner import append_each, use_rocksdb


def _fields(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"{n} {df.schema[n].dataType.simpleString()}" for n in names)


def triage_stream(messages: DataFrame, entries: DataFrame, id_cols: list[str], script: Column, name: str = "triage",
                  folder: str | None = None) -> DataFrame:
    """Rule triage of the messages that have arrived, written and read back.
    Every micro-batch runs the batch job, so a dictionary of any size gives
    the same rows."""
    return append_each(messages, lambda batch: triage.triage_rules(batch, entries, id_cols, script), name, folder)


#: How long a key without new events keeps its state, in milliseconds.
KEEP_MS = 24 * 3600 * 1000


def _deliveries(events: DataFrame, id_cols: list[str], payload: list[str], packed: str | None) -> DataFrame:
    """Events as rows of arrays. What came in one row stays one row on its way
    to the state: a row for each event costs far more than the event."""
    names = ["seq", *payload]
    if packed:
        return events.filter(F.col(packed).isNotNull()).select(*id_cols, *[F.col(packed)[n].alias(n) for n in names])
    return events.select(*id_cols, *[F.array(n).alias(n) for n in names])


def sentence_stream(chunks: DataFrame, id_cols: list[str], keep_ms: int = KEEP_MS, packed: str | None = None) -> DataFrame:
    """Chunks (ids, seq, content, last) to redacted sentence segments (ids,
    segment, content). Redaction waits for the sentence, so a dose split over
    two chunks is still seen. Redelivered chunks change nothing for
    ``keep_ms`` after the last new one. With ``packed`` a row holds an array of
    chunks of that name instead of one."""
    use_rocksdb(chunks.sparkSession)
    columns = [*id_cols, "segment", "content"]
    out = _deliveries(chunks, id_cols, SentenceBuffer.payload, packed).groupBy(*id_cols).transformWithState(
        SentenceBuffer(columns, keep_ms), _fields(chunks, id_cols) + ", segment bigint, content string", "Append", "ProcessingTime")
    return out.withColumn("content", replies.redact(F.col("content")))


def message_state_stream(events: DataFrame, id_cols: list[str], keep_ms: int = KEEP_MS, packed: str | None = None) -> DataFrame:
    """Events (ids, seq, type, ...) to the running state of their message.
    Redelivered events change nothing for ``keep_ms`` after the last new one.
    With ``packed`` a row holds an array of events of that name instead of one."""
    use_rocksdb(events.sparkSession)
    state = "content string, triage_level string, is_blocked boolean, is_error boolean, is_finished boolean, n_events bigint"
    columns = [*id_cols, *[c.strip().split(" ")[0] for c in state.split(",")]]
    return _deliveries(events, id_cols, MessageState.payload, packed).groupBy(*id_cols).transformWithState(
        MessageState(columns, keep_ms), _fields(events, id_cols) + ", " + state, "Update", "ProcessingTime")


def admission_stream(requests: DataFrame, key: str, ts: str, id_col: str, limit: int = fv.ADMIT_MAX,
                     seconds: int = fv.ADMIT_SECONDS, lateness: str = "1 hour", beats: DataFrame | None = None,
                     counts: Column | None = None) -> DataFrame:
    """Decisions (key, id, admitted, retry_after) on arriving requests, in the
    order of their times.

    A request is decided when the watermark, ``lateness`` behind the newest
    time, has passed it; requests that come later than that are dropped, as
    the order they belong to is past. ``beats`` is a stream of times (``at``)
    that moves the watermark when no requests do. Requests for which
    ``counts`` is not true are admitted at once and take up no place.
    """
    use_rocksdb(requests.sparkSession)
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    rows = requests.select(key, F.col(id_col).alias("request"), F.col(ts).cast("timestamp").alias("_ts"),
                           counts.alias("counts"), F.lit(False).alias("beat"))
    if beats is not None:
        types = dict(rows.dtypes)
        rows = rows.unionByName(beats.select(
            F.lit(None).cast(types[key]).alias(key), F.lit(None).cast(types["request"]).alias("request"),
            F.col("at").alias("_ts"), F.lit(False).alias("counts"), F.lit(True).alias("beat")))
    # the condition names the time as well, or the optimizer would drop the
    # beats before they reach the watermark
    rows = rows.withWatermark("_ts", lateness).filter(~(F.col("beat") & F.col("_ts").isNotNull())).select(
        key, "request", "counts", "_ts", F.unix_micros("_ts").alias("at_micros"))
    id_type = requests.schema[id_col].dataType.simpleString()
    schema = _fields(requests, [key]) + f", {id_col} {id_type}, admitted boolean, retry_after bigint"
    return rows.groupBy(key).transformWithStateInPandas(
        Admission(limit, seconds, [key, id_col, "admitted", "retry_after"], id_type), schema, "Append", "EventTime")


def repeat_stream(calls: DataFrame, key: str, ts: str, id_col: str, temperature: str, seconds: int = fv.REPEAT_SECONDS,
                  warmest: float = fv.REPEAT_MAX_TEMPERATURE, lateness: str = "1 hour", beats: DataFrame | None = None) -> DataFrame:
    """Repeat suppression: admission with a limit of one. Warm calls, and those
    without a temperature or a time, are answered and not stored."""
    decided = admission_stream(calls, key, ts, id_col, 1, seconds, lateness, beats, F.col(temperature) <= warmest)
    return decided.select(key, id_col, (~F.coalesce("admitted", F.lit(True))).alias("cached"))


def ingest_stream(pages: DataFrame, chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS) -> DataFrame:
    """Chunks of arriving pages; stateless, each page on its own."""
    return chunking.chunk_pages(pages, chunk_tokens, overlap_tokens)
