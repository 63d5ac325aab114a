"""Streaming jobs over the tables; their twins are those of the batch jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import corpus_rules, flow_rules, inputs
from symptia.functions import text
from symptia.operators import admission
from symptia.session import shared_dir
from symptia.streaming import jobs, runner

QUERIES, SQL = {}, {}
ID = ["conv_id", "turn"]


def messages(spark, sf):
    df = runner.read_table(spark, sf, "conversations").filter(F.col("role") == "user")
    return inputs._with_phrase(df, inputs.USER_PHRASES, F.col("conv_id") * 31 + F.col("turn") * 7)


def replies(spark, sf):
    df = runner.read_table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return inputs._with_phrase(df, inputs.REPLY_PHRASES, F.col("conv_id") * 3 + F.col("turn"))


def stream_triage(spark, sf):
    out = jobs.triage_stream(messages(spark, sf), inputs.lexicon(spark), ID, text.detect_script(F.col("text")))
    return out.select(*ID, *flow_rules.TRIAGE_OUT, F.array_join("actions", "; ").alias("actions"))


QUERIES["stream_triage"] = stream_triage
SQL["stream_triage"] = flow_rules.SQL["triage_rules"]


def _words(df):
    """Words as chunks, closed by an event that carries no text."""
    chunks = F.concat(
        F.transform(text.words("text"), lambda w, i: F.struct(
            i.cast("bigint").alias("seq"), F.concat(w, F.lit(" ")).alias("content"), F.lit(False).alias("last"))),
        F.array(F.struct(F.size(text.words("text")).cast("bigint").alias("seq"), F.lit("").alias("content"), F.lit(True).alias("last"))))
    return df.select(*ID, chunks.alias("chunks"))


QUERIES["stream_sentence_segments"] = lambda spark, sf: runner.append(
    jobs.sentence_stream(_words(replies(spark, sf)), ID, packed="chunks"), "stream_sentences", idle=False)
SQL["stream_sentence_segments"] = flow_rules.SQL["sentence_segments"]


def stream_fold(spark, sf):
    df = replies(spark, sf)
    k = (F.col("conv_id") + F.col("turn")) % 5
    none = F.lit(None).cast("string")

    def event(seq, kind, content=none, level=none, message=none, red=None):
        red = F.lit(False) if red is None else red
        return F.struct(seq.cast("bigint").alias("seq"), kind.alias("type"), content.alias("content"), level.alias("triage_level"),
                        message.alias("message"), red.alias("force_red"))

    n = F.size(text.words("text"))
    every = F.concat(
        F.array(event(F.lit(-1), F.lit("triage_classified"), level=F.when(k == 1, none).otherwise("GREEN"))),
        F.transform(text.words("text"), lambda w, i: event(i, F.lit("chunk"), F.concat(w, F.lit(" ")))),
        F.array(event(n, F.when(k == 2, "blocked").when(k == 3, "error").otherwise("complete"), level=F.when(k == 4, "RED"),
                      message=F.when(k == 2, "stopped"), red=(k == 2) & (F.col("turn") % 2 == 0))))
    rows = df.select(*ID, every.alias("events"))
    return runner.latest(jobs.message_state_stream(rows, ID, packed="events"), "stream_fold", ID, "n_events", idle=False)


QUERIES["stream_event_fold"] = stream_fold
SQL["stream_event_fold"] = flow_rules.SQL["event_fold"]


def _with_beat(spark, name, job):
    """A stream that ends with a beat, so that its last rows come out too."""
    folder = shared_dir(spark, name)
    return runner.append(job(runner.beats(spark, f"{folder}/beats")), name, folder, lambda: runner.beat(spark, f"{folder}/beats"))


def _span(spark, sf):
    """A lateness that covers all times of the table, so that the order in
    which its files come drops no row."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    micros = inputs.read(spark, sf, "events").select(F.coalesce(F.max(ts) - F.min(ts), F.lit(0)).alias("v")).first().v
    return f"{micros // 1_000_000 + 1} seconds"


QUERIES["stream_admission"] = lambda spark, sf: _with_beat(spark, "stream_admission", lambda beats: jobs.admission_stream(
    runner.read_table(spark, sf, "events"), "user_id", "ts", "event_id", 3, 86400, _span(spark, sf), beats))
SQL["stream_admission"] = flow_rules.SQL["sliding_window_admission"]


def stream_repeats(spark, sf):
    e = runner.read_table(spark, sf, "events")
    step = F.when(F.col("event_type") == "click", "classification").otherwise("response")
    temperature = F.when(F.col("event_id") % 4 == 0, 0.4).otherwise(0.1)
    key = admission.prompt_key(F.lit("sys"), F.concat_ws(" ", step, (F.col("user_id") % 20).cast("string")), temperature, F.lit(8))
    calls = e.select(F.col("event_id").alias("call_id"), "ts", key.alias("prompt_key"), temperature.alias("temperature"))
    return _with_beat(spark, "stream_repeats", lambda beats: jobs.repeat_stream(
        calls, "prompt_key", "ts", "call_id", "temperature", 7200, lateness=_span(spark, sf), beats=beats))


QUERIES["stream_repeat_suppression"] = stream_repeats
SQL["stream_repeat_suppression"] = flow_rules.SQL["repeat_prompt_suppression"]


def stream_ingest(spark, sf):
    chunks = jobs.ingest_stream(runner.read_corpus(spark, inputs.corpus_files(spark, sf)))
    # the files and the texts of the chunks lie on disk together
    settings = runner.SMALL_FILES | {"spark.sql.parquet.compression.codec": "zstd"}
    return runner.append(chunks, "stream_ingest", settings=settings).select(*corpus_rules.COLUMNS, F.md5("text").alias("text_md5"))


QUERIES["stream_ingest"] = stream_ingest
SQL["stream_ingest"] = corpus_rules.SQL["ingest_chunks"]
