import random
from collections import deque

import pandas as pd
import pytest
from checks.inputs import USER_PHRASES, lexicon
from pyspark.sql import functions as F
from symptia.functions import messages, text
from symptia.operators import admission, events, lexicon as lex
from symptia.plans import triage
from symptia.streaming import jobs, processors, runner

EVENT = "m int, seq bigint, type string, content string, triage_level string, message string, force_red boolean"


def test_frames_round_trip(spark):
    rows = [(1, 0, "start", None), (1, 1, "chunk", 'وجع "x"\n'), (2, 0, "chunk", "b")]
    df = spark.createDataFrame(rows, "m int, seq int, type string, content string")
    framed = df.select("m", "seq", events.to_frame(F.struct("type", "content")).alias("f"))
    assert framed.filter("m = 1 and seq = 0").collect()[0].f == 'data: {"type":"start","content":null}\n\n'
    logs = spark.createDataFrame([
        (1, 'data: {"type":"start"}\n\n: hi\ndata: {bad\ndata: {"type":"chunk","content":"وجع"}\ndata: [DONE]\ndata: {"type":"late"}'),
        (2, 'event: x\ndata:nospace\ndata: {"type":"chunk","content":"z"}  \n')], "m int, raw string")
    for reader in (events.read_frames, events.read_frames_in_row):
        got = sorted((r.m, r.line_no, r.type, r.content) for r in reader(logs, ["m"]).collect())
        assert got == [(1, 0, "start", None), (1, 4, "chunk", "وجع"), (2, 2, "chunk", "z")]


FOLD_ROWS = [
    (1, -1, "triage_classified", None, "GREEN", None, False), (1, 0, "chunk", "a ", None, None, False), (1, 1, "chunk", "b", None, None, False),
    (1, 2, "complete", None, "RED", None, False),
    (2, -1, "start", None, None, None, False), (2, 0, "chunk", "x", None, None, False), (2, 1, "blocked", None, None, "no", True), (2, 2, "chunk", "!", None, None, False),
    (3, -1, "start", None, None, None, False), (3, 0, "error", None, None, None, False),
    (4, -1, "triage_classified", None, None, None, False), (4, 0, "chunk", None, None, None, False),
]
FOLDED = {1: ("a b", "RED", False, False, True), 2: ("no!", "RED", True, False, True), 3: ("An error occurred.", None, False, True, True), 4: ("", "YELLOW", False, False, False)}


def states(rows):
    return {r.m: (r.content, r.triage_level, r.is_blocked, r.is_error, r.is_finished) for r in rows}


def test_fold(spark):
    df = spark.createDataFrame(FOLD_ROWS, EVENT)
    assert states(events.fold_messages(df, ["m"]).collect()) == FOLDED


def stream_files(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_fold_stream_over_several_batches_out_of_order(spark, tmp_path):
    batches = [FOLD_ROWS[1::2], FOLD_ROWS[0::4], FOLD_ROWS[2::4]]
    stream = stream_files(spark, tmp_path / "in", batches, EVENT)
    out = runner.latest(jobs.message_state_stream(stream, ["m"]), "fold", ["m"], "n_events", str(tmp_path / "out"), idle=False)
    assert states(out.collect()) == FOLDED


def test_packed_streams_are_those_of_single_events(spark, tmp_path):
    """Rows with arrays of events: with a gap, overlaps, a null and no array at all."""
    fields = EVENT.split(", ", 1)[1]
    of = lambda m, a, b: (m, sorted((r[1:] for r in FOLD_ROWS if r[0] == m), key=lambda e: e[0])[a:b])
    keys = sorted({r[0] for r in FOLD_ROWS})
    nothing = (None,) * (fields.count(",") + 1)
    parts = [[of(m, 2, 4) for m in keys] + [(keys[0], None)], [(keys[0], [nothing])] + [of(m, 0, 3) for m in keys], [of(m, 1, None) for m in keys]]
    schema = f"{EVENT.split(', ', 1)[0]}, events array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>"
    stream = stream_files(spark, tmp_path / "in", parts, schema)
    out = runner.latest(jobs.message_state_stream(stream, ["m"], packed="events"), "p", ["m"], "n_events", str(tmp_path / "out"), idle=False)
    assert states(out.collect()) == FOLDED


def test_sentence_stream_over_several_batches(spark, tmp_path):
    reply = "You have flu. Take 500 mg of x.y twice, then rest"
    words = [w + " " for w in reply.split()]
    rows = [(1, i, w, False) for i, w in enumerate(words)] + [(1, len(words), "", True)]
    schema = "m int, seq bigint, content string, last boolean"
    stream = stream_files(spark, tmp_path / "in", [rows[::3], rows[1::3], rows[2::3]], schema)
    streamed = {r.segment: r.content for r in runner.append(jobs.sentence_stream(stream, ["m"]), "s", str(tmp_path / "out"), idle=False).collect()}
    chunks = spark.createDataFrame(rows[:-1], schema).select("m", "seq", "content")
    batch = {r.segment: r.content for r in events.segment_chunks(chunks, ["m"]).collect()}
    assert streamed == batch
    assert "".join(v for _, v in sorted(batch.items())) == "you may have flu. Take [dosage removed].y twice, then rest "


def waiting(spark, checkpoint):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()


def test_redelivered_chunks_change_nothing(spark, tmp_path):
    """Before, during and after the end of a stream, over five micro-batches;
    a gap that never closes leaves only what waits behind it."""
    schema = "m int, seq bigint, content string, last boolean"
    a, b, c, end = (1, 0, "Hello. ", False), (1, 1, "It is ", False), (1, 2, "late. So", False), (1, 3, "", True)
    gap = [(2, 0, "One. ", False), (2, 2, "Three. ", False), (2, 3, "Four.", True)]
    parts = [[a, a, c], [a, c, gap[0], gap[1]], [b, a, gap[2], gap[1], (3, None, "no place", True)], [end, b, a, c], [a, end, c, gap[0], gap[2]]]
    stream = stream_files(spark, tmp_path / "in", parts, schema)
    out = str(tmp_path / "out")
    got = sorted(tuple(r) for r in runner.append(jobs.sentence_stream(stream, ["m"]), "s", out, idle=False).collect())
    assert got == [(1, 0, "Hello."), (1, 1, " It is late."), (1, 2, " So"), (2, 0, "One.")]
    left = waiting(spark, f"{out}/checkpoint").select("key.m", "user_map_key.seq").collect()
    assert sorted(tuple(r) for r in left) == [(2, 2), (2, 3)]


def test_redelivered_events_do_not_reopen_a_message(spark, tmp_path):
    schema = "m int, seq bigint, type string, content string, triage_level string, message string, force_red boolean"
    event = lambda seq, kind, text=None: (1, seq, kind, text, "GREEN", None, False)
    start, one, two, done = event(-1, "start"), event(0, "chunk", "a"), event(1, "chunk", "b"), event(2, "complete")
    parts = [[one, start], [one, done], [start, two, one], [two, start], [done, one, start]]
    stream = stream_files(spark, tmp_path / "in", parts, schema)
    (row,) = runner.latest(jobs.message_state_stream(stream, ["m"]), "f", ["m"], "n_events", str(tmp_path / "out"), idle=False).collect()
    assert (row.content, row.is_finished, row.n_events) == ("ab", True, 4)
    assert waiting(spark, str(tmp_path / "out/checkpoint")).count() == 0


def test_state_expires_when_the_last_event_never_comes(spark, tmp_path):
    schema = "m int, seq bigint, content string, last boolean"
    first = (1, 0, "Hello. ", False)
    stream = stream_files(spark, tmp_path / "in", [[first], [first]], schema)
    kept = runner.append(jobs.sentence_stream(stream, ["m"]), "s", str(tmp_path / "kept"), idle=False)
    assert kept.count() == 1
    gone = runner.append(jobs.sentence_stream(stream, ["m"], keep_ms=1), "s", str(tmp_path / "gone"), idle=False)
    assert gone.count() == 2


def test_admission_stream_over_several_batches(spark, tmp_path):
    rows = [(i, "k", 1_700_000_000 + 20 * i) for i in range(12)]
    schema = "id int, k string, s bigint"
    stream = stream_files(spark, tmp_path / "in", [rows[:5], rows[5:9], rows[9:]], schema).withColumn("ts", F.timestamp_seconds("s"))
    beats = str(tmp_path / "beats")
    decided = jobs.admission_stream(stream, "k", "ts", "id", 2, 60, beats=runner.beats(spark, beats))
    got = runner.append(decided, "a", str(tmp_path / "out"), lambda: runner.beat(spark, beats)).collect()
    assert {r.id for r in got if r.admitted} == {0, 1, 4, 5, 8, 9} and len(got) == 12


def test_admission_stream_in_event_time_equals_its_batch_twin(spark, tmp_path):
    """Five micro-batches, shuffled within the lateness; one late row and one
    without a time; warm calls leave no trace."""
    rng = random.Random(4)
    start, schema = 1_700_000_000, "id int, k string, s bigint, temperature double"
    rows = [(i, rng.choice(["a", "b", None]), start + 40 * i, rng.choice([0.1, 0.1, 0.9, None])) for i in range(150)]
    parts = [sorted(rows[i : i + 30], key=lambda _: rng.random()) for i in range(0, 150, 30)]
    late, untimed = (900, "a", start - 90_000, 0.1), (901, "a", None, 0.1)
    parts[4] += [late, untimed]
    stream = stream_files(spark, tmp_path / "in", parts, schema).withColumn("ts", F.timestamp_seconds("s"))
    beats = str(tmp_path / "beats")
    decided = jobs.repeat_stream(stream, "k", "ts", "id", "temperature", 300, beats=runner.beats(spark, beats))
    got = runner.append(decided, "r", str(tmp_path / "out"), lambda: runner.beat(spark, beats)).collect()
    batch = spark.createDataFrame([*rows, untimed], schema).withColumn("ts", F.timestamp_seconds("s"))
    want = admission.suppress_repeats(batch, "k", "ts", "id", "temperature", 300).collect()
    assert sorted((r.id, r.k or "", r.cached) for r in got) == sorted((r.id, r.k or "", r.cached) for r in want)
    assert 0 < sum(r.cached for r in got) < len(got) == 151


class Kept(dict):
    """One state variable, or the timers, of a key; counts what is read."""

    def __init__(self):
        self.read = 0

    exists = dict.__len__
    getCurrentWatermarkInMs = lambda self: self["watermark"]
    listTimers = dict.keys
    registerTimer = lambda self, t: self.update_key(t, None)
    deleteTimer = dict.pop
    removeKey = dict.pop
    get = lambda self: self["value"]

    def update_key(self, key, value):
        self[key] = value

    updateValue = update_key

    def update(self, value):
        self["value"] = value

    def getValue(self, key):
        self.read += len(self[key][0])
        return self[key]


def admitted_behind(lag):
    """Requests that wait until ``lag`` seconds have passed: rows, decisions in
    the order they come, and the waiting requests each batch reads."""
    job = processors.Admission(3, 60, ["k", "id", "admitted", "retry_after"], "bigint")
    job.head, job.waiting, job.handle, clock = Kept(), Kept(), Kept(), Kept()
    rng = random.Random(9)
    rows = [(1_000_000 * (i + rng.randrange(40)), i) for i in range(12_000)]
    decided, reads = [], []
    for start in range(0, 12_000, 50):
        clock["watermark"] = max(0, start - lag) * 1000
        before = job.waiting.read
        pdf = pd.DataFrame([(t, i, True) for t, i in rows[start : start + 50]], columns=["at_micros", "request", "counts"])
        decided += [r for f in job.handleInputRows(("k",), iter([pdf]), clock) for r in f.itertuples(index=False)]
        reads.append(job.waiting.read - before)
        assert len(job.handle) == 1
    clock["watermark"] = 10**9
    decided += [r for f in job.handleExpiredTimer(("k",), clock, None) for r in f.itertuples(index=False)]
    assert not job.head and not job.waiting and not job.handle
    return rows, [tuple(r) for r in decided], reads


def test_a_batch_of_admissions_touches_what_is_due(monkeypatch):
    """Ten times as many requests wait; a batch reads no more of them, and all
    are decided as a plain loop does."""
    monkeypatch.setattr(processors.Admission, "chunk", 64)
    (rows, few, few_reads), (_, many, many_reads) = admitted_behind(500), admitted_behind(5_000)
    window, want = deque(), []
    for t, i in sorted(rows):
        want.append(("k", i, *admission.step(window, t, 3, 60_000_000)))
    assert few == many == want
    assert max(many_reads) <= 1.1 * max(few_reads) and max(many_reads) < 500


def test_streams_read_tables_that_are_folders(spark, tmp_path):
    spark.range(6).repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    pa_file = tmp_path / "one.parquet"
    spark.range(4).toPandas().to_parquet(pa_file)
    for table, n in (("parts", 6), ("one", 4)):
        assert runner.append(runner.read_table(spark, str(tmp_path), table), table, str(tmp_path / f"out-{table}")).count() == n
    with pytest.raises(Exception):
        runner.read_table(spark, str(tmp_path), "missing")


@pytest.mark.parametrize("entries", [10, 1000, 1001, 2001, 100_000])
def test_triage_of_any_dictionary_is_the_same_in_batch_and_stream(spark, texts, tmp_path, entries):
    own = lexicon(spark)
    more = spark.range(1000, 1000 + max(0, entries - own.count())).select(
        F.col("id").cast("int").alias("entry_no"), F.concat(F.lit("كلمة"), "id").alias("dialect_term"), F.concat(F.lit("qq"), "id").alias("dialect_term_latin"),
        *[F.lit("x").alias(c) for c in lex.FIELDS[2:]])
    every = own.unionByName(more)
    values = USER_PHRASES[::4]
    texts(*values).write.parquet(str(tmp_path / "messages.parquet"))
    stream = runner.read_table(spark, str(tmp_path), "messages")
    got = jobs.triage_stream(stream, every, ["id"], F.lit("english"), "t", str(tmp_path / "out"))
    want = triage.triage_rules(texts(*values), own, ["id"], F.lit("english"))
    assert got.orderBy("id").collect() == want.orderBy("id").collect()


def triaged(spark, texts, script, values):
    return triage.triage_rules(texts(*values), lexicon(spark), ["id"], F.lit(script))


def test_triage_steps(spark, texts):
    values = ["ok", "x" * 2001, "", "رضيع", "i want to die", "my sugar is 500", "صدر يابس", "3andi waja3", "just tired today"]
    got = {r.id: (r.step, r.level, r.used_fallback) for r in triaged(spark, texts, "english", values).collect()}
    assert got == {0: ("vague", "GREEN", False), 1: ("invalid", None, False), 2: ("invalid", None, False), 3: ("blocked", None, False),
                   4: ("blocked", None, False), 5: ("emergency", "RED", False), 6: ("open", "RED", True), 7: ("open", "YELLOW", True), 8: ("open", "YELLOW", True)}


def test_large_dictionary_takes_the_join(spark, texts, monkeypatch):
    inside = triaged(spark, texts, "arabic", USER_PHRASES).orderBy("id").collect()
    monkeypatch.setattr(lex, "LITERAL_KEYS", 3)
    assert lex.symptom_array(lexicon(spark), F.col("text")) is None
    assert triaged(spark, texts, "arabic", USER_PHRASES).orderBy("id").collect() == inside


def test_event_sequence(spark, texts):
    e = triage.triage_events(triaged(spark, texts, "english", ["ok", "I want to die", "my knee clicks"]), ["id"]).orderBy("id", "seq").collect()
    kinds = {i: [r.type for r in e if r.id == i] for i in range(3)}
    assert kinds[1] == ["start", "blocked"]
    for i in (0, 2):
        assert kinds[i][:2] == ["start", "triage_classified"] and kinds[i][-1] == "complete" and set(kinds[i][2:-1]) == {"chunk"}
    copy = {(s, k): t for s, k, t in messages.FALLBACKS}
    assert "".join(r.content for r in e if r.id == 2 and r.content) == copy["english", "YELLOW"]
    assert "".join(r.content for r in e if r.id == 0 and r.content) == copy["english", "CLARIFY"] + " "
    assert [r.follow_up_question for r in e if r.id == 0][-1] == copy["english", "CLARIFY"]


def test_model_outputs(spark, texts):
    df = texts("my knee clicks", "my knee clicks", "my knee clicks", "my sugar is 500", "ok")
    outputs = spark.createDataFrame([
        (0, '{"triage_level": "GREEN", "possible_conditions": ["sprain"], "recommended_actions": []}', "You have a sprain."),
        (1, '{"triage_level": "GREEN", "possible_conditions": ["sprain"], "recommended_actions": ["rest"]}', None),
        (2, None, "ignored"), (3, None, None), (4, None, " Where? ")], "id int, verdict_text string, reply_text string")
    got = {r.id: r for r in triage.triage_with_model(df, outputs, lexicon(spark), ["id"], F.lit("english")).collect()}
    notice = {(s, k): n for s, k, n in messages.NOTICES}["english", "routine"]
    assert got[0].reply == f"you may have a sprain.\n\n{notice}" and got[0].conditions == ["sprain"] and got[0].level == "GREEN"
    assert "sprain" in got[1].reply and "rest" in got[1].reply
    assert got[2].used_fallback and got[2].level == "YELLOW" and got[3].level == "RED" and got[3].conditions == ["emergency"]
    assert got[4].needs_clarification and got[4].reply.startswith("Where?")


def test_call_log(spark):
    rows = [(1, 9, "reply", "a", False, "s" * 3000, "p" * 4000, "r" * 5000, 12.349, 5), (2, 9, "reply", "b", True, "s", "p", "r", 1.0, 6), (3, 9, "x", "a", False, "", "p", "r", 1.0, 7)]
    df = spark.createDataFrame(rows, "call_id int, trace_id int, step string, provider string, streamed boolean, system_prompt string, prompt string, response string, latency_ms double, total_tokens int")
    a, b, c = events.call_log(df).orderBy("call_id").collect()
    assert (a.name, len(a.system_prompt), len(a.prompt), len(a.response), a.latency_ms) == ("reply:a", 2000, 3000, 4000, 12.3)
    assert (b.name, b.system_prompt, c.system_prompt) == ("reply:b(stream)", None, None)
    assert events.tokens_per_trace(df).collect()[0].total_tokens == 18


def test_status(spark):
    parts = events.component_status({"a": spark.range(3), "b": spark.range(0)})
    assert {r.component: r.status for r in parts.collect()} == {"a": "ok", "b": "degraded"}
    assert events.overall_status(parts).collect()[0].status == "degraded"
    assert text.is_blank(F.lit("")) is not None
