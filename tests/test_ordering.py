"""Bucketed orderings and admission against plain loops, with one key that
holds most rows."""

import random
from collections import deque

from pyspark.sql import functions as F
import pytest

from symptia.operators import admission, conversation, events, ordering


def hot_rows(n=3000, seed=5):
    rng = random.Random(seed)
    return [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", i * 3 + rng.randrange(3), rng.random() < 0.5) for i in range(n)]


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def test_running_totals_and_streaks(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "id int, k string, t int, bad boolean").withColumn("b", F.floor(F.col("t") / 700))
    got = {r.id: r.total for r in ordering.running_totals(df, ["k"], "b", ["t", "id"], {"total": F.col("id")}).collect()}
    streak = {r.id: r.streak for r in ordering.streaks(df, ["k"], "b", ["t", "id"], F.col("bad")).collect()}
    for group in by_key(rows).values():
        total = run = 0
        for i, _, _, bad in group:
            total, run = total + i, run + 1 if bad else 0
            assert (got[i], streak[i]) == (total, run)


def test_long_streak_crosses_buckets(spark):
    df = spark.range(50).select("id", F.lit("k").alias("k"), F.floor(F.col("id") / 7).alias("b"), (F.col("id") != 3).alias("bad"))
    got = {r.id: r.streak for r in ordering.streaks(df, ["k"], "b", ["id"], F.col("bad")).collect()}
    assert got == {i: i + 1 if i < 3 else i - 3 for i in range(50)}


def test_history_frames_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "BLOCK", 8)
    monkeypatch.setattr(conversation, "TURN_BUCKET", 16)
    rows = [(c, t, "user" if (t + c) % 3 else "assistant", f"{c}.{t}") for c in (1, 2) for t in range(90)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.context_text for r in conversation.history_frames(df).collect()}
    for c in (1, 2):
        users = [r for r in rows if r[0] == c and r[2] == "user"]
        assert len(users) == sum(k[0] == c for k in got)
        for i, r in enumerate(users):
            assert got[c, r[1]] == "\n".join(u[3] for u in users[max(0, i - 4) : i + 1])


@pytest.mark.parametrize("n", [1, 2, 19, 20, 100, 1000])
def test_order_statistic(spark, n):
    rng = random.Random(n)
    values = [float(rng.randrange(40)) / 4 for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "value double").withColumn("g", F.lit(1))
    got = ordering.order_statistic(df, ["g"], "value", F.greatest(F.lit(1), F.floor(F.col("n") * 0.95))).collect()
    assert [r.value for r in got] == [sorted(values)[max(0, int(n * 0.95) - 1)]]


def plain_admission(times, limit, seconds):
    window, out = deque(), []
    for t in times:
        while window and t - window[0] > seconds:
            window.popleft()
        if len(window) >= limit:
            out.append((False, int(seconds - (t - window[0])) + 1))
        else:
            window.append(t)
            out.append((True, 0))
    return out


@pytest.mark.parametrize("limit, seconds, gap", [(1, 60, 40), (3, 60, 25), (10, 60, 5), (2, 900, 700), (3, 3600, 2500)])
def test_admission_matches_a_plain_loop(spark, limit, seconds, gap):
    rng = random.Random(limit * seconds)
    rows, t = [], {"hot": 0, "a": 0, "b": 50}
    for i in range(2500):
        k = "hot" if rng.random() < 0.7 else rng.choice("ab")
        # bursts, steady traffic and long silences
        t[k] += rng.choice([0, 1, gap // 2, gap, gap * 3, gap * 30]) if rng.random() < 0.9 else 1
        rows.append((i, k, 1_700_000_000 + t[k]))
    df = spark.createDataFrame(rows, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.admitted, r.retry_after) for r in admission.admit(df, "k", "ts", "id", limit, seconds).collect()}
    assert len(got) == len(rows)
    for k in t:
        group = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        for r, want in zip(group, plain_admission([g[2] for g in group], limit, seconds)):
            assert got[r[0]] == want


@pytest.mark.parametrize("seconds", [60, 1800])
def test_busy_keys_without_quiet_time_are_divided(spark, seconds, monkeypatch):
    """Steady traffic keeps its phase for ever, so no slice can start afresh;
    still no task may hold the key. Ties, a null key and gaps beside it."""
    monkeypatch.setattr(admission, "BUSY_ROWS", 200)
    rng = random.Random(seconds)
    rows, t = [], {"steady": 0, "dense": 0, None: 0, "gaps": 0}
    for i in range(12_000):
        k = rng.choice(["steady", "steady", "dense", "dense", None, "gaps"])
        t[k] += {"steady": 7, "dense": rng.choice([0, 0, 1, 20]), None: rng.randrange(40), "gaps": rng.choice([1, 50, seconds * 2])}[k]
        rows.append((i, k, 1_700_000_000 + t[k]))
    df = spark.createDataFrame(rows, "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = admission.admit(df, "k", "ts", "id", 1, seconds).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = {r.id: (r.admitted, r.retry_after) for r in got}
    assert len(got) == len(found) == len(rows)
    for k in t:
        group = sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0]))
        assert [found[r[0]] for r in group] == plain_admission([g[2] for g in group], 1, seconds)
    assert len({r.task for r in got if r.k == "steady"}) >= 3


@pytest.mark.parametrize("batch", [7, 100_000])
def test_jump_tables_against_walking(spark, batch):
    """Every slice, handed every time it may be handed, walked row by row."""
    rng, micros, width = random.Random(batch), 17, 100
    rows = []
    for part in range(150):
        k, start = rng.choice([None, "a", "b"]), part * width
        seeds = rng.sample(range(start - micros, start), rng.randrange(micros))
        own = rng.sample(range(start, start + width), rng.randrange(1, 60))
        rows += [(k, part, t, t < start) for t in seeds + own]
    nodes = spark.createDataFrame(rows, "k string, _slice bigint, _t bigint, _seed boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = admission._jump_tables(nodes, "k", micros, width).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    parts = {r[1]: r[0] for r in rows}
    assert len(found) == sum(r[3] for r in rows) + len(parts)
    for r in found:
        x = r._x
        for t in sorted(t for _, part, t, seed in rows if part == r._slice and not seed):
            x = t if t - x > micros else x
        assert r.k == parts[r._slice]
        assert r._y == (x if x >= (r._slice + 1) * width - micros else admission.FREE)


def test_window_edge_still_counts(spark):
    df = spark.createDataFrame([(0, "k", 0), (1, "k", 60), (2, "k", 61)], "id int, k string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: (r.admitted, r.retry_after) for r in admission.admit(df, "k", "ts", "id", 1, 60).collect()}
    assert got == {0: (True, 0), 1: (False, 1), 2: (True, 0)}


def test_repeats_are_counted_from_the_first(spark):
    rows = [(0, "p", 0, 0.1), (1, "p", 400, 0.1), (2, "p", 700, 0.1), (3, "p", 1400, 0.1), (4, "w", 0, 0.9), (5, "w", 1, 0.9)]
    df = spark.createDataFrame(rows, "id int, k string, s bigint, temp double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.cached for r in admission.suppress_repeats(df, "k", "ts", "id", "temp").collect()}
    assert got == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False}


def test_ordered_concat(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), "id", F.concat(F.col("id").cast("string"), F.lit(",")).alias("v"))
    got = events.concat_ordered(df.repartition(7), ["k"], "id", "v", "out", bucket=64).collect()[0].out
    assert got == "".join(f"{i}," for i in range(5000))


def test_rows_without_a_key_or_time_stay(spark):
    rows = [(1, None, 0, 0.1), (2, None, 10, None), (3, "k", None, 0.1), (4, "k", 5, 0.9), (5, None, 20, 0.1), (6, "k", 6, 0.1)]
    calls = spark.createDataFrame(rows, "id int, k string, s bigint, temperature double").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.cached for r in admission.suppress_repeats(calls, "k", "ts", "id", "temperature", 60).collect()}
    assert got == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False}
    decided = {r.id: r.admitted for r in admission.admit(calls, "k", "ts", "id", 1, 60).collect()}
    assert decided == {1: True, 2: False, 3: None, 4: True, 5: False, 6: False}
    totals = ordering.running_totals(calls.fillna(0, ["s"]).withColumn("b", F.lit(None).cast("int")), ["k"], "b", ["id"], {"n": F.lit(1)})
    assert {r.id: r.n for r in totals.collect()} == {1: 1, 2: 2, 5: 3, 3: 1, 4: 2, 6: 3}
    median = ordering.order_statistic(calls, ["k"], "s", F.ceil(F.col("n") / 2))
    assert {r.k: r.value for r in median.collect()} == {None: 10, "k": 5}


def test_context_longer_than_a_block(spark):
    n = ordering.BLOCK + 200
    df = spark.range(1, 2 * n).select(F.lit("k").alias("k"), F.col("id").alias("i"))
    got = {r.i: len(r.c) for r in ordering.preceding(df, ["k"], "i", n, "i", "c").collect()}
    assert got == {i: min(i, n + 1) for i in range(1, 2 * n)}
