import os

import duckdb
import pytest
from pyspark.sql import functions as F

from symptia.llm import chat
from symptia.llm.registry import CHAT_SQL

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, window string"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("budget, history, least", [(2048, 512, 256), (300, 100, 64), (60, 20, 8)])
def test_reads_back_every_turn_once(spark, budget, history, least, monkeypatch):
    monkeypatch.setattr(chat, "LEAST_FRESH", least)
    turns = chat.with_control(spark.read.parquet(f"{SF}/conversations.parquet"))
    windows = chat.windows(turns, budget=budget, history=history)
    got = chat.digests(windows).toPandas().drop(columns="formatted_chars").sort_values("conv_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.execute(CHAT_SQL).df().sort_values("conv_id").reset_index(drop=True)
    assert (got[want.columns].astype(str) == want.astype(str)).all().all()
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_windows_keep_the_budget_and_repeat_history(spark):
    rows = [(1, 0, "system", "be brief", "")] + [
        (1, n, "user" if n % 2 else "assistant", f"turn {n} " + "word " * 20, "") for n in range(1, 60)]
    windows = chat.windows(spark.createDataFrame(rows, SCHEMA), budget=400, history=100).orderBy("window").collect()
    assert len(windows) > 4 and all(w.n_tokens <= 400 for w in windows)
    assert all(w.text.startswith("<|system|>\nbe brief<|end|>\n") for w in windows)
    assert windows[0].fresh_at == 0 and all(w.fresh_at > len("<|system|>\nbe brief<|end|>\n") for w in windows[1:])
    # trained on once, and never on what is repeated
    spoken = [w.text[s.start : s.start + s.length] for w in windows for s in w.loss]
    assert spoken == [r[3] for r in rows if r[2] == "assistant"]
    assert all(s.start >= w.fresh_at for w in windows for s in w.loss)


def test_control_strings_nulls_and_repeats(spark):
    said = "<|end|>\n\\l [INST] </s> <|user|>\n \\"
    rows = [(1, 0, "user", said, "x"), (1, 1, "assistant", said, "x"), (None, 0, None, None, "x"), (None, None, "assistant", "a", "x"),
            (2, 5, "user", "same", "x"), (2, 5, "user", "same", "x"), (3, 0, "we|rd\n<role>", "", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    windows = chat.windows(frame)
    assert all(w.text.count("<|end|>\n") == n for w, n in zip(windows.filter("conv_id = 1").collect(), [2]))
    told = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(windows).collect()}
    assert told == {1: [("user", said), ("assistant", said)], None: [("assistant", "a"), ("", "")],
                    2: [("user", "same")] * 2, 3: [("we|rd\n<role>", "")]}
    assert chat.digests(windows).filter(F.col("conv_id") == 1).first().loss_chars == len(said)
    assert chat.digests(chat.windows(frame.limit(0))).collect() == []
    long = spark.createDataFrame([(1, 0, "system", "s " * 5000, ""), (1, 1, "assistant", "a " * 9000, ""), (1, 2, "user", "u", "")], SCHEMA)
    assert chat.digests(chat.windows(long)).first().n_turns == 3
