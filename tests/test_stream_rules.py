import functools
import os

import pytest

from checks import flow_rules, stream_rules
from symptia.streaming import runner

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.mark.parametrize("stream, batch", [
    ("stream_admission", "sliding_window_admission"), ("stream_repeat_suppression", "repeat_prompt_suppression")])
def test_times_shuffled_over_micro_batches(spark, tmp_path, monkeypatch, stream, batch):
    """Files not in order of their times, in five micro-batches."""
    spark.read.parquet(f"{SF}/events.parquet").repartition(10, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(runner, "read_table", functools.partial(runner.read_table, files_per_trigger=2))
    got = stream_rules.QUERIES[stream](spark, str(tmp_path))
    want = flow_rules.QUERIES[batch](spark, str(tmp_path)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
