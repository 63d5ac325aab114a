import os

import pytest

import corpus_pipeline
from symptia.llm import langid, pii
from symptia.llm.common import materialise, read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_stages_one_by_one(spark):
    docs = read(spark, SF, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), name)
        seen[name] = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        if name != "packing":
            assert docs.columns == before.columns
    assert all(map(langid.has_letter, seen["exact_copies"].values()))
    texts = list(seen["exact_copies"].items())
    last = {t.encode().lower(): i for i, t in sorted(texts)}
    assert set(seen["near_copies"]) == set(last.values())
    kept = seen["personal_data"]
    gone = seen["near_copies"].keys() - kept.keys()
    for i in gone:
        assert max(similarity(seen["near_copies"][i], t) for j, t in seen["near_copies"].items() if j != i) > 0.7
    pairs = [(i, j) for i in kept for j in kept if i < j and kept[i][:12] == kept[j][:12]]
    assert all(similarity(kept[i], kept[j]) < 0.8 for i, j in pairs)
    assert seen["packing"] == {i: pii.redacted(t) for i, t in kept.items()}
    assert {r.doc_id for r in docs.collect()} == set(kept)


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(rows.columns) and rows.count() > 0


def test_stages_take_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, root long"
    rows = [(1, None, None, None, None, "r", 1), (2, "", "en", "s", 0, "r", 1), (None, "some words here", "en", None, 5, None, None),
            (3, "some words here", "en", "s", 15, "r", 1), (3, "some words here", "en", "s", 15, "r", 1),
            (4, "mail me at a@b.co " + "word " * 20_000, "en", "s", 1, "r", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialise(stage(spark, docs, SF), name)
            assert docs.columns == frame.columns
        left = {r.doc_id: r.n_chars for r in docs.collect()}
        assert left == ({3: 15, 4: len("mail me at [EMAIL] ") + 100_000} if frame.count() else {})
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
