import os
import random
import zlib

import duckdb
import numpy as np
import pytest

from symptia.llm import langid

SF = "/root/testdata/sf0.01"


def model_of(samples):
    model = []
    for lang, sample in samples.items():
        source, by, target = langid.automaton(sample)
        model.append((lang, max(source + target) + 1, np.array(source, "<i4").tobytes(), np.array(by, np.uint8).tobytes(),
                      np.array(target, "<i4").tobytes()))
    return model


def plain_phrases(sample, text):
    n = 0
    for b in range(0, len(text), langid.BLOCK):
        block, i = text[b : b + langid.BLOCK], 0
        while i < len(block):
            j = i + 1
            while j <= len(block) and block[i:j] in sample:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_are_those_of_plain_matching(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 64)
    rng = random.Random(3)
    samples = {name: np.array([rng.choice((0, 1, 2)) for _ in range(60)], np.uint8) for name in ("x", "y")}
    parser = langid.Parser(model_of(samples))
    texts = ["".join(rng.choice(" abc") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rates = parser.rates(texts)
    for text, own in zip(texts, rates):
        cut = langid.symbols(text)
        for k, name in enumerate(parser.languages):
            assert round(own[k] * len(cut)) == plain_phrases(samples[name].tobytes(), cut.tobytes()), text


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r for r in langid.identify(docs).collect()}
    labels = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(found[i].held_out == (i in set(held)) for i in labels)
    assert sum(found[i].lang_pred == labels[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    assert langid.keep_spoken(docs).count() == len(labels)


def test_edges(spark):
    english, german = "the cat and the other thing were there with them ", "der hund und das andere ding waren dort mit ihnen "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de", 1.0) for i in range(1, 40)]
    rows += [(100, None, "en", 1.0), (101, "", "de", 1.0), (102, " 12 !? ", None, 1.0), (None, english, "en", 1.0), (103, german, None, 1.0),
             (104, "漢字仮名交じり文", "en", 1.0), (104, english * 3000, "en", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    found = langid.identify(docs).collect()
    assert len(found) == len(rows)
    by = {(r.doc_id, round(r.score, 9)): r.lang_pred for r in found}
    assert {by[i, 0.0] for i in (100, 101, 102)} == {"und"}
    assert {r.lang_pred for r in found if r.doc_id == 103} == {"de"} and {r.lang_pred for r in found if r.doc_id is None} == {"en"}
    kept = langid.keep_spoken(docs).collect()
    assert len(kept) == len(rows) - 4 and kept[0].score == 1.0
    none = spark.createDataFrame([(1, "some text", None, 1.0)], docs.schema)
    assert [(r.lang_pred, r.score) for r in langid.identify(none).collect()] == [("und", 0.0)]
    assert langid.keep_spoken(none).count() == 1
    assert langid.identify(docs.limit(0)).collect() == [] and langid.keep_spoken(docs.limit(0)).collect() == []


def test_every_label_is_learned_with_its_whole_budget(spark):
    """Texts under 40 characters, a few long texts, and more labels than 64."""
    rng = random.Random(5)
    alphabets = {f"l{k:02}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 7)) for k in range(70)}
    word = lambda lang: "".join(rng.choice(alphabets[lang]) for _ in range(5))
    rows = []
    for k, lang in enumerate(sorted(alphabets)):
        n, words = (5, 2000) if lang == "l00" else (1600, 4) if lang == "l01" else (8, 40)
        rows += [(1000 * k * 3 + i, " ".join(word(lang) for _ in range(words)), lang) for i in range(n * 5 // 4 + 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = {m[0]: m for m in langid.train(docs)}
    assert set(model) == set(alphabets)
    for lang in ("l00", "l01"):  # a suffix automaton has a state for each symbol at least
        assert model[lang][1] > langid.LEAST_BYTES
    found = {r.doc_id: r.lang_pred for r in langid.identify(docs).collect()}
    own = [(found[i], lang) for i, _, lang in rows if lang in ("l00", "l01", "l69")]
    assert sum(a == b for a, b in own) >= 0.9 * len(own)
