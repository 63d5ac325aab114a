import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from symptia.llm import ngram_lm

from .conftest import EDGES

SF = "/root/testdata/sf0.001"


def brute(rows):
    texts = [(t or "").encode().lower().split() + [b"\n"] for _, t in rows]
    held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    words, pairs = Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            words.update(t)
            pairs.update(zip([b"\n"] + t[:-1], t))
    n, v = sum(words.values()), len(words)
    spread = Counter(w for _, w in pairs)
    high, low = (ngram_lm.fit_discounts([sum(c == k for c in x.values()) for k in (1, 2, 3, 4)]) for x in (pairs, spread))
    less = lambda c, d: max(c - (0, *d)[min(c, 3)], 0)
    rest = sum(low[min(c, 3) - 1] for c in spread.values()) / len(pairs) if pairs else 1
    left = defaultdict(float)
    for (a, _), c in pairs.items():
        left[a] += high[min(c, 3) - 1]
    out = []
    for (i, _), t, h in zip(rows, texts, held):
        base = score = 0
        for a, w in zip([b"\n"] + t[:-1], t):
            base += math.log10((words[w] + 1) / (n + v + 1))
            p = less(spread[w], low) / max(1, len(pairs)) + rest / (v + 1)
            score += math.log10(less(pairs[a, w], high) / words[a] + left[a] / words[a] * p if words[a] else p)
        out.append((i, h, len(t), sum(words[w] > 0 for w in t), n, base, score))
    return out


def check(rows, found):
    order = lambda r: (r[0] is not None, r[0] or 0, r[2])
    got, want = sorted(map(tuple, found), key=order), sorted(brute(rows), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_edges(edges, docs):
    check(EDGES, ngram_lm.score_documents(edges).collect())
    assert ngram_lm.score_documents(docs([])).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_same_as_counting_by_hand_and_better_than_unigrams(docs, monkeypatch):
    monkeypatch.setattr(ngram_lm, "PAIRS", 5000)
    monkeypatch.setattr(ngram_lm, "CAP", 20)
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    found = ngram_lm.score_documents(docs(rows).repartition(5)).collect()
    check(rows, found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_chances_after_any_word_sum_to_one(docs):
    texts = ["a b a c", "b a", "c c c a b", "d", "a b"]
    scorer = ngram_lm.Scorer(ngram_lm.train(docs(list(enumerate(texts))).select("text")))
    words = [b"a", b"b", b"c", b"d"]
    ends = scorer.score(words)[3]
    for first in (b"a", b"b", b"c", b"d", b"unseen"):
        # "first w" less what follows w is the chance of w after first; what
        # follows w is told by "w" less its own beginning
        alone = scorer.score([first])[3][0]
        both = scorer.score([first + b" " + w for w in words])[3]
        begin = {w: begins(scorer, w) for w in (first, *words)}
        total = sum(10 ** (x - begin[first] - (e - begin[w])) for x, e, w in zip(both, ends, words))
        unseen = scorer.score([first + b" other"])[3][0] - begin[first] - (scorer.score([b"other"])[3][0] - begins(scorer, b"other"))
        assert total + 10 ** (alone - begin[first]) + 10**unseen == pytest.approx(1, abs=1e-9)


def begins(scorer, word):
    """log10 chance of a word at the beginning of a text."""
    model, ids = scorer.model, scorer.ids([ngram_lm.END, word])
    counts = ngram_lm.gather(scorer.counts, scorer.word_starts, ids, 0, np.float64)
    spread = ngram_lm.gather(scorer.spreads, scorer.span_starts, ids, 0, np.float64)
    weight = ngram_lm.gather(scorer.weights, scorer.span_starts, ids, 1.0, np.float64)
    chance = weight[0] * (ngram_lm.discounted(spread, model.low_discounts) / model.n_pairs + model.low_weight / (model.n_words + 1))[1]
    if ids[1] < model.n_words:
        key = ngram_lm.scramble(ngram_lm.pack(ids[:1], ids[1:], model.width), model.width)
        chance += ngram_lm.discounted(scorer.pair_counts(key).astype(float), model.discounts)[0] / counts[0]
    return math.log10(chance)


def test_scramble_is_one_to_one():
    for width in (16, 18):
        mixed = ngram_lm.scramble(np.arange(1 << width, dtype=np.uint64), width)
        assert len(np.unique(mixed)) == 1 << width and mixed.max() < 1 << width


def test_blocks_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (ngram_lm.expand_sorted(ngram_lm.squeeze_sorted(values)) == values).all()
    assert len(ngram_lm.expand(ngram_lm.squeeze(values[:0]))) == 0
