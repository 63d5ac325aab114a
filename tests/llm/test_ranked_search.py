import math
import random
import re
import string

import pyarrow as pa
import pytest

from symptia.llm import ranked_search
from tests.llm.conftest import EDGES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def split(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items):
    """Every document against every item."""
    words = [(i, split(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in words:
            score = 0
            for t in set(split(text)):
                tf = w.count(t)
                if tf:
                    m = 10 + (90 * len(w) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, f[3], -f[0]) for k, f in enumerate(sorted(found)[:10], 1)]
    return sorted(out, key=str)


def prose(n, seed=1):
    draw = random.Random(seed)
    words = [f"{draw.choice('Ab né漢'.split())}{i}" for i in range(400)]
    return [" ".join(draw.choices(words, [1 / (k + 1) for k in range(400)], k=draw.randrange(1, 120))) for _ in range(n)]


def items_of(spark, items):
    return spark.createDataFrame([(i, t, 0, 0.5) for i, t in items], "item_id long, text string, doc_id int, score double")


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(ranked_search, "BUCKET", 20)
    monkeypatch.setattr(ranked_search, "ENTRIES", 300)
    monkeypatch.setattr(ranked_search, "ITEMS", 15)


def test_against_a_full_scan(spark, docs, small):
    texts = prose(700)
    rows = [(i, t) for i, t in enumerate(texts)] + [(5000 + i, texts[3]) for i in range(200)]
    items = [(i, " ".join(t.split()[:25]) + "; " + t[:9]) for i, t in enumerate(texts[:40])]
    got = ranked_search.search(docs(rows).repartition(7), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, items)


def test_odd_rows(spark, docs, small):
    rows = [*EDGES, (8, None), (9, "x X x-x"), (None, "no ID here")]
    items = [(1, "x id HERE twice"), (1, "x id HERE twice"), (None, "漢字 çödé long"), (2, None), (3, ""), (4, "nowhere to be found"), (5, "..."),
             (6, "a" * 30_000)]
    assert sorted(map(tuple, ranked_search.search(docs(rows), items_of(spark, items)).collect()), key=str) == plain(rows, items)
    assert ranked_search.search(docs(rows), items_of(spark, [])).collect() == []
    assert ranked_search.search(docs([]), items_of(spark, items)).collect() == []


def test_bounds_leave_no_better_document_out_and_spare_most():
    """Survivors of a bucket hold all documents at or above the mark."""
    import numpy as np

    draw = np.random.default_rng(2)
    rows = []
    for i in range(300):
        places = np.sort(draw.choice(60, draw.integers(1, 25), replace=False))
        values = draw.integers(1, 900_000, len(places))
        rows.append((i, places.tolist(), values.tolist(), float((values.astype(float) ** 2).sum())))
    rows.sort(key=lambda r: -r[3])
    batch = pa.RecordBatch.from_pydict({
        "doc_id": [r[0] for r in rows], "squares": [r[3] for r in rows],
        "places": pa.array([r[1] for r in rows], pa.list_(pa.int32())), "impacts": pa.array([r[2] for r in rows], pa.list_(pa.int32()))})
    bucket = ranked_search._Bucket(next(ranked_search._bucketed(iter([batch]))), 0)
    spared = total = 0
    for _ in range(40):
        places = draw.choice(60, 8, replace=False)
        item = ranked_search._Item(places, draw.integers(0, 9000, 8))
        weights = dict(zip(item.places.tolist(), item.weights.tolist()))
        exact = [sum(weights.get(p, 0) * v for p, v in zip(r[1], r[2])) for r in rows]
        mark = sorted(exact)[-10]
        left = bucket.survivors(item, mark)
        assert {k for k, s in enumerate(exact) if s >= mark} <= set(left.tolist())
        assert bucket.scores(item, left, np.zeros(60, np.int64)).tolist() == [exact[k] for k in left]
        spared, total = spared + len(rows) - len(left), total + len(rows)
    assert spared > 0.3 * total
