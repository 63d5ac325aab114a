import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from symptia.llm import repeats


def brute(rows, keep_first):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(list)
    for k in sorted(range(len(texts)), key=lambda k: (texts[k][0] or 0)):
        for s in range(len(texts[k][1]) - 199):
            seen[texts[k][1][s : s + 200]].append((k, s))
    covered = [np.zeros(len(b) + 1, int) for _, b in texts]
    for places in seen.values():
        for k, s in places[1 if keep_first else 0 :] if len(places) > 1 else []:
            covered[k][s] += 1
            covered[k][s + 200] -= 1
    out = []
    for (i, b), c in zip(texts, covered):
        gone = np.cumsum(c)[:-1] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.pad(gone.astype(int), 1)) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passages, line = [words(60) for _ in range(3)], words(20)[:120]
    rows = []
    for i in range(80):
        parts = [words(rng.randint(0, 60))]
        if rng.random() < 0.5:
            passage, a = rng.choice(passages), rng.randint(0, 100)
            parts.append(passage[a : a + rng.randint(150, len(passage))])
        if rng.random() < 0.5:
            parts.append(line)
        if rng.random() < 0.2:
            parts.append("a" * rng.randint(100, 700))
        if rng.random() < 0.2:
            parts.append("abc " * rng.randint(30, 200))
        rows.append((i, "|".join([*parts, words(rng.randint(0, 40))])))
    rows += [(200 + i, rows[i][1]) for i in range(6)]
    return [*rows, (300, None), (301, ""), (302, "x" * 199), (303, "y" * 200), (304, "z" * 201), (305, "ü€漢" * 90), (None, rows[3][1])]


@pytest.mark.parametrize("keep_first", [False, True])
def test_same_as_brute_force(docs, rows, keep_first):
    rows = [r for r in rows if r[0] is not None or not keep_first]
    got = repeats.removal_digests(docs(rows), keep_first).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, keep_first)


@pytest.mark.parametrize("keep_first", [False, True])
def test_crowded_anchors_and_portions_of_texts(docs, rows, keep_first, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 8)
    monkeypatch.setattr(repeats, "PORTION", 8)
    monkeypatch.setattr(repeats, "CHUNK", 300)
    rows = [r for r in rows if r[0] is not None]
    got = repeats.removal_digests(docs(rows), keep_first).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, keep_first)


def test_rows_alike_in_id_and_text(docs):
    text = "".join(chr(97 + i * i % 26) for i in range(150)) + "q" * 3 + "".join(chr(97 + i * 7 % 23) for i in range(150))
    rows = [(1, text), (1, text), (2, "short")]
    assert sorted(map(tuple, repeats.removal_digests(docs(rows)).collect()), key=str) == brute(rows, False)
    kept = repeats.remove_repeats(docs(rows), keep_first=True).collect()
    assert sorted(bytes(r.kept).decode() for r in kept) == sorted(t for _, t in rows)


def brute_factors(texts, order, rank):
    """Per suffix the longest match, up to LENGTH bytes, at a smaller rank."""
    share = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    return [max([share(texts[i], texts[j]) for j in range(len(texts)) if rank[j] < rank[i]], default=0) for i in order]


@pytest.mark.parametrize("prints", ["exact", "all alike"])
def test_suffix_order_and_longest_previous_factors(prints):
    rng = random.Random(3)
    for length in (40, 200, 500):
        data = np.array([rng.choice(b"ab") for _ in range(length + repeats.LENGTH)], np.uint8)
        period = rng.randint(1, 60)
        data[length // 4 :] = np.resize(data[:period], len(data) - length // 4)
        start = np.arange(length)
        texts = [data[i : i + repeats.LENGTH].tobytes() for i in start]
        rank = np.array([rng.randint(0, length) for _ in start])  # with ties
        codes = {t: i for i, t in enumerate(set(texts))}
        own = np.array([codes[t] if prints == "exact" else 0 for t in texts], np.uint64)
        order, lcp = repeats.suffix_order(data, start, np.zeros(length, np.int64), rank, own)
        assert [texts[i] for i in order] == sorted(texts)
        assert lcp[0] == 0 and (lcp[1:] == repeats.shared_beginnings(data, start[order[1:]], start[order[:-1]])).all()
        for r in (rank, -rank):
            assert repeats.longest_previous_factors(r[order], lcp).tolist() == brute_factors(texts, order, r)


def test_suffixes_at_different_offsets_share_nothing():
    data = np.frombuffer(b"x" * 300, np.uint8)
    order, lcp = repeats.suffix_order(data, np.array([0, 1, 2]), np.array([1, 2, 1]), np.arange(3), np.array([5, 6, 5], np.uint64))
    assert order.tolist() == [0, 2, 1] and lcp.tolist() == [0, repeats.LENGTH, 0]


def test_edges(edges, docs):
    got = {r.doc_id: r.n_removed for r in repeats.removal_digests(edges).collect()}
    assert got[1] == got[2] == got[4] == 0 and got[7] == 200_000 and got[8] == 30_000
    assert repeats.removal_digests(docs([])).collect() == []
