import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symptia.llm import near_copies, simhash
from symptia.llm.components import Forest, components

from .conftest import EDGES


def signed(x):
    return int(np.uint64(x).view(np.int64))


def brute(fps):
    """The smallest position of each fingerprint's component."""
    distinct, forest = np.unique(fps), Forest()
    for i, fp in enumerate(distinct):
        for k in np.flatnonzero(np.bitwise_count(distinct[i + 1 :] ^ fp) <= 4):
            forest.join(int(fp), int(distinct[i + 1 + k]))
    first = {}
    for i, fp in enumerate(fps):
        first.setdefault(forest.root(int(fp)), i)
    return {signed(fp): first[forest.root(int(fp))] for fp in distinct}


def scattered(rng, base, most, width=64):
    out = base.copy()
    for _ in range(most):
        out ^= np.uint64(1) << rng.integers(0, width, len(base), dtype=np.uint64)
    return out


@pytest.mark.parametrize("group, width", [(2048, 64), (20, 64), (20, 22)])
def test_components_are_those_of_brute_force(spark, monkeypatch, group, width):
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = np.random.default_rng(group + width)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64) * np.uint64(2)
    family = scattered(rng, np.full(600, base[0]), 5, width)
    fps = np.concatenate([base, *(scattered(rng, base, k) for k in (3, 4, 5, 6)), family])
    prints = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long")
    assert {r.fp: r.component_id for r in simhash.named_components(prints).collect()} == brute(fps)


def test_every_pair_within_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    near = scattered(rng, base, 4)
    for a, b in zip(base[:400], near[:400]):
        keys, owners = simhash.first_keys(np.array([a, b], np.uint64))
        shared = [k for k in keys[owners == a] if k in keys[owners == b]]
        assert a == b or any(simhash.linked(int(k), np.array([a, b], np.uint64), 2) for k in shared)


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_documents(edges, docs):
    got = simhash.near_duplicates(edges).collect()
    assert sorted((r.doc_id or 0, int(r.fingerprint, 16)) for r in got) == sorted((i or 0, plain_fingerprint(t)) for i, t in EDGES)
    assert {r.doc_id: r.component_id for r in got if r.doc_id in (1, 2, 3, 5)} == {1: 1, 2: 1, 3: 1, 5: 5}
    assert simhash.near_duplicates(docs([])).collect() == []


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (-3, 2000)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(300)}, -3: -3, 2000: -3}
    assert {r.node: r.root for r in components(frame).collect()} == want
    assert components(frame.limit(0)).collect() == []


def near_copy_rows():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    passage = [word() for _ in range(80)]
    rows = []
    for g in range(25):
        text = [word() for _ in range(int(rng.integers(150, 400)))]
        if g % 2:
            text = text[:60] + passage + text[60:]
        rows.append((g * 10, " ".join(text)))
        for c in range(1, 4):
            copy = list(text)
            for at in rng.choice(len(copy), max(1, len(copy) // 120), replace=False):
                copy[at] = word()
            rows.append((g * 10 + c, " ".join(copy)))
    return rows


@pytest.mark.parametrize("group", [8192, 10])
def test_near_copies_keep_one_of_each_group(docs, group, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", group)
    rows = near_copy_rows()
    kept = near_copies.keep_first(docs(rows + [(1000, "something else altogether"), (1001, "something else altogether")]))
    assert sorted(r.doc_id for r in kept.collect()) == [*range(0, 250, 10), 1000]
    assert kept.columns == ["doc_id", "text", "row", "place", "kept"]


def test_near_copies_edges(edges, docs):
    assert sorted((r.doc_id or 0) for r in near_copies.keep_first(edges).collect()) == [0, 1, 4, 5, 6, 7, 8]
    assert near_copies.keep_first(docs([])).select(F.count("*")).first()[0] == 0
