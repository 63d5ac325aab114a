import numpy as np
import pytest

from symptia.llm import neighbours


def brute(rows):
    clean = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None]
    out = {}
    for i, v in clean:
        if i % 100 == 0:
            found = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in clean if j != i)
            out[i] = found[:10]
    return out


def test_keys_walk_neighbouring_cells():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    walk = grid[np.argsort(neighbours.hilbert_keys(grid, 3))]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_and_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 100)
    monkeypatch.setattr(neighbours, "QUERIES", 10)
    vectors = np.random.default_rng(1).normal(size=(4000, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = neighbours.search(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect()
    want = brute(rows)
    assert len(got) == 10 * len(want)
    exact = {(q, j): s for q, found in want.items() for s, j in found}
    hits = [r for r in got if (r.query_id, r.vec_id) in exact]
    assert len(hits) >= 0.9 * len(got)
    assert all(abs(r.score - exact[r.query_id, r.vec_id]) < 1e-12 for r in hits)


def test_copies_ties_and_rows_without_a_vector(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, rng.normal(size=2).round(1).tolist()) for i in range(300)]
    bad = [(5100, None), (5200, [0.0, 0.0]), (5300, [1.0, None]), (5400, [float("nan"), 1.0]), (5500, [float("inf"), 1.0]),
           (5600, [1.0, 2.0, 3.0]), (None, [1.0, 2.0])]
    frame = spark.createDataFrame([*rows, *bad, (0, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = neighbours.search(frame).collect()
    clean = {(i, tuple(v)) for i, v in rows}
    want = {}
    for q, v in clean:
        if q % 100 == 0:
            near = {}
            for j, w in clean:
                if j != q:
                    d = float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()))
                    near[j] = min(near.get(j, np.inf), d)
            want[q] = [(j, d) for d, j in sorted((d, j) for j, d in near.items())[:10]]
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<float>"
    assert neighbours.search(spark.createDataFrame([], schema)).collect() == []
    assert neighbours.search(spark.createDataFrame([(100, [1.0])], schema)).collect() == []
