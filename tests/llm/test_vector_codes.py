import hashlib

import numpy as np
import pyarrow as pa
import pytest

from symptia.llm import vector_codes


def plain(rows, rounds=4):
    """Lloyd's rounds in Python's integers."""
    kept = [(i, label, [int(np.floor(np.float64(x) * 1024)) for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = len(kept[0][2]) // 4
    cut = [[v[p * width : (p + 1) * width] for p in range(4)] for _, _, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0], rows[k][2] if len(rows) == len(kept) else 0))[:256]
    book = [[cut[k][p] for k in first] for p in range(4)]

    def nearest(x, entries):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(entries))

    for number in range(rounds + 1):
        best = [[nearest(x[p], book[p]) for p in range(4)] for x in cut]
        if number < rounds:
            for p in range(4):
                for j in range(len(book[p])):
                    own = [x[p] for x, b in zip(cut, best) if b[p][1] == j]
                    if own:
                        book[p][j] = [sum(c) // len(own) for c in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for part in book for c in part for x in c).encode()).hexdigest()
    error = [sum(d for d, _ in b) for b in best]
    by_label = {}
    for (_, label, _), e in zip(kept, error):
        by_label[label] = by_label.get(label, 0) + e
    return sorted((i, "".join(f"{j:02x}" for _, j in b), e, by_label[label], digest)
                  for (i, label, _), b, e in zip(kept, best, error))


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(*r, "x", 1) for r in rows],
                                 f"vec_id long, label int, embedding array<{kind}>, codes string, error int")


def clustered(n, size, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(40, size))
    return (centres[draw.integers(0, 40, n)] + draw.normal(scale=0.05, size=(n, size))).astype(np.float32)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_plain_rounds(spark, kind):
    rows = [(3 * i - 50, i % 3 or None, v.tolist()) for i, v in enumerate(clustered(600, 8))]
    bad = [(7000, 1, None), (-9000, 1, [None] + [0.5] * 7), (-9001, 2, [float("nan")] * 8), (7001, 1, [float("inf")] * 8)]
    got = vector_codes.compress(frame(spark, rows + bad, kind).repartition(5))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_bounds_spare_work_and_change_nothing(spark):
    vectors = clustered(900, 16, seed=4)
    rows = [(i, 0, v.tolist()) for i, v in enumerate(vectors)]
    coded, book = vector_codes.train(frame(spark, rows))
    work = [r.measured for r in coded.select("measured").collect()]
    full = 5 * 4 * vector_codes.ENTRIES
    assert max(work) <= full and sum(work) < 0.7 * full * len(work)
    points = vector_codes.quarters(pa.array([v.tolist() for v in vectors]), 16)
    for r in coded.collect():
        apart = ((points[r.vec_id][:, None] - book) ** 2).sum(axis=2)
        assert bytes(r.codes) == bytes(apart.argmin(axis=1).tolist()) and r.error == apart.min(axis=1).sum()


def test_net_displacement_is_tighter_than_drift():
    # an entry that goes away and comes back has not moved
    there = np.zeros((4, 2, 1), np.int64)
    away = there + 50
    net = vector_codes.displacements([there, away, there.copy()], 0, vector_codes.runs(2))
    assert net[0].tolist() == [0, 0] and (net[1] >= 50).all()


def test_ties_copies_and_few_rows(spark):
    rows = [(5, 1, [0.0, 1.0, 2.0, 3.0]), (5, 1, [0.0, 1.0, 2.0, 3.0]), (4, None, [1.0, 1.0, 1.0, 1.0]), (6, None, [0.5, 1.0, 1.5, 2.0])]
    got = sorted(map(tuple, vector_codes.compress(frame(spark, rows)).collect()))
    assert got == plain(rows)
    alike = [(i, None, [0.25] * 4) for i in range(700)]
    assert sorted(map(tuple, vector_codes.compress(frame(spark, alike)).collect())) == plain(alike)


def test_odd_input(spark):
    assert vector_codes.compress(frame(spark, [])).collect() == []
    assert vector_codes.compress(frame(spark, [(1, 1, None)])).collect() == []
    # no id at all, a length that does not divide, empty vectors, huge components
    rows = vector_codes.compress(frame(spark, [(None, 1, [1.0] * 6), (None, 1, [2.0] * 6), (3, 2, [1.0])])).collect()
    assert [(r.vec_id, r.error) for r in rows] == [(None, 0)] * 2 and {r.code for r in rows} == {"00000000", "01010100"}
    empty = vector_codes.compress(frame(spark, [(1, 1, []), (2, 1, [])])).collect()
    assert {(r.code, r.error, r.label_error) for r in empty} == {("00000000", 0, 0)}
    far = vector_codes.compress(frame(spark, [(i, i, [s * 1e300] * 8) for i, s in enumerate((1, -1, 1))], "double")).collect()
    assert sorted(r.code for r in far) == ["00000000", "00000000", "01010101"] and all(r.error == 0 for r in far)
