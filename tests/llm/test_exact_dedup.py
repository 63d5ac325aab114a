from collections import defaultdict

from symptia.llm import bloom, exact_dedup

from .conftest import EDGES


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").encode().lower()].append(i)
    order = lambda i: (i is not None, i or 0)
    return sorted(((i, max(g, key=order), len(g)) for g in groups.values() for i in g), key=str), len(groups)


def check(rows, frame):
    got = exact_dedup.exact_groups(frame).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    want, n_groups = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size) for r in got), key=str) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept) and sum(r.kept for r in got) == n_groups


def test_edges(edges, docs):
    check(EDGES, edges)
    assert exact_dedup.exact_dedup(docs([])).collect() == []


def test_copies_of_all_sizes(docs):
    rows = [(i, f"text {i % 400 if i % 3 else 'Common'}".upper() if i % 2 else f"text {i % 400 if i % 3 else 'Common'}") for i in range(3000)]
    rows += [(None, "null id"), (None, "NULL ID"), (7, "null id"), (8, "É"), (9, "é")]
    frame = docs(rows).repartition(9)
    check(rows, frame)
    kept = exact_dedup.exact_dedup(frame)
    assert kept.columns == frame.columns and kept.filter("doc_id in (8, 9)").count() == 2


def test_a_full_filter_costs_rows_but_no_answer(docs, monkeypatch):
    monkeypatch.setattr(bloom, "MOST_BITS", 1 << 16)
    monkeypatch.setattr(bloom, "BITS_PER_ROW", 1)
    rows = [(i, f"t{i // 2}") for i in range(20_000)]
    check(rows, docs(rows))
