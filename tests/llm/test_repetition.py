import random
import re

import numpy as np
import pytest

from symptia.llm import repetition
from tests.llm.conftest import EDGES

BLANK = "[^\x20\x09-\x0d]+"


def plain(text, least):
    text = text or ""
    words = [m.group() for m in re.finditer(BLANK, text)]
    at = [m.span() for m in re.finditer(BLANK, text)]
    n = len(words)

    def windows(size):
        found = {}
        for i in range(n - size + 1):
            found.setdefault(tuple(words[i : i + size]), []).append(i)
        return {k: v for k, v in found.items() if len(v) > 1}

    def inside(size):
        return sorted({i + k for own in windows(size).values() for i in own for k in range(size)})

    longest, repeats = 0, 0
    for size in range(1, n):
        shared = windows(size)
        if not shared:
            break
        longest = size
        for own in shared.values():
            left = {words[i - 1] if i else None for i in own}
            right = {words[i + size] if i + size < n else None for i in own}
            repeats += size >= least and len(left) > 1 and len(right) > 1
    mask = set(inside(least))
    spans = []
    for i in sorted(mask):
        if i - 1 in mask:
            spans[-1]["end"] = at[i][1]
        else:
            spans.append({"start": at[i][0], "end": at[i][1]})
    lines = [line for line in text.split("\n") if re.search(BLANK, line)]
    return {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside(3)), "n_repeats": repeats,
            "covered_words": len(mask), "longest_repeat": longest, "spans": spans}


def some_texts():
    draw = random.Random(3)
    out = ["", " \n", "one", "a a a a a a a a a a a a", "x y z " * 9, "né 漢字 #1|2 < né 漢字 #1|2 <\n\n né\n né\x0b\x85 a b"]
    for letters in (2, 3, 8, 40):
        out += [" ".join(draw.choice("abcdefgh")[: letters] + str(draw.randrange(letters)) for _ in range(draw.randrange(1, 90)))
                .replace("0 ", "0\n") for _ in range(25)]
    return out


@pytest.mark.parametrize("least", [2, 4, 10])
def test_against_windows_one_by_one(least):
    texts = some_texts()
    got = repetition.measure_texts(texts, least)
    for i, text in enumerate(texts):
        want = plain(text, least)
        # a repeat at the very start or end is maximal on that side
        assert {k: v[i] for k, v in got.items()} == want, text


def test_suffixes_are_in_order():
    draw = np.random.default_rng(5)
    for letters in (1, 2, 5):
        symbols = np.append(draw.integers(0, letters, 200), letters)
        order, levels = repetition.suffix_order(symbols)
        assert order.tolist() == sorted(range(201), key=lambda i: symbols[i:].tolist())
        lcp = repetition.common_prefixes(order, levels)
        for a, b, n in zip(order, order[1:], lcp):
            assert (symbols[a : a + n] == symbols[b : b + n]).all() and symbols[a + n] != symbols[b + n]


def test_portions_change_nothing(spark, docs, monkeypatch):
    rows = list(enumerate(some_texts()))
    whole = sorted(repetition.judge(docs(rows)).collect())
    monkeypatch.setattr(repetition, "PORTION", 100)
    assert sorted(repetition.judge(docs(rows)).collect()) == whole


def test_edges_and_extra_columns(edges):
    got = sorted(repetition.judge(edges).collect(), key=str)
    want = [{"doc_id": i, **plain(t, repetition.LEAST)} for i, t in EDGES if i != 7]
    assert len(got) == len(EDGES)
    assert sorted([str({**w, "spans": len(w["spans"])}) for w in want]) == sorted(
        str({k: len(r.spans) if k == "spans" else r[k] for k in ["doc_id", *plain("", 2)]}) for r in got if r.doc_id != 7)
    long = next(r for r in got if r.doc_id == 7)
    assert (long.n_words, long.n_repeat_words, long.longest_repeat, long.base_failed) == (40_000, 40_000, 39_999, True)
    assert long.n_repeats == 39_999 - repetition.LEAST + 1 and not long.kept


def test_limits_decide(spark, docs):
    def fresh(n, name):
        return [f"{name}{i}" for i in range(n)]

    passage = fresh(60, "p")
    texts = {
        1: fresh(400, "a"),                                                     # nothing repeats
        2: [*fresh(300, "b"), *passage[:30], *fresh(5, "c"), *passage[:30]],      # 60 of 365
        3: [*fresh(150, "d"), *passage[:30], *fresh(5, "e"), *passage[:30]],      # 60 of 215
        4: [*fresh(900, "f"), *fresh(101, "g"), "h", *fresh(101, "g")],           # a repeat of 101 words
        5: [*fresh(900, "f"), *fresh(100, "g"), "h", *fresh(100, "g")],
        6: fresh(49, "i"),
        7: [*fresh(80, "j"), *["k", "l", "m"] * 60],
    }
    table = docs([(i, " ".join(w)) for i, w in texts.items()])
    kept = {r.doc_id: r.kept for r in repetition.judge(table).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False, 5: True, 6: False, 7: False}
    out = repetition.keep_varied(table)
    assert out.columns == table.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 5]
    assert repetition.judge(table.filter("false")).collect() == []
