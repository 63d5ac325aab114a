import numpy as np
import pytest

from symptia.llm import near_copies


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Smallest ids of the components of all pairs with a similarity of 0.8."""
    sets, own = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if own[i] != own[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                low, high = sorted((own[i], own[j]))
                own = [low if o == high else o for o in own]
    return sorted({rows[o][0] for o in own})


def awkward_rows():
    """Short texts with words appended, long ones with similarities around 0.8
    with edits spread evenly, one line many times, and a shared passage."""
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    texts, passage = [], [word() for _ in range(60)]
    for n in range(5, 21):
        for _ in range(8):
            base = [word() for _ in range(n)]
            texts += [" ".join(base), " ".join([*base, word()])]
    for edits in range(2, 12):
        for _ in range(6):
            base = [word() for _ in range(200)]
            copy = list(base)
            for at in np.linspace(3, 196, edits).astype(int):
                copy[at] = word()
            texts += [" ".join(base), " ".join(copy)]
    line = [word() for _ in range(9)]
    for _ in range(12):
        texts.append(" ".join(line * 30 + [word() for _ in range(12)]))
    for _ in range(40):
        texts.append(" ".join(passage + [word() for _ in range(int(rng.integers(1, 30)))]))
    return list(enumerate(texts))


@pytest.mark.parametrize("group", [1024, 6])
def test_near_copies_are_those_of_all_pairs(docs, group, monkeypatch):
    monkeypatch.setattr(near_copies, "GROUP", group)
    rows = awkward_rows()
    want = plain_kept(rows)
    assert len(want) < len(rows) - 100
    assert sorted(r.doc_id for r in near_copies.keep_first(docs(rows)).collect()) == want


def test_sketches_refuse_no_near_copy():
    rng = np.random.default_rng(2)
    for n in (1, 4, 9, 300, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 12).astype(np.uint64)]))
        apart = np.bitwise_count(near_copies.sketch(a).view(np.uint64) ^ near_copies.sketch(b).view(np.uint64)).sum()
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert apart <= differ and near_copies.fine_apart(near_copies.fine_sketch(a), near_copies.fine_sketch(b[: n - n // 6])) <= len(
            set(a.tolist()) ^ set(b[: n - n // 6].tolist()))


def test_forests_grow_linearly_and_try_every_pair():
    rng = np.random.default_rng(3)
    n = 60
    pairs = [(float(rng.random()), a, b, a // 3, b // 3) for a in range(n) for b in range(a + 1, n) if a // 3 != b // 3]
    refused = set()
    for number in range(10):
        offered = near_copies.forests(iter(pairs), refused, near_copies.MORE**number)
        assert len(offered) <= (n // 3 - 1) * near_copies.MORE**number and not refused & set(offered)
        refused |= set(offered)
        if not offered:
            break
    assert refused == {(a, b) for _, a, b, _, _ in pairs}


def test_crowded_group_of_texts_that_are_no_copies(docs, monkeypatch):
    """One hot shingle brings them together; every pair is refused in turn, and
    the near copies among them are found."""
    monkeypatch.setattr(near_copies, "GROUP", 8)
    texts = ["a b c d e"] + [f"a b c d e w{i}" for i in range(30)] + [f"a b c d e w{i} x{i} y{i} z{i}" for i in range(30)]
    texts += [f"{t} more{i}" for i, t in enumerate(texts[40:50])]
    rows = list(enumerate(texts))
    kept = sorted(r.doc_id for r in near_copies.keep_first(docs(rows)).collect())
    assert kept == plain_kept(rows)


def test_fingerprints_link_as_op7_does(docs):
    """Texts that are mostly one line, many times, have one fingerprint, though
    their sets of shingles share less than four fifths."""
    from symptia.llm import simhash

    rows = awkward_rows()
    by_op7 = {r.doc_id for r in simhash.near_duplicates(docs(rows)).collect() if r.component_id != r.doc_id}
    plain = {r.doc_id for r in near_copies.keep_first(docs(rows)).collect()}
    kept = {r.doc_id for r in near_copies.keep_first(docs(rows), fingerprints=True).collect()}
    assert len(by_op7 & plain) >= 11
    assert not kept & by_op7 and kept < plain


def test_texts_held_together_by_fingerprints_are_not_compared(docs, monkeypatch):
    """No text travels for a pair that op7 has linked already."""
    rng = np.random.default_rng(5)
    bases = [" ".join("w%d" % n for n in rng.integers(0, 1 << 30, 300)) for _ in range(8)]
    texts = [t for b in bases for t in (b, b + " more", b + " or less")]
    of = {near_copies.name_of(near_copies.shingle_set(t.encode())): near_copies.fingerprint(t.encode()) for t in texts}
    tried, near = [], near_copies.near
    monkeypatch.setattr(near_copies, "near", lambda pairs, *more: (tried.extend(pairs.collect()), near(pairs, *more))[1])
    kept = [r.doc_id for r in near_copies.keep_first(docs(list(enumerate(texts))), fingerprints=True).collect()]
    assert sorted(kept) == list(range(0, 24, 3))
    assert all((of[r.a] ^ of[r.b]).bit_count() > near_copies.simhash.DISTANCE for r in tried)


def test_groups_of_the_same_texts_are_one(spark):
    groups = {1: (10, 11), 2: (10, 11), 3: (10, 12), 4: (10, 11, 12), 5: (11, 10)}
    rows = [(key, node, len(nodes)) for key, nodes in groups.items() for node in nodes]
    members = near_copies.materialise(spark.createDataFrame(rows, "key long, node long, count long"), "members")
    found = sorted((r.key, r.node, r["count"], r.weight) for r in near_copies.distinct_groups(members).collect())
    assert found == [(1, 10, 2, 3), (1, 11, 2, 3), (3, 10, 2, 1), (3, 12, 2, 1), (4, 10, 3, 1), (4, 11, 3, 1), (4, 12, 3, 1)]


def test_long_texts_with_a_common_passage_are_told_apart_in_tiles(docs, monkeypatch):
    """After the first round no sketch of theirs travels by pair."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join("w%d" % x for x in rng.integers(0, 1 << 30, n))
    passage = words(60)
    texts = [f"{words(2000)} {passage} {words(1000)}" for _ in range(24)]
    texts += [f"{t} {words(300)}" for t in texts[:3]]
    tried, near = [], near_copies.near
    monkeypatch.setattr(near_copies, "near", lambda pairs, *more: (tried.append(pairs.count()), near(pairs, *more))[1])
    rows = list(enumerate(texts))
    assert sorted(r.doc_id for r in near_copies.keep_first(docs(rows)).collect()) == plain_kept(rows) == list(range(24))
    assert sum(tried[1:]) <= 3
