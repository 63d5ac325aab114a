import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from symptia.llm import packing

from .conftest import EDGES

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, found, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4").tobytes()
            want.append((i, piece, at, len(part) // 4, zlib.crc32(part)))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=key) == sorted(want, key=key)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-sum(w[3] for w in want) // capacity)


def test_edges_and_clashing_columns(edges):
    check(EDGES, packing.pack_documents(edges, PATH).collect(), 4096)


def test_empty(docs):
    assert packing.pack_documents(docs([]), PATH).collect() == []


def test_fills_sequences_over_several_shares(docs, monkeypatch):
    monkeypatch.setattr(packing, "SHARE", 100)
    monkeypatch.setattr(packing, "LOOSE", 4)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["word", "Some", "thing,", "été", "can't", "x1y2"]) for _ in range(rng.randint(0, 40)))) for i in range(400)]
    n, least = check(rows, packing.pack_documents(docs(rows), PATH, capacity=100).collect(), 100)
    assert n <= least * 1.02 + 1


def test_ids_travel_when_asked_for(docs):
    row = packing.pack_documents(docs([(1, "one two")]), PATH, with_ids=True).first()
    assert zlib.crc32(bytes(row.ids)) == row.ids_crc32 and len(row.ids) == 4 * row.length


def test_children_hold_every_piece_once():
    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 60, 300))[::-1].copy()
    people = packing.founders(lengths, 100, rng)
    for _ in range(20):
        child = packing.mutate(lengths, packing.crossover(lengths, people[0], people[1], 100, rng), 100, rng)
        fill = np.bincount(child, lengths)
        assert len(child) == 300 and fill.max() <= 100 and fill.min() > 0
    best = packing.evolve(lengths, people, 100, rng)[0]
    assert packing.fitness(lengths, best, 100) >= max(packing.fitness(lengths, p, 100) for p in people)


def test_words_alone_give_the_ids_of_the_text():
    with open(PATH, "rb") as file:
        words = packing.WordIds(file.read())
    rng = random.Random(2)
    parts = ["a", "Été", "İx", "don't", "x.", ".", "1,2", "漢字", "ǅ", "\x1c", "क़", "é", " ", "<|endoftext|>", "'s", "__"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for text, ids in zip(texts, words.encode_all(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == words.ids(text), text


def test_crossover_decides(monkeypatch):
    """From random founders the sequences come down to what the sum of the
    lengths needs; without crossover they do not in the same generations."""
    monkeypatch.setattr(packing, "GENERATIONS", 40)
    start, crossed, alone = 0, 0, 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        lengths = np.sort(rng.integers(60, 1600, 2000))[::-1].copy()
        people = packing.founders(lengths, 4096, rng)
        start += people[0].max() + 1
        crossed += packing.evolve(lengths, people, 4096, np.random.default_rng(seed))[0].max() + 1
        with monkeypatch.context() as without:
            without.setattr(packing, "crossover", lambda lengths, left, right, capacity, rng: left)
            alone += packing.evolve(lengths, people, 4096, np.random.default_rng(seed))[0].max() + 1
    assert crossed < alone < start


def test_other_tokenizers_encode_whole_texts():
    import json

    with open(PATH, "rb") as file:
        spec = json.load(file)
    assert packing.by_word(spec)
    spec["normalizer"]["normalizers"] = spec["normalizer"]["normalizers"][:2]
    words = packing.WordIds(json.dumps(spec).encode())
    assert not words.apart
    texts = ["Some Words, here", "", "été  X"]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode_all(texts)] == [words.ids(t) for t in texts]


def test_remembered_words_are_let_go(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    with open(PATH, "rb") as file:
        words = packing.WordIds(file.read())
    for k in range(6):
        texts = [f"Wörd{'abcdef'[k]}{'ghijkl'[i % 6]}{'mnop'[i % 4]}. and, so" for i in range(15)]
        for text, ids in zip(texts, words.encode_all(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == words.ids(text)
        assert len(words.known) <= 45
