"""Best-fit packing of token sequences by a grouping genetic algorithm.

Documents are tokenised and cut into pieces of at most one sequence. Pieces
are dealt by hash into shares of bounded size. Each share is evolved on several
islands: an island holds a population of packings, crossover injects whole
well-filled sequences of one parent into another, removes the sequences that
would hold a piece twice, and best-fits the displaced pieces again; after each
epoch the elite of an island migrates to the next island of its share. The best
packing of a share wins; its loosely filled sequences are dissolved and packed
again with those of all other shares, so that share borders cost next to
nothing.

Every step is a Spark stage over rows of a few numbers. A task holds one share,
and no stage depends on the number of shares.
"""

from __future__ import annotations

import json
import math
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import Vocabulary, documents, materialise, pieces_of, text_values

CAPACITY = 4096
END_ID = 1
SHARE = 4096  # pieces a share holds on average
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 30
POPULATION = 4
LEVELS = 3
LOOSE = 64  # free tokens from which a sequence is packed again with other shares'
BATCH_BYTES = 8 << 20
REMEMBERED = 600_000
CONTROLS = tuple("\x1c\x1d\x1e\x1f")
STOPS = (".", ",")
LATIN_END = "ɐ"  # letters below keep their form under NFC


# What a tokenizer must be for its words to be encoded one by one.
NORMAL_STEPS = ["NFC", "Replace", "Lowercase"]
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def by_word(spec: dict) -> bool:
    """Whether no token of a tokenizer crosses white space and a word of
    letters is one piece: it drops white space, lower-cases, cuts by ``PIECES``
    and merges bytes."""
    steps = (spec.get("normalizer") or {}).get("normalizers") or []
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec["model"]
    return (
        [s["type"] for s in steps] == NORMAL_STEPS and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": PIECES}
        and cuts[0]["invert"] and cuts[0]["behavior"] == "Removed"
        and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        and model["type"] == "BPE" and not model.get("dropout") and not model.get("byte_fallback")
        and not spec.get("post_processor") and all(not t["content"].isalpha() for t in spec["added_tokens"]))


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary:
    itself if it is printed, else the next from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids of texts, as little-endian 32-bit numbers.

    Where :func:`by_word` holds, a word's ids do not depend on its neighbours,
    so texts are encoded word by word and words are remembered; a word of plain
    letters needs nothing but the merges. With any other tokenizer texts are
    encoded whole.
    """

    def __init__(self, content: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(content)
        self.tokenizer.encode_special_tokens = True
        self.apart = by_word(json.loads(content))
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.stops = {stop: self.packed(self.ids(stop)) for stop in STOPS}
        self.known = Remembered(self.word_ids)

    def ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def packed(ids: list[int]) -> bytes:
        own = array("I", ids)
        if sys.byteorder != "little":
            own.byteswap()
        return own.tobytes()

    def stem_ids(self, stem: str) -> bytes:
        """Ids of lower-cased plain letters."""
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.letters)
        return self.packed([token.id for token in self.merges.tokenize(stem)])

    def word_ids(self, word: str) -> bytes:
        stem, stop = (word[:-1], self.stops[word[-1]]) if word[-1] in self.stops else (word, b"")
        if not (stem.isalpha() and max(stem) < LATIN_END and "İ" not in stem):
            return self.packed(self.ids(word))
        low = stem.lower()
        if low == word:
            return self.stem_ids(low)
        return self.known[low] + stop

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out, of = [], self.known.__getitem__
        for text in texts:
            # white space to Python but not to the tokenizer: such a text goes whole
            if not self.apart or any(c in text for c in CONTROLS):
                out.append(self.packed(self.ids(text)))
            else:
                out.append(b"".join(map(of, text.split())))
                if len(self.known) > REMEMBERED:
                    self.known.clear()
        return out


class Remembered(dict):
    """Words and their ids; a word that is new is encoded on being asked for."""

    def __init__(self, encode: Callable[[str], bytes]):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        own = self[word] = self.encode(word)
        return own


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: place (numbers the rows of the
    table), doc_id, piece, start, length, ids_crc32, and the ids if asked for.
    """
    shared = Vocabulary(docs.sparkSession, tokenizer)
    last = np.asarray([end_id], "<u4").tobytes()
    fields = [("place", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.kept(WordIds)
        for batch in pieces_of(batches, BATCH_BYTES):
            rows = []
            encoded = words.encode_all(text_values(batch.column(2)))
            for place, own_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), encoded):
                data = body + last
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((place, own_id, piece, at // 4, len(part) // 4, zlib.crc32(part), *[part] * with_ids))
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=schema)

    numbered = documents(docs, doc_id, text).select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    return numbered.mapInArrow(run, "place long, doc_id long, piece int, start long, length long, ids_crc32 long"
                               + ", ids binary" * with_ids)


class Bins:
    """Open sequences found by free space; the tightest that fits is next."""

    def __init__(self, free: np.ndarray):
        self.free = free.tolist()
        self.by_free: dict[int, list[int]] = {}
        self.mask = 0
        for b, f in enumerate(self.free):
            self._put(b, f)

    def _put(self, b: int, free: int) -> None:
        if free:
            self.by_free.setdefault(free, []).append(b)
            self.mask |= 1 << free

    def place(self, length: int, capacity: int) -> int:
        fitting = self.mask >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            stack = self.by_free[free]
            b = stack.pop()
            if not stack:
                self.mask ^= 1 << free
        else:
            free, b = capacity, len(self.free)
            self.free.append(capacity)
        self.free[b] = free - length
        self._put(b, free - length)
        return b


def best_fit(lengths: np.ndarray, labels: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Labels with the pieces of ``loose`` (in this order) put into the
    sequences the other pieces leave; sequences are numbered from 0 again."""
    kept = np.ones(len(lengths), bool)
    kept[loose] = False
    out = np.full(len(lengths), -1, np.int64)
    used, out[kept] = np.unique(labels[kept], return_inverse=True)
    free = capacity - np.bincount(out[kept], lengths[kept], len(used)).astype(np.int64)
    bins = Bins(free)
    out[loose] = [bins.place(length, capacity) for length in lengths[loose].tolist()]
    return out


def fitness(lengths: np.ndarray, labels: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the sequences: full ones beside empty ones beat
    many half-filled ones."""
    fill = np.bincount(labels, lengths) / capacity
    return float((fill * fill).mean())


def crossover(lengths, left, right, capacity, rng) -> np.ndarray:
    """Whole well-filled sequences of ``right`` injected into ``left``."""
    fill = np.bincount(right, lengths)
    good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
    chosen = rng.choice(good, max(1, len(good) // 8), replace=False)
    taken = np.isin(right, chosen)
    broken = np.isin(left, left[taken])
    child = np.where(taken, left.max() + 1 + right, left)
    return _refit(lengths, child, broken & ~taken, capacity)


def mutate(lengths, labels, capacity, rng) -> np.ndarray:
    """Dissolves the emptiest sequences and a few others."""
    fill = np.bincount(labels, lengths)
    worst = np.argsort(fill, kind="stable")[: max(1, len(fill) // 50)]
    some = rng.integers(0, len(fill), max(1, len(fill) // 25))
    return _refit(lengths, labels, np.isin(labels, np.concatenate([worst, some])), capacity)


def _refit(lengths, labels, loose, capacity) -> np.ndarray:
    at = np.flatnonzero(loose)
    return best_fit(lengths, labels, at[np.argsort(-lengths[at], kind="stable")], capacity)


def founders(lengths: np.ndarray, capacity: int, rng) -> list[np.ndarray]:
    """Best fit in orders drawn at random: whole sequences differ from one to
    the next, so that crossover has something to choose from."""
    none = np.zeros(len(lengths), np.int64)
    return [best_fit(lengths, none, rng.permutation(len(lengths)), capacity) for _ in range(POPULATION)]


def evolve(lengths: np.ndarray, people: list[np.ndarray], capacity: int, rng) -> list[np.ndarray]:
    """The population after some generations, fittest first. Stops as soon as
    one needs no more sequences than the sum of the lengths does."""
    least = math.ceil(int(lengths.sum()) / capacity)
    scored = sorted(((fitness(lengths, p, capacity), i, p) for i, p in enumerate(people)), key=lambda x: (-x[0], x[1]))
    scored = scored[:POPULATION]
    for generation in range(GENERATIONS):
        if scored[0][2].max() + 1 <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = mutate(lengths, crossover(lengths, scored[a][2], scored[b][2], capacity, rng), capacity, rng)
        scored.append((fitness(lengths, child, capacity), len(people) + generation, child))
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:POPULATION]
    return [p for _, _, p in scored]


def _island(capacity: int, level: int, epoch: int):
    """One epoch of one island: its pieces with their labels in each packing."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        share, island = int(key[0]), int(key[1])
        rng = np.random.default_rng([level, share, island, epoch])
        rows = rows.sort_values(["length", "place", "piece"], ascending=[False, True, True])
        own = rows[~rows["migrant"]]
        lengths = own["length"].to_numpy()
        if epoch:
            people = list(np.stack(own["labels"].to_numpy()).T.astype(np.int64))
            guest = rows.loc[rows["migrant"], "labels"]
            people += [np.stack(guest.to_numpy())[:, 0].astype(np.int64)] if len(guest) else []
        else:
            people = founders(lengths, capacity, rng)
        people = evolve(lengths, people, capacity, rng)
        return own.assign(labels=list(np.stack(people).T.astype(np.int32)))

    return run


def _elect(capacity: int, level: int):
    """The fittest packing of a share over its islands, with the places inside
    the sequences."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        best = None
        for island, own in rows.groupby("island"):
            own = own.sort_values(["length", "place", "piece"], ascending=[False, True, True])
            labels = np.stack(own["labels"].to_numpy())[:, 0].astype(np.int64)
            score = fitness(own["length"].to_numpy(), labels, capacity)
            if best is None or score > best[0]:
                best = score, own, labels
        _, own, labels = best
        out = own[["place", "piece", "length"]].assign(label=labels)
        out["offset"] = out.groupby("label")["length"].cumsum() - out["length"]
        out["free"] = capacity - out.groupby("label")["length"].transform("sum")
        out["sequence_id"] = (level << 58) + (int(key[0]) << 24) + out["label"]
        return out.drop(columns="label")

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (unique by place and piece, with
    a length between 1 and ``capacity``).

    A piece as long as a sequence is a sequence of its own. The pieces of a
    sequence lie next to each other from 0 on. An empty table stays empty.
    """
    whole = pieces.filter(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.filter(F.col("length") < capacity).select("place", "piece", "length")
    placed = None
    for level in range(LEVELS):
        shares = math.ceil(left.count() / SHARE)
        if shares == 0:
            break
        dealt = left.select(
            "*", F.pmod(F.xxhash64("place", "piece", F.lit(level)), F.lit(shares)).alias("share"),
            F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(False).alias("migrant"),
            F.lit(None).cast("array<int>").alias("labels"))
        for epoch in range(EPOCHS):
            if epoch:
                guests = dealt.withColumns({"island": (F.col("island") + 1) % ISLANDS, "migrant": F.lit(True),
                                            "labels": F.slice("labels", 1, 1)})
                dealt = dealt.unionByName(guests)
            schema = "place long, piece int, length long, share long, island int, migrant boolean, labels array<int>"
            dealt = dealt.groupBy("share", "island").applyInPandas(_island(capacity, level, epoch), schema)
            if epoch < EPOCHS - 1:
                dealt = materialise(dealt, "islands")
        elected = materialise(dealt.groupBy("share").applyInPandas(
            _elect(capacity, level), "place long, piece int, length long, offset long, free long, sequence_id long"), "packed")
        final = level == LEVELS - 1 or shares == 1
        done = elected if final else elected.filter(F.col("free") <= LOOSE)
        placed = done if placed is None else placed.unionByName(done)
        if final:
            break
        left = elected.filter(F.col("free") > LOOSE).select("place", "piece", "length")
    if placed is None:
        return whole
    packed = pieces.join(placed.select("place", "piece", "sequence_id", "offset"), ["place", "piece"])
    return whole.unionByName(packed.select(*whole.columns))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece of each document: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and the ids themselves if asked for. Any tokenizer
    file will do; those that :func:`by_word` describes are faster.

    Null and empty texts are a single end token; repeated rows are packed
    each; a null doc_id stays null. Only documents longer than a sequence are
    cut. Extra columns are not read.
    """
    pieces = materialise(token_pieces(docs, tokenizer, capacity, end_id, doc_id, text, with_ids), "pieces")
    return pack(pieces, capacity).drop("place")
