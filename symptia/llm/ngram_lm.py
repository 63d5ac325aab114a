"""Interpolated modified Kneser-Ney bigram model, counted in Spark.

Counting. Tasks count words, later word pairs, in memory and hand on sorted
blocks cut by hash range, so a frequent word or pair is one entry of a block and
every range is of like size. A range is merged by one task, which writes it as a
sorted array to the shared folder. A word's id is its place among all hashes; a
pair is packed from two ids and scrambled one to one, so that ranges are level.

Scoring. Workers memory-map the arrays and look up each distinct word and pair
of a batch of texts in sorted order. Nothing is broadcast but a few totals.

The arrays are one file per range and are read through the file system that
``spark.checkpoint.dir`` names: mapped where it is a mounted folder, else copied
by the task that needs them to an unnamed local file and mapped there.

The model's order is two. In texts without repeated phrases nearly every longer
n-gram is new, so a third order costs several times the arrays.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import byte_values, documents, materialise, pieces_of, shared_dir

FOLDS, HELD_OUT = 7, 2
#: The end of a text, and what stands before its first word. No word holds
#: white space.
END = b"\n"
BATCH_BYTES = 6 << 20
#: Word pairs a task holds before it hands on a block.
PAIRS = 3_000_000
LEAST_SHARDS = 8
CAP = 255  # counts from here on are kept in a list beside the array


# --- files -------------------------------------------------------------------


def write_array(folder: str, name: str, data: bytes) -> None:
    """Writes a file under a name of its own first, so that a repeated attempt
    of a task never leaves half a file."""
    files, path = pafs.FileSystem.from_uri(folder)
    files.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{os.urandom(6).hex()}"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, f"{path}/{name}")


def map_array(folder: str, name: str, kind: str) -> np.ndarray:
    files, path = pafs.FileSystem.from_uri(folder)
    path = f"{path}/{name}"
    if files.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(files, pafs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with tempfile.TemporaryFile() as copy, files.open_input_stream(path) as data:
        while chunk := data.read(8 << 20):
            copy.write(chunk)
        copy.flush()
        return np.memmap(copy, kind, "r")


# --- words and pairs ---------------------------------------------------------


def tokens(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words of a text and its end."""
    return [*text.lower().split(), END]


def word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), ">u8").astype(np.uint64)


def shard_of(hashes: np.ndarray, bits: int, width: int = 64) -> np.ndarray:
    return (hashes >> np.uint64(width - bits)).astype(np.int64)


MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so multiplying is one to one


def scramble(pairs: np.ndarray, width: int) -> np.ndarray:
    """A one-to-one mix of numbers of ``width`` bits."""
    mask, half = np.uint64((1 << width) - 1), np.uint64(width // 2)
    mixed = pairs
    for factor in MIX:
        mixed = (mixed * np.uint64(factor)) & mask
        mixed = mixed ^ (mixed >> half)
    return (mixed * np.uint64(MIX[0])) & mask


def squeeze(values: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def expand(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], n * 8, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, n).T).view("<u8").ravel()


def squeeze_sorted(values: np.ndarray) -> bytes:
    return squeeze(np.diff(values, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data), dtype=np.uint64)


BLOCK = pa.schema([("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def blocks(keys: np.ndarray, counts: np.ndarray, shards: np.ndarray, n_shards: int) -> pa.RecordBatch:
    """One row per shard of keys sorted within their shard."""
    order = np.argsort(shards, kind="stable")
    keys, counts, shards = keys[order], counts[order], shards[order]
    cuts = np.searchsorted(shards, np.arange(n_shards + 1))
    rows = [(s, squeeze_sorted(keys[a:b]), squeeze(counts[a:b]))
            for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 3, BLOCK)], schema=BLOCK)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts, first)


# --- the model ---------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays are and the few numbers beside them."""

    folder: str
    bits: int  # of the shard number
    offsets: list[int]  # first word id of each shard, and the number of words
    n_tokens: int
    width: int  # bits of a packed pair
    discounts: list[float]
    low_discounts: list[float]
    n_pairs: int
    low_weight: float

    @property
    def n_words(self) -> int:
        return self.offsets[-1]

    @property
    def span(self) -> int:
        """Word ids a statistics file holds."""
        return max(1, -(-self.n_words // (1 << self.bits)))

    @property
    def sub_bits(self) -> int:
        """Bits of a scrambled pair that an index inside a shard stands for, so
        that 32 are left to store."""
        return max(0, self.width - self.bits - 32)


class Words:
    """Ids and statistics of words, from the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        n = 1 << model.bits
        self.hashes = [map_array(model.folder, f"words-{s}", "<u8") for s in range(n)]

    def ids(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, or the number of words for an unknown one."""
        model = self.model
        hashes = word_hash(words)
        order = np.argsort(hashes)
        asked = hashes[order]
        cuts = np.searchsorted(shard_of(asked, model.bits), np.arange((1 << model.bits) + 1))
        found = np.full(len(words), model.n_words, np.int64)
        for s, own in enumerate(self.hashes):
            part = asked[cuts[s] : cuts[s + 1]]
            if len(part) and len(own):
                at = np.minimum(np.searchsorted(own, part), len(own) - 1)
                found[cuts[s] : cuts[s + 1]] = np.where(own[at] == part, at + model.offsets[s], model.n_words)
        out = np.empty(len(words), np.int64)
        out[order] = found
        return out


def gather(arrays: list[np.ndarray], starts: np.ndarray, ids: np.ndarray, fill, kind) -> np.ndarray:
    """Values of ids from arrays that follow each other; ``fill`` past them."""
    order = np.argsort(ids, kind="stable")
    asked = ids[order]
    cuts = np.searchsorted(asked, starts)
    out = np.full(len(ids), fill, kind)
    for i, own in enumerate(arrays):
        a, b = cuts[i], cuts[i + 1]
        if b > a:
            out[order[a:b]] = own[asked[a:b] - starts[i]]
    return out


class Scorer(Words):
    def __init__(self, model: Model):
        super().__init__(model)
        n, folder = 1 << model.bits, model.folder
        self.counts = [map_array(folder, f"counts-{s}", "<u8") for s in range(n)]
        self.spreads = [map_array(folder, f"spreads-{s}", "<u4") for s in range(n)]
        self.weights = [map_array(folder, f"weights-{s}", "<f8") for s in range(n)]
        self.keys = [map_array(folder, f"pairs-{s}", "<u4") for s in range(n)]
        self.times = [map_array(folder, f"times-{s}", "u1") for s in range(n)]
        self.index = [map_array(folder, f"index-{s}", "<u8") for s in range(n)]
        self.often = [map_array(folder, f"often-{s}", "<u8").reshape(-1, 2) for s in range(n)]
        self.word_starts = np.array(model.offsets)
        self.span_starts = np.minimum(np.arange(n + 1) * model.span, model.n_words)

    def pair_counts(self, pairs: np.ndarray) -> np.ndarray:
        """How often each of the sorted scrambled pairs was counted."""
        model = self.model
        out = np.zeros(len(pairs), np.uint64)
        rest = model.width - model.bits
        cuts = np.searchsorted(pairs >> np.uint64(rest), np.arange((1 << model.bits) + 1, dtype=np.uint64))
        for s, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            own = self.keys[s]
            if b == a or not len(own):
                continue
            inside = pairs[a:b] & np.uint64((1 << rest) - 1)
            sub = (inside >> np.uint64(rest - model.sub_bits)).astype(np.int64)
            low = (inside & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            edges = np.flatnonzero(np.concatenate(([True], sub[1:] != sub[:-1], [True])))
            at = np.empty(b - a, np.int64)
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
                start, end = int(self.index[s][sub[i]]), int(self.index[s][sub[i] + 1])
                at[i:j] = start + np.searchsorted(own[start:end], low[i:j])
                at[i:j][at[i:j] >= end] = -1
            hit = (at >= 0) & (own[np.maximum(at, 0)] == low)
            found = np.where(hit, self.times[s][np.maximum(at, 0)], 0).astype(np.uint64)
            many = np.flatnonzero(found == CAP)
            if len(many):
                found[many] = self.often[s][np.searchsorted(self.often[s][:, 0], at[many].astype(np.uint64)), 1]
            out[a:b] = found
        return out

    def score(self, texts: list[bytes]) -> list[np.ndarray]:
        """Per text: tokens, known tokens, base score and score."""
        model = self.model
        n_words = model.n_words
        codes, ends, names = sequence(texts)
        ids = self.ids(names)
        seen = gather(self.counts, self.word_starts, ids, 0, np.float64)
        spread = gather(self.spreads, self.span_starts, ids, 0, np.float64)
        weight = gather(self.weights, self.span_starts, ids, 1.0, np.float64)
        low = discounted(spread, model.low_discounts) / max(1, model.n_pairs) + model.low_weight / (n_words + 1)
        own, before = codes[1:], codes[:-1]
        base = np.log10((seen + 1) / (model.n_tokens + n_words + 1))[own]
        left, right = ids[before], ids[own]
        chance = weight[before] * low[own]
        both = np.flatnonzero((left < n_words) & (right < n_words))
        if len(both):
            packed = scramble(pack(left[both], right[both], model.width), model.width)
            distinct, back = np.unique(packed, return_inverse=True)
            count = self.pair_counts(distinct).astype(np.float64)[back]
            chance[both] += discounted(count, model.discounts) / np.maximum(seen[before[both]], 1)
        starts = np.concatenate(([0], ends[:-1]))
        return [ends - starts, np.add.reduceat((seen[own] > 0).astype(np.int64), starts),
                np.add.reduceat(base, starts), np.add.reduceat(np.log10(chance), starts)]


def pack(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    return (left.astype(np.uint64) << np.uint64(width // 2)) | right.astype(np.uint64)


def discounted(counts: np.ndarray, discounts: list[float]) -> np.ndarray:
    """Counts less the discount of their class (1, 2, 3 and more)."""
    table = np.array([0.0, *discounts])
    return np.maximum(counts - table[np.minimum(counts, 3).astype(np.int64)], 0)


def sequence(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The tokens of texts one after another, numbered, behind one leading end;
    where each text ends among them; and the words by number."""
    numbers: dict[bytes, int] = {END: 0}
    codes, ends = [0], []
    number = numbers.setdefault
    for text in texts:
        codes += [number(w, len(numbers)) for w in tokens(text)]
        ends.append(len(codes) - 1)
    return np.array(codes, np.int64), np.array(ends, np.int64), list(numbers)


def fit_discounts(n: list[int]) -> list[float]:
    """Discounts for counts of 1, 2, and 3 or more from how many entries were
    counted once to four times; halves where a class is empty."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [d if 0 < d <= k else 0.5 for d, k in zip(found, (1, 2, 3))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("held_out")).select("text")


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def block() -> pa.RecordBatch:
            hashes = word_hash(list(held))
            order = np.argsort(hashes)
            counts = np.fromiter(held.values(), np.uint64, len(held))[order]
            return blocks(hashes[order], counts, shard_of(hashes[order], bits), 1 << bits)

        for batch in pieces_of(batches, BATCH_BYTES):
            codes, _, names = sequence(byte_values(batch.column(0)))
            for word, count in zip(names, np.bincount(codes[1:], minlength=len(names)).tolist()):
                if count:
                    held[word] = held.get(word, 0) + count
            if len(held) > PAIRS // 4:
                yield block()
                held = {}
        if held:
            yield block()

    return run


def _merge_words(folder: str):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = merged([expand_sorted(k) for k in rows["keys"]], [expand(c) for c in rows["counts"]])
        write_array(folder, f"words-{key[0]}", hashes.astype("<u8").tobytes())
        write_array(folder, f"counts-{key[0]}", counts.astype("<u8").tobytes())
        return pd.DataFrame({"shard": [key[0]], "n_words": [len(hashes)], "n_tokens": [int(counts.sum())]})

    return run


def _count_pairs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n = None, [], 0

        def block() -> pa.RecordBatch:
            # the leading zero of the arrays keeps empty blocks out
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            shards = shard_of(scramble(keys, model.width), model.bits, model.width)
            return blocks(keys, counts.astype(np.uint64), shards, 1 << model.bits)

        for batch in pieces_of(batches, BATCH_BYTES):
            if not batch.num_rows:
                continue
            words = words or Words(model)
            codes, _, names = sequence(byte_values(batch.column(0)))
            ids = words.ids(names)[codes]
            held.append(pack(ids[:-1], ids[1:], model.width))
            n += len(ids)
            if n > PAIRS:
                yield block()
                held, n = [], 0
        if held:
            yield block()

    return run


def _merge_pairs(model: Model):
    """Writes a shard of pairs; returns what its pairs add to the statistics of
    words, in blocks by range of word ids, and how many were counted 1 to 4
    times."""
    span, n_shards = model.span, 1 << model.bits

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        pairs, counts = merged([expand_sorted(k) for k in rows["keys"]], [expand(c) for c in rows["counts"]])
        mixed = scramble(pairs, model.width)
        order = np.argsort(mixed)
        rest = model.width - model.bits
        inside = mixed[order] & np.uint64((1 << rest) - 1)
        sub = (inside >> np.uint64(rest - model.sub_bits)).astype(np.int64)
        index = np.searchsorted(sub, np.arange((1 << model.sub_bits) + 1))
        often = np.flatnonzero(counts[order] >= CAP)
        folder = model.folder
        write_array(folder, f"pairs-{shard}", (inside & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes())
        write_array(folder, f"times-{shard}", np.minimum(counts[order], CAP).astype("u1").tobytes())
        write_array(folder, f"index-{shard}", index.astype("<u8").tobytes())
        write_array(folder, f"often-{shard}", np.column_stack([often, counts[order][often]]).astype("<u8").tobytes())
        half = np.uint64(model.width // 2)
        left, right = pairs >> half, pairs & np.uint64((1 << int(half)) - 1)
        classes = np.minimum(counts, 3).astype(np.int64)
        out = []
        for kind, ids in ((0, right), (1, left[classes == 1]), (2, left[classes == 2]), (3, left[classes == 3])):
            if len(ids):
                own, times = np.unique(ids, return_counts=True)
                found = blocks(own, times.astype(np.uint64), (own // np.uint64(span)).astype(np.int64), n_shards)
                out += [(kind, *row.values()) for row in found.to_pylist()]
        tally = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5]
        out.append((4, shard, b"", np.append(tally, len(pairs)).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["kind", "shard", "keys", "counts"])

    return run


def _merge_statistics(model: Model):
    """Writes, for a range of words, before how many different words each was
    seen, and the weight its own followers leave to the lower order."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0])
        first = shard * model.span
        size = min(model.span, model.n_words - first)
        table = np.zeros((4, size))
        for kind, keys, counts in zip(rows["kind"], rows["keys"], rows["counts"]):
            table[kind, expand_sorted(keys).astype(np.int64) - first] += expand(counts)
        ids = np.arange(first, first + size)
        starts = np.array(model.offsets)
        arrays = [map_array(model.folder, f"counts-{s}", "<u8") for s in range(len(starts) - 1)]
        seen = gather(arrays, starts, ids, 0, np.float64)
        weight = np.array(model.discounts) @ table[1:] / np.maximum(seen, 1)
        write_array(model.folder, f"spreads-{shard}", table[0].astype("<u4").tobytes())
        write_array(model.folder, f"weights-{shard}", weight.astype("<f8").tobytes())
        tally = np.bincount(np.minimum(table[0], 5).astype(np.int64), minlength=6)
        return pd.DataFrame({f"n{i}": [int(tally[i])] for i in range(1, 5)} | {"more": [int(tally[5])]})

    return run


def train(texts: DataFrame) -> Model:
    """Counts a one-column table of texts (null: empty) and writes the arrays.

    Stages: words, their merge, pairs, their merge, and the statistics of
    words. What comes to the driver is one line per shard.
    """
    spark = texts.sparkSession
    folder = shared_dir(spark, "ngrams")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    bits = max(LEAST_SHARDS, texts.rdd.getNumPartitions()).bit_length()
    block = "shard long, keys binary, counts binary"
    merged_words = texts.mapInArrow(_count_words(bits), block).groupBy("shard").applyInPandas(
        _merge_words(folder), "shard long, n_words long, n_tokens long").collect()
    sizes = [0] * (1 << bits)
    for row in merged_words:
        sizes[row.shard] = row.n_words
    for shard, size in enumerate(sizes):
        if not size:
            for name in ("words", "counts"):
                write_array(folder, f"{name}-{shard}", b"")
    offsets = [int(x) for x in np.cumsum([0, *sizes])]
    half = max(bits, offsets[-1].bit_length(), 8)
    if half > 32:
        raise ValueError("more than 2**32 different words")
    model = Model(folder, bits, offsets, sum(r.n_tokens for r in merged_words), 2 * half, [], [], 0, 1.0)
    statistics = materialise(
        texts.mapInArrow(_count_pairs(model), block).groupBy("shard").applyInPandas(_merge_pairs(model), f"kind int, {block}"),
        "statistics")
    tallies = statistics.filter("kind = 4").collect()
    totals = sum((np.frombuffer(r.counts, "<i8") for r in tallies), np.zeros(5, np.int64)).tolist()
    model.discounts, model.n_pairs = fit_discounts(totals[:4]), totals[4]
    rows = statistics.filter("kind < 4").groupBy("shard").applyInPandas(
        _merge_statistics(model), "n1 long, n2 long, n3 long, n4 long, more long").collect()
    low = [sum(r[i] for r in rows) for i in range(5)]
    model.low_discounts = fit_discounts(low[:4])
    freed = [low[0], low[1], low[2] + low[3] + low[4]]
    model.low_weight = float(np.dot(model.low_discounts, freed)) / model.n_pairs if model.n_pairs else 1.0
    present = {"pairs": {r.shard for r in tallies}, "words": {s for s in range(1 << bits) if s * model.span < model.n_words}}
    for shard in range(1 << bits):
        for names, kind in ((("pairs", "times", "index", "often"), "pairs"), (("spreads", "weights"), "words")):
            if shard not in present[kind]:
                for name in names:
                    write_array(folder, f"{name}-{shard}", b"")
    return model


def held_out(doc_id: str = "doc_id"):
    """Documents the model does not learn from; a null id counts as an empty
    text, and so as a learned one."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score
    (unigrams with one added) and score (the model), both log10.

    Null texts count as empty and have the one token of their end. Repeated
    rows are counted and scored each. Without documents to learn from every
    word has the same chance. Extra columns are not read.
    """
    own = documents(docs, doc_id, text).withColumn("held_out", held_out())
    model = train(_texts(own))
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
              ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in pieces_of(batches, BATCH_BYTES):
            if batch.num_rows:
                scorer = scorer or Scorer(model)
                n, known, base, score = scorer.score(byte_values(batch.column(1)))
                total = np.full(len(n), model.n_tokens)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), *map(pa.array, (n, known, total, base, score))], schema=schema)

    columns = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return own.mapInArrow(run, columns)
