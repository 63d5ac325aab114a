"""Near-duplicate documents by SimHash, found with pigeonring filtering.

A fingerprint's 64 bits lie in five segments on a ring. If two fingerprints
differ in at most four bits, some segment starts a chain whose cumulative
differences stay within their share of the budget: none in the first segment,
at most one in the first two, two in the first three, three in the first four.
A fingerprint is therefore entered under the first two segments of each of the
five chains, and visits the keys that differ by one bit in the second. What
meets under a key must pass the whole chain before the full distance counts.

Where many fingerprints share a key, the chain is followed one segment further
until groups are small or the ring is nearly closed (12 free bits bound a group
then). Within a group only a spanning forest of the links is put out, so a
family of copies costs its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import byte_values, documents, materialise, pieces_of
from symptia.llm.components import EDGES, Forest, components, edge_batch

SHINGLE = 4
DISTANCE = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(int(x) for x in np.cumsum((0, *WIDTHS))[:-1])
MASKS = tuple(((1 << w) - 1) << s for w, s in zip(WIDTHS, SHIFTS))
START_BIT = 60
#: Differences a chain of 1, 2, ... segments may have at most.
BUDGET = tuple(length * DISTANCE // len(WIDTHS) for length in range(1, len(WIDTHS) + 1))
#: Members a group may have before its chain is followed further.
GROUP = 2048
BATCH_BYTES = 8 << 20
ROWS = pa.schema([("key", pa.int64()), ("fp", pa.int64())])


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle as eight big-endian bytes, a row each; a text
    of fewer words is one shingle, one without words none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    last = ends - 1
    if len(words) > shingle:
        starts, last = starts[: 1 - shingle], last[shingle - 1 :]
    else:
        starts, last = starts[:1], last[-1:]
    hashed = xxhash.xxh64_digest
    hashes = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist())])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each the majority over the hashes of all word shingles."""
    rows = shingle_hashes(text, shingle)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 1 << 14):
        counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            found = np.array([fingerprint(t, shingle) for t in byte_values(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return documents(docs, doc_id, text).mapInArrow(run, "doc_id long, fp long")


# --- chains ------------------------------------------------------------------


def chain_key(fps: np.ndarray, start: int, length: int) -> np.ndarray:
    """The chain's segments as a number (at most 52 bits for a chain of four),
    and the start segment in its top bits."""
    key = np.zeros(len(fps), np.uint64)
    for j in range(length):
        s = (start + j) % len(WIDTHS)
        key = (key << np.uint64(WIDTHS[s])) | ((fps & np.uint64(MASKS[s])) >> np.uint64(SHIFTS[s]))
    return key | np.uint64(start << START_BIT)


def _flips(width: int, most: int) -> list[list[int]]:
    """Bit masks of a segment with 0 to ``most`` bits set, by their number."""
    values = np.arange(1 << width)
    ones = np.bitwise_count(values)
    return [values[ones == k].tolist() for k in range(most + 1)]


FLIPS = {w: _flips(w, BUDGET[3]) for w in set(WIDTHS)}


def first_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all chains of two with the fingerprints that stay in or visit
    them. Of two that differ in one bit, the one with a 0 there visits."""
    keys, owners = [], []
    for start in range(len(WIDTHS)):
        own = chain_key(fps, start, 2)
        keys.append(own)
        owners.append(fps)
        second = (start + 1) % len(WIDTHS)
        for bit in range(WIDTHS[second]):
            zero = (fps >> np.uint64(SHIFTS[second] + bit)) & np.uint64(1) == 0
            keys.append(own[zero] | np.uint64(1 << bit))
            owners.append(fps[zero])
    return np.concatenate(keys), np.concatenate(owners)


def longer_keys(keys: np.ndarray, fps: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The members of crowded chains spread over the chains one segment longer
    that they may still share with others."""
    out_keys, out_fps = [], []
    for start in range(len(WIDTHS)):
        mine = keys >> np.uint64(START_BIT) == start
        if not mine.any():
            continue
        key, fp = keys[mine], fps[mine]
        used = np.bitwise_count(key ^ chain_key(fp, start, length))
        s = (start + length) % len(WIDTHS)
        segment = (fp & np.uint64(MASKS[s])) >> np.uint64(SHIFTS[s])
        for spent in range(BUDGET[length - 1] + 1):
            k, f, g = key[used == spent], fp[used == spent], segment[used == spent]
            for flip in [x for group in FLIPS[WIDTHS[s]][: BUDGET[length] - spent + 1] for x in group]:
                chain = k ^ np.uint64(start << START_BIT)
                out_keys.append((chain << np.uint64(WIDTHS[s])) | (g ^ np.uint64(flip)) | np.uint64(start << START_BIT))
                out_fps.append(f)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *out_keys]), np.concatenate([none, *out_fps])


def linked(key: int, fps: np.ndarray, length: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints that meet under
    a chain, at least one of each pair belonging to it."""
    fps = np.unique(fps)
    start = key >> START_BIT
    home = chain_key(fps, start, length) == np.uint64(key)
    order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
    fps, n_home = fps[order], int(home.sum())
    forest, links = Forest(), []
    names = fps.view(np.int64).tolist()
    for i in range(n_home):
        rest = fps[i + 1 :]
        apart = rest ^ fps[i]
        spent = np.zeros(len(rest), np.uint8)
        near = np.arange(len(rest))
        for j in range(len(WIDTHS)):
            s = (start + j) % len(WIDTHS)
            spent = spent + np.bitwise_count(apart & np.uint64(MASKS[s]))
            within = spent <= BUDGET[j]
            near, apart, spent = near[within], apart[within], spent[within]
        for k in near.tolist():
            if forest.join(names[i], names[i + 1 + k]):
                links.append((names[i], names[i + 1 + k]))
    return links


FOUND = pa.schema([*EDGES, ("crowded", pa.bool_())])


def _grouped(length: int, most: int | None):
    """Links within the groups of a partition sorted by key. Of a group with
    more than ``most`` members only the key is told, as crowded; its members
    stream by without being held."""

    def close(keys: np.ndarray, fps: np.ndarray, over: int | None) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
        ends = np.append(starts[1:], len(keys))
        edges, crowded = [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            if most and (b - a > most or keys[a] == over):
                crowded.append((int(keys[a : a + 1].view(np.int64)[0]), 0))
            elif b - a > 1:
                edges += linked(int(keys[a]), fps[a:b], length)
        batch = edge_batch(edges + crowded)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([False] * len(edges) + [True] * len(crowded))], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.zeros(0, np.uint64)
        over = None
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy().view(np.uint64)])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if len(keys):
                whole = int(np.searchsorted(keys.view(np.int64), keys[-1:].view(np.int64)[0]))  # the last group may go on
                yield close(keys[:whole], fps[:whole], over)
                keys, fps = keys[whole:], fps[whole:]
                if most and len(keys) > most:
                    over, keys, fps = keys[0], keys[:1], fps[:1]
        yield close(keys, fps, over)

    return run


def _rows(derive):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, 1 << 18):
            keys, fps = derive(*(c.to_numpy().view(np.uint64) for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], schema=ROWS)

    return run


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints (one column ``fp``, each once) at most
    ``DISTANCE`` bits apart; as many as connect what is connected."""
    rows, edges = distinct.select("fp").mapInArrow(_rows(first_keys), "key long, fp long"), None
    for length in (2, 3, 4):
        met = rows.repartition("key").sortWithinPartitions("key").mapInArrow(
            _grouped(length, GROUP if length < 4 else None), "a long, b long, crowded boolean")
        found = materialise(met, "links")
        near = found.filter(~F.col("crowded")).select("a", "b")
        edges = near if edges is None else edges.unionByName(near)
        crowded = found.filter("crowded").select(F.col("a").alias("key")).distinct()
        if crowded.isEmpty():
            break
        rows = rows.join(crowded, "key", "left_semi").select("key", "fp").mapInArrow(
            _rows(lambda keys, fps, n=length: longer_keys(keys, fps, n)), "key long, fp long")
    return edges


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Two rows are linked when their fingerprints differ in at most four bits;
    a component is named by its smallest doc_id. A null or blank text has
    fingerprint zero and is linked like any other; a text of fewer words than a
    shingle is one shingle. Null ids name no component unless all its ids are
    null; repeated rows are answered each.
    """
    prints = materialise(fingerprints(docs, shingle, doc_id, text), "fingerprints")
    named = named_components(prints)
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def named_components(prints: DataFrame) -> DataFrame:
    """(fp, component_id) of every distinct fingerprint of a table (doc_id, fp)."""
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct)).withColumnRenamed("node", "fp")
    placed = materialise(
        distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "placed")
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    return placed.join(names, "root").select("fp", "component_id")
