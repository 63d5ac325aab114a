"""Product codes of vectors: integer k-means on each quarter, exact, with
norm-of-sum bounds.

Every quarter of a vector carries its nearest entry and, for each of ``GROUPS``
runs of entries, a lower bound on its distance to all others of that run,
stamped with the round in which it was measured. All codebooks are kept. In a
later round an entry has moved by its true net displacement since the stamp,
which is the norm of the sum of its steps and never more than the sum of their
norms; a run whose bound, less its largest net displacement, is still above the
exact distance to the present entry is not looked at. All other runs are
measured again in integers, so the bounds save work and decide nothing.

Vectors never move between tasks. A round writes each row with its new state
and reads it once more for the sums of its entries; the table before it is
removed then. Codebooks have at most ``ENTRIES`` entries, whatever the table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.functions.rows import join_on
from symptia.llm.common import materialise, pieces_of, release
from symptia.session import BROADCAST_ROWS, broadcast_if_small, spread

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
GROUPS = 8
BATCH_BYTES = 1 << 20
#: Distances are rounded apart by this share before they are compared.
SLACK = 1e-6


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part."""
    v = F.col("vector")
    sound = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")).filter(sound)
    sizes = own.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return own.filter(F.size("vector") == (sizes[0].size if sizes else 0))


def most_component(size: int) -> int:
    """Components beyond this are taken for it, so that the squared distance
    of two vectors fits in 64 bits: 47 million in 64 dimensions."""
    return math.isqrt((1 << 62) // max(1, size)) // 2


def quarters(column: pa.Array, size: int) -> np.ndarray:
    """Vectors as integers, by row, part and place. If the length does not
    divide, the last part is filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)
    most = most_component(size)
    with np.errstate(over="ignore"):
        whole = np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)
    width = -(-size // PARTS)
    padded = np.zeros((len(whole), PARTS * width), np.int64)
    padded[:, :size] = whole
    return padded.reshape(len(whole), PARTS, width)


def _squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, exact: in floating point where all sums stay below
    2**53, else in integers."""
    most = max(np.abs(points).max(initial=0), np.abs(entries).max(initial=0))
    kind = np.float64 if 4 * int(most) ** 2 * max(1, points.shape[1]) < 1 << 53 else np.int64
    points, entries = points.astype(kind), entries.astype(kind)
    cross = points @ entries.T
    return ((points * points).sum(axis=1)[:, None] - 2 * cross + (entries * entries).sum(axis=1)).astype(np.int64)


def displacements(history: list[np.ndarray], part: int, groups: list[np.ndarray]) -> np.ndarray:
    """Per earlier round and run of entries the largest net displacement up to
    the newest codebook, rounded up."""
    moved = np.stack([((history[-1][part] - old[part]).astype(np.float64) ** 2).sum(axis=1) for old in history])
    return np.column_stack([np.sqrt(moved[:, g].max(axis=1)) for g in groups]) * (1 + SLACK)


def _downward(distances: np.ndarray) -> np.ndarray:
    return np.nextafter((distances * (1 - SLACK)).astype(np.float32), np.float32(0))


def runs(entries: int) -> list[np.ndarray]:
    return np.array_split(np.arange(entries), min(GROUPS, entries))


def assign(points: np.ndarray, history: list[np.ndarray], part: int, code: np.ndarray | None, bounds: np.ndarray | None,
           stamps: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entries of some points of a part in the newest codebook: code,
    bounds, stamps, squared distance, and how many distances were measured."""
    entries, now = history[-1][part], len(history) - 1
    groups = runs(len(entries))
    n = len(points)
    far = np.iinfo(np.int64).max
    if code is None:
        code, own = np.zeros(n, np.int64), np.full(n, far)
        bounds, stamps = np.zeros((n, len(groups)), np.float32), np.zeros((n, len(groups)), np.uint8)
        due = np.ones((n, len(groups)), bool)
    else:
        own = ((points - entries[code]) ** 2).sum(axis=1)
        net = displacements(history, part, groups)
        bounds, stamps = bounds.copy(), stamps.copy()
        held = bounds.astype(np.float64) - net[stamps, np.arange(len(groups))]
        due = held <= (np.sqrt(own.astype(np.float64)) * (1 + SLACK))[:, None]
    measured = np.full((n, len(entries)), far)
    for g, members in enumerate(groups):
        rows = np.flatnonzero(due[:, g])
        if len(rows):
            measured[np.ix_(rows, members)] = _squares(points[rows], entries[members])
    measured[np.arange(n), code] = np.minimum(own, measured[np.arange(n), code])
    # of equal distances the first entry counts
    new = measured.argmin(axis=1)
    nearest = measured[np.arange(n), new]
    others = measured
    others[np.arange(n), new] = far
    for g, members in enumerate(groups):
        # the entry that was left joins the others of its run
        left = ~due[:, g] & (new != code) & (code >= members[0]) & (code <= members[-1])
        rows = np.flatnonzero(due[:, g] | left)
        if len(rows):
            low = others[np.ix_(rows, members)].min(axis=1)
            fresh = np.where(low == far, np.float32(np.inf), _downward(np.sqrt(low.astype(np.float64))))
            if now and left.any():
                kept = _downward(np.maximum(held[rows, g], 0))
                fresh = np.where(left[rows], np.minimum(fresh, kept), fresh)
            bounds[rows, g], stamps[rows, g] = fresh, now
    work = due @ np.array([len(g) for g in groups]) if n else np.zeros(0, np.int64)
    return new, bounds, stamps, nearest, work


STATE = "codes binary, bounds binary, stamps binary, error long, measured long"


def _assigned(history, size: int):
    """Rows with their state after one more assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            n = batch.num_rows
            points = quarters(batch.column("vector"), size)
            kinds = {"codes": np.uint8, "bounds": np.float32, "stamps": np.uint8}
            old = {name: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(n, PARTS, -1)
                   for name, kind in kinds.items() if name in batch.schema.names}
            work = np.array(batch.column("measured")) if old else np.zeros(n, np.int64)
            error = np.zeros(n, np.int64)
            new = {name: [] for name in kinds}
            for part in range(PARTS):
                state = (old["codes"][:, part, 0].astype(np.int64), old["bounds"][:, part], old["stamps"][:, part]) if old else (None,) * 3
                code, bounds, stamps, nearest, done = assign(points[:, part], history.value, part, *state)
                for name, values in zip(kinds, (code[:, None], bounds, stamps)):
                    new[name].append(values.astype(kinds[name]))
                error, work = error + nearest, work + done
            packed = [pa.array([row.tobytes() for row in np.stack(new[name], axis=1)] if n else [], pa.binary()) for name in kinds]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("vec_id", "label", "vector")] + packed + [pa.array(error), pa.array(work)],
                ["vec_id", "label", "vector", *kinds, "error", "measured"])

    return run


def _summed(size: int):
    """Per part and entry the number and the sums of its rows in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-size // PARTS)
        total, count = np.zeros((PARTS, ENTRIES, width), np.int64), np.zeros((PARTS, ENTRIES), np.int64)
        for batch in pieces_of(batches, BATCH_BYTES):
            points = quarters(batch.column("vector"), size)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(-1, PARTS)
            for part in range(PARTS if len(codes) else 0):
                order = np.argsort(codes[:, part], kind="stable")
                entries, starts = np.unique(codes[order, part], return_index=True)
                total[part, entries] += np.add.reduceat(points[order, part], starts, axis=0)
                count[part] += np.bincount(codes[:, part], minlength=ENTRIES)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
             pa.array(list(total[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    return run


def moved(rows: DataFrame, book: np.ndarray, size: int) -> np.ndarray:
    """The codebook after each entry went to the floor of its rows' mean;
    entries without rows stay."""
    width = book.shape[2]
    sums = rows.select("vector", "codes").mapInArrow(_summed(size), "part int, entry int, n long, total array<long>")
    sums = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    new = book.copy()
    for row in sums.collect():  # at most PARTS * ENTRIES
        new[row.part, row.entry] = [t // row.n for t in row.total]
    return new


def train(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
          rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, vector, codes, error, measured) after the last
    assignment, and the codebook by part, entry and place.

    A vector that is null or holds a null, NaN or infinite component takes no
    part, nor does one of another length than the most frequent. The codebook
    starts from the smallest non-null ids, copies of an id in the order of
    their vectors. Rows with a null id, equal ids and equal rows are coded like
    all others. Components beyond :func:`most_component` are taken for it.
    ``measured`` counts the distances that were not spared by a bound.
    """
    spark = vectors.sparkSession
    own = usable(vectors, vec_id, vector, label)
    first = own.filter("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(ENTRIES).select("vector").toArrow()["vector"].combine_chunks()
    if not len(first):
        first = own.orderBy("vector").limit(ENTRIES).select("vector").toArrow()["vector"].combine_chunks()
    size = len(first[0]) if len(first) else 0
    history = [np.ascontiguousarray(quarters(first, size).transpose(1, 0, 2))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema)
    state = spread(own)
    for number in range(rounds + 1):
        before = state
        shared = spark.sparkContext.broadcast(history)
        state = materialise(before.mapInArrow(_assigned(shared, size), f"{kinds}, {STATE}"), "codes")
        if number:
            release(before)
        if number < rounds:
            history = [*history, moved(state, history[-1], size)]
    return state, history[-1]


def codebook_digest(book: np.ndarray, size: int) -> str:
    """SHA-256 of all components in decimal, without the places that fill up
    the last part."""
    places = [part[:, : max(0, min(book.shape[2], size - i * book.shape[2]))] for i, part in enumerate(book)]
    return hashlib.sha256(",".join(str(x) for part in places for x in part.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that
    takes part. Null labels are one group; a group whose error exceeds 64 bits
    has a null label_error. An empty table gives no rows."""
    rows, book = train(vectors, vec_id, vector, label)
    lengths = rows.select(F.size("vector").alias("size")).limit(1).collect()
    sums = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    out = join_on(rows.select("vec_id", "label", "codes", "error"), broadcast_if_small(sums, BROADCAST_ROWS), ["label"])
    return out.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error",
        F.lit(codebook_digest(book, lengths[0].size if lengths else 0)).alias("codebooks_sha256"))
