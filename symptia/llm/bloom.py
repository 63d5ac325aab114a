"""A Bloom filter of what occurs more than once, built over all partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30
SEGMENT_BITS = 1 << 16
# Partitions whose marks of a segment are merged together first, so that no task
# merges one bitmap per partition.
MERGED = 256


def filter_bits(rows: int) -> int:
    """16 bits a row, at most ``MOST_BITS`` (128 MB)."""
    wanted = 1 << max(1, (rows * BITS_PER_ROW - 1)).bit_length()
    return min(MOST_BITS, max(LEAST_BITS, wanted))


def holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all bits of each row are set."""
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)


def _packed(positions: np.ndarray) -> bytes:
    """Sorted positions of a segment, or its bitmap where that is smaller."""
    if len(positions) * 16 < SEGMENT_BITS:
        return positions.astype("<u2").tobytes()
    flags = np.zeros(SEGMENT_BITS, np.uint8)
    flags[positions] = 1
    return np.packbits(flags).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if len(data) * 8 == SEGMENT_BITS:
        return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))
    return np.frombuffer(data, "<u2").astype(np.int64)


def _counted(seen: list[np.ndarray], more: list[np.ndarray]) -> tuple[bytes, bytes]:
    positions, counts = np.unique(np.concatenate(seen), return_counts=True)
    repeated = np.union1d(positions[counts > 1], np.concatenate(more)).astype(np.int64)
    return _packed(positions), _packed(repeated)


def _marks(entries: Callable[[pa.RecordBatch], np.ndarray]):
    """Per partition: for each segment of the filter the bits seen, and those
    seen more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0, np.int64)]
        for batch in batches:
            if batch.num_rows:
                # a row counts once for a bit, however many of its probes hit it
                own = np.sort(entries(batch), axis=1)
                first = np.ones(own.shape, bool)
                first[:, 1:] = own[:, 1:] != own[:, :-1]
                found.append(own[first])
        positions, counts = np.unique(np.concatenate(found), return_counts=True)
        segments, starts = np.unique(positions // SEGMENT_BITS, return_index=True)
        ends = np.append(starts[1:], len(positions))
        rows = [(int(s), positions[a:b] % SEGMENT_BITS, counts[a:b] > 1) for s, a, b in zip(segments, starts, ends)]
        yield pa.RecordBatch.from_pydict(
            {"segment": [r[0] for r in rows], "seen": [_packed(r[1]) for r in rows],
             "more": [_packed(r[1][r[2]]) for r in rows]},
            pa.schema([("segment", pa.int32()), ("seen", pa.binary()), ("more", pa.binary())]))

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    seen, more = _counted([_unpacked(x) for x in rows["seen"]], [_unpacked(x) for x in rows["more"]])
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "seen": [seen], "more": [more]})


def repeated_bits(table: DataFrame, bits: int, entries: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The bitmap of the bits that more than one entry sets. ``entries``
    gives the bits of each entry of a batch, a row of them each."""
    return _bitmap(table, bits, entries, "more")


def seen_bits(table: DataFrame, bits: int, entries: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The bitmap of the bits that any entry sets."""
    return _bitmap(table, bits, entries, "seen")


def _bitmap(table: DataFrame, bits: int, entries: Callable[[pa.RecordBatch], np.ndarray], which: str) -> np.ndarray:
    schema = "segment int, seen binary, more binary"
    marks = table.mapInArrow(_marks(entries), schema)
    merged = (
        marks.withColumn("salt", F.floor(F.spark_partition_id() / MERGED))
        .groupBy("segment", "salt").applyInPandas(lambda rows: _merge(rows), schema)
        .groupBy("segment").applyInPandas(lambda rows: _merge(rows), schema)
    )
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", F.col(which).alias("set")).toLocalIterator():
        flags = np.zeros(SEGMENT_BITS, np.uint8)
        flags[_unpacked(bytes(row.set))] = 1
        at = row.segment * SEGMENT_BITS // 8
        bitmap[at : at + SEGMENT_BITS // 8] = np.packbits(flags)
    return bitmap
