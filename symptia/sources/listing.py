"""Folders of any number of files, listed and read by tasks.

Spark's file sources list a folder in the driver and keep an object for each
of its files; a stream keeps every path it has seen. Here one task lists the
folder and writes the names as a table, and tasks read the files, so that the
driver holds nothing that grows with their number.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, source_name string"
# Names in an Arrow batch of the listing.
NAMES = 8192
# What a file counts for besides its bytes, so that a parcel of very small
# files is bounded too.
FILE_BYTES = 1 << 10
# Bytes of files in an Arrow batch; a larger file is a batch of its own.
BATCH_BYTES = 16 << 20
# What Java's URI leaves as it is in a path.
_PLAIN = re.compile(r"[\w\-!.~'()*:@&=+$,;]*", re.ASCII)


def task_uri(spark: SparkSession, folder: str) -> str | None:
    """The folder as a URI that tasks can open by themselves. None if that is
    left to Spark's readers: stores that only they reach, patterns, single
    files, and folders that are not there."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).resolvePath(path).toUri().toString()
        files, at = pafs.FileSystem.from_uri(uri)
        return uri if files.get_file_info(at).type == pafs.FileType.Directory else None
    except (Py4JError, PySparkException, pa.ArrowException, OSError):
        return None


def holds_more(spark: SparkSession, uri: str, n: int) -> bool:
    """True when a folder has more than ``n`` entries of any kind; one task
    counts no more than n+1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(1 for _ in islice(_entries(uri), n + 1))], pa.int64())})

    return _one_task(spark).mapInArrow(count, "n long").first().n > n


def write_listing(spark: SparkSession, uri: str, suffixes: Sequence[str], to: str, parcel_bytes: int) -> None:
    """The names of the files of a folder with one of the suffixes, those that
    Spark's readers take: neither hidden nor empty, nor of a subfolder. They
    are written as parcels, each of files of about ``parcel_bytes``."""
    endings = tuple(f".{s}" for s in suffixes)

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            rows, size, parcel = [], 0, 0
            for name, length in _entries(uri, endings):
                if size and size + length + FILE_BYTES > parcel_bytes:
                    size, parcel = 0, parcel + 1
                size += length + FILE_BYTES
                rows.append((name, _quoted(name), parcel))
                if len(rows) == NAMES:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    _one_task(spark).mapInArrow(names, f"{SCHEMA}, parcel int").write.partitionBy("parcel").parquet(to)


def read_contents(names: DataFrame, uri: str) -> DataFrame:
    """``names`` with the bytes of the files as ``content``. Tasks hold batches
    of bounded size. Queries that want no content open no file, and none that
    filters by the content reads it twice."""

    def read(names: Iterator[pa.Array]) -> Iterator[pa.Array]:
        files, at = pafs.FileSystem.from_uri(uri)
        for batch in names:
            block, size = [], 0
            for name in batch.to_pylist():
                data = _bytes_of(files, f"{at}/{name}")
                if block and size + len(data) > BATCH_BYTES:
                    yield pa.array(block, pa.binary())
                    block, size = [], 0
                block.append(data)
                size += len(data)
            yield pa.array(block, pa.binary())

    # were it deterministic, a filter by the content would be a second call
    return names.withColumn("content", F.arrow_udf(read, "binary").asNondeterministic()(F.col("name")))


def _one_task(spark: SparkSession) -> DataFrame:
    return spark.range(0, 1, 1, 1)


def _entries(uri: str, endings: tuple[str, ...] | None = None) -> Iterator[tuple[str, int]]:
    """Names and lengths of the files that :func:`write_listing` takes; of all
    entries, with length 0, without ``endings``. Local folders are walked, so
    that no list of them is held; other stores hand theirs to this task."""
    files, at = pafs.FileSystem.from_uri(uri)
    if not isinstance(files, pafs.LocalFileSystem):
        for info in files.get_file_info(pafs.FileSelector(at)):
            if endings is None:
                yield info.base_name, 0
            elif info.is_file and info.size and _wanted(info.base_name, endings):
                yield info.base_name, info.size
        return
    with os.scandir(at) as found:
        for entry in found:
            if endings is None:
                yield entry.name, 0
            elif _wanted(entry.name, endings):
                try:
                    length = entry.stat().st_size if entry.is_file() else 0
                except FileNotFoundError:  # gone since
                    continue
                if length:
                    yield entry.name, length


def _wanted(name: str, endings: tuple[str, ...]) -> bool:
    return name.endswith(endings) and not name.startswith(".") and (not name.startswith("_") or "=" in name)


def _quoted(name: str) -> str:
    """A name as Spark's ``_metadata.file_name`` has it: in a URI."""
    if _PLAIN.fullmatch(name):
        return name
    # Java keeps other letters and signs, but neither blanks nor controls
    return "".join(
        c if _PLAIN.fullmatch(c) or ord(c) > 127 and not (c.isspace() or ord(c) < 160) else "".join(f"%{b:02X}" for b in c.encode())
        for c in name
    )


def _batch(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32())],
        names=["name", "source_name", "parcel"])


def _bytes_of(files: pafs.FileSystem, path: str) -> bytes:
    if isinstance(files, pafs.LocalFileSystem):
        with open(path, "rb", buffering=0) as file:
            return file.read()
    with files.open_input_stream(path) as file:
        return file.read()
