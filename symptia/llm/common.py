"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.session import materialise, shared_dir

__all__ = ["Vocabulary", "byte_values", "documents", "materialise", "pieces_of", "read", "release", "shared_dir",
           "small_batches", "text_values", "tidy_shuffles"]


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts are long: fewer of them at a time keep the Python
    side of a task small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def tidy_shuffles(spark: SparkSession) -> None:
    """Shuffle files go when the query that wrote them ends, and not when the
    driver collects its garbage. For jobs of many written tables."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder, as its files are split."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def release(*tables: DataFrame) -> None:
    """Removes the files of written tables whose rows have gone into later
    ones. Only for tables that nothing unwritten still reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the id and the text of a table, so that no other column can clash
    with names used inside an operator."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def text_values(column: pa.Array) -> list[str]:
    """Texts of a column; null counts as empty."""
    return [t or "" for t in column.to_pylist()]


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of the texts of a column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def pieces_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of memory, however
    long its texts are; a single longer row stays whole."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from pieces_of(iter([batch.slice(0, half), batch.slice(half)]), most)


class Vocabulary:
    """The bytes of a tokenizer's file, read once where the job is written.

    The file is of fixed size (under 2 MB), so it travels to the executors as
    a broadcast; they need no copy of it under any path.
    """

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as file:
            self.shared = spark.sparkContext.broadcast({"content": file.read()})

    @property
    def content(self) -> bytes:
        return self.shared.value["content"]

    def kept(self, make: Callable[[bytes], object]) -> object:
        """What ``make`` makes of the content, made once in a Python worker: it
        stays with the broadcast value, so that later tasks find it."""
        own = self.shared.value
        if "made" not in own:
            own["made"] = make(own["content"])
        return own["made"]
