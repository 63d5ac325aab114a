"""Running a stream over what has arrived and reading its output."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.session import shared_dir
from symptia.sources import listing
from symptia.sources.corpus import SUFFIXES, TASK_BYTES, file_page

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Bounds how much of a backlog one micro-batch takes, and with it what a
# stateful operator may have to sort per key.
FILES_PER_TRIGGER = 256
# The same for files of any size whose rows need no state: what a micro-batch
# costs besides its rows is paid once for so many bytes, not for so many files.
BYTES_PER_TRIGGER = 256 << 20


def read_table(spark: SparkSession, folder: str, table: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A Parquet table as a stream of its files, be it a folder of part files
    or a single file; a table that is not there is an error."""
    path = f"{folder}/{table}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if _is_folder(spark, path):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def read_corpus(spark: SparkSession, folder: str, bytes_per_trigger: int = BYTES_PER_TRIGGER, listings: str | None = None) -> DataFrame:
    """New text and Markdown files of a folder, one page each.

    The folder is listed now, by a task, into the folder ``listings``, and
    :func:`list_corpus` adds files to it that came later. A micro-batch takes
    files of ``bytes_per_trigger``. Which files a stream has had is state in its
    checkpoint, so a new call with an old checkpoint brings what is new. The
    driver holds no names, however many files there are.

    Of a store that only Spark's readers reach, the driver lists the folder for
    every micro-batch and keeps all names, as file streams do."""
    uri = listing.task_uri(spark, folder)
    if not uri:
        return (
            spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
            .option("maxBytesPerTrigger", bytes_per_trigger)
            .option("pathGlobFilter", "*.{txt,md}")
            .format("binaryFile")
            .load(folder)
            .select(*file_page())
        )
    use_rocksdb(spark)
    listings = listings or shared_dir(spark, "listings")
    list_corpus(spark, folder, listings, bytes_per_trigger)
    # a parcel of a listing is one file
    found = spark.readStream.schema(listing.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{listings}/*/parcel=*")
    new = found.withColumn("folder", F.lit(uri)).dropDuplicates(["folder", "name"])
    # the state of names wants few tasks, the files many
    tasks = max(2 * spark.sparkContext.defaultParallelism, bytes_per_trigger // TASK_BYTES)
    return listing.read_contents(new.repartition(tasks, "name"), uri).select(*file_page(F.col("source_name")))


def list_corpus(spark: SparkSession, folder: str, listings: str, bytes_per_trigger: int = BYTES_PER_TRIGGER) -> None:
    """Add a listing of a folder as it is now to those that a stream of
    :func:`read_corpus` reads; it takes the files that it has not had."""
    listing.write_listing(spark, listing.task_uri(spark, folder), SUFFIXES, f"{listings}/{os.urandom(6).hex()}", bytes_per_trigger)


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory: keyed state lives in RocksDB, and its changelog in
    the checkpoint, so a lost executor only replays."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# For streams of many small files: a partition takes as many as its bytes allow,
# and a micro-batch looks its files up in few tasks (by default thousands). The
# names they have had are state of few stores, closed between micro-batches: an
# open one takes 4 MB of disk besides its rows.
SMALL_FILES = {
    "spark.sql.files.openCostInBytes": str(64 << 10),
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}


@contextmanager
def _settings(spark: SparkSession, idle: bool, more: dict[str, str] | None = None) -> Iterator[None]:
    """Settings of a query that runs inside. ``idle`` says whether it runs
    micro-batches without input. Timers in event time need them; state that
    expires by the clock asks for one after the other, so that a run over what
    is available would never end."""
    wanted = {"spark.sql.streaming.noDataMicroBatches.enabled": str(idle).lower(), **(more or {})}
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def append(df: DataFrame, name: str, folder: str | None = None, ending: Callable[[], None] | None = None,
           idle: bool = True, settings: dict[str, str] | None = None) -> DataFrame:
    """Process all available input, append to Parquet, return the table. The
    file sink commits each micro-batch once. ``ending`` is called when the
    input is used up, and what it adds is processed too: a last beat lets go
    of rows that wait for the watermark. ``idle`` is false for streams whose
    state expires by the clock; ``settings`` hold for this query alone."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark, name)
    for step in (None, ending) if ending else (None,):
        if step:
            step()
        writer = (
            df.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).queryName(name)
        )
        # a file source plans with the session it was made in, until the end
        with _settings(spark, idle, settings):
            query = writer.start()
            query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def append_each(stream: DataFrame, job: Callable[[DataFrame], DataFrame], name: str, folder: str | None = None) -> DataFrame:
    """Run a batch job over every micro-batch, append its rows to Parquet and
    return the table. A replayed micro-batch overwrites its own folder."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    schema = job(spark.createDataFrame([], stream.schema)).schema
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True).queryName(name).start()
    )
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")
    return spark.read.schema(schema).parquet(f"{folder}/rows/batch=*")


def beats(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of bare times (``at``) from a folder; :func:`beat` adds one."""
    spark.createDataFrame([], "at timestamp").write.mode("append").parquet(folder)
    return spark.readStream.schema("at timestamp").parquet(folder)


def beat(spark: SparkSession, folder: str, at: str = "9999-01-01") -> None:
    spark.sql(f"SELECT TIMESTAMP '{at}' AS at").write.mode("append").parquet(folder)


def latest(df: DataFrame, name: str, keys: list[str], version: str, folder: str | None = None, idle: bool = True) -> DataFrame:
    """Process all available input of an updating stream and return the newest
    row per key. Every micro-batch overwrites its own folder, so replaying one
    after a failure changes nothing."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    writer = (
        df.writeStream.foreachBatch(write).outputMode("update")
        .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).queryName(name)
    )
    with _settings(spark, idle):
        query = writer.start()
    query.awaitTermination()
    written = spark.read.schema(df.schema).parquet(f"{folder}/rows/batch=*")
    rest = [c for c in df.columns if c not in keys]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_s")).select(*keys, "_s.*")
