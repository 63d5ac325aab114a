"""Corpus, dictionary and scenario sources; chunk, report and log sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import text
from symptia.session import shared_dir
from symptia.sources import listing

SUFFIXES = ["txt", "md"]
# Entries a folder may have and still be listed by the driver.
LISTED = 10_000
# Bytes of files that a task reads, by and large, in a larger folder.
TASK_BYTES = 32 << 20
CHUNK_SCHEMA = (
    "chunk_id string, source_name string, page_number int, section_title string, "
    "medical_category string, text string, token_count int, char_start int, char_end int"
)
ENVELOPE_SCHEMA = (
    "metadata struct<source_dir:string,files_processed:int,total_chunks:int,"
    "chunk_tokens:int,overlap_tokens:int,encoding:string>, "
    "chunks array<struct<" + ",".join(c.strip().replace(" ", ":", 1) for c in CHUNK_SCHEMA.split(",")) + ">>"
)
SCENARIO_SCHEMA = (
    "id string, input_text string, input_type string, expected_triage_level string, "
    "expected_body_system string, expected_conditions array<string>, should_escalate boolean, "
    "should_ask_followup boolean, notes string"
)


def scan_corpus(spark: SparkSession, folder: str, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One page per file of a folder with one of the suffixes, not those of its
    subfolders; bytes that are not UTF-8 become replacement characters. A folder
    without such files has no pages. In a folder of more than ``LISTED`` entries
    tasks list and read the files, as the driver's listing would grow with them."""
    uri = listing.task_uri(spark, folder)
    if uri and listing.holds_more(spark, uri, LISTED):
        return _scan_listed(spark, uri, suffixes)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(folder)
    return files.select(*file_page())


def _scan_listed(spark: SparkSession, uri: str, suffixes: Sequence[str]) -> DataFrame:
    to = shared_dir(spark, "listing")
    listing.write_listing(spark, uri, suffixes, to, TASK_BYTES)
    names = spark.read.schema(f"{listing.SCHEMA}, parcel int").parquet(to)
    parcels = names.agg(F.coalesce(F.max("parcel") + 1, F.lit(0)).alias("n")).first().n
    dealt = names.repartition(max(parcels, spark.sparkContext.defaultParallelism), "name")
    return listing.read_contents(dealt, uri).select(*file_page(F.col("source_name")))


def file_page(name: Column | None = None) -> list[Column]:
    """The page of a file that was read whole as bytes. The text reader takes
    about six times as long to open a small file, and opens it for its name
    alone; the name of a file read as bytes needs no content."""
    return [
        (F.col("_metadata.file_name") if name is None else name).alias("source_name"),
        F.lit(0).alias("page_number"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    ]


def supported(name: Column) -> Column:
    """Names the corpus scan picks up."""
    return name.rlike(r"\.(" + "|".join(SUFFIXES) + ")$")


def non_blank_pages(pages: DataFrame) -> DataFrame:
    return pages.filter(~text.is_blank("text"))


def unreadable_reason() -> Column:
    """Why a page cannot be prepared, NULL when it can."""
    return F.when(~F.lower("source_name").rlike(r"\.(txt|md)$"), "unsupported file type").when(
        F.col("text").isNull(), "unreadable"
    )


def split_readable(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason): a file that cannot be read becomes an
    error row and the run goes on."""
    marked = pages.withColumn("reason", unreadable_reason())
    valid = marked.filter(F.col("reason").isNull()).drop("reason")
    rejected = marked.filter(F.col("reason").isNotNull()).select(
        "source_name", F.concat_ws(": ", "source_name", "reason").alias("error")
    )
    return valid, rejected


def manifest(pages: DataFrame, chunks: DataFrame, source_dir: str,
             chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS) -> DataFrame:
    """One row on an ingest run."""
    # both counts in one aggregate over a union, so nothing is joined
    both = pages.select("source_name", F.lit(0).alias("chunk")).unionByName(
        chunks.select(F.lit(None).cast("string").alias("source_name"), F.lit(1).alias("chunk")))
    counts = both.agg(F.countDistinct("source_name").alias("files_processed"), F.sum("chunk").alias("total_chunks"))
    return counts.select(
        F.lit(source_dir).alias("source_dir"), "files_processed", "total_chunks",
        F.lit(chunk_tokens).alias("chunk_tokens"), F.lit(overlap_tokens).alias("overlap_tokens"),
        F.lit(fv.ENCODING_NAME).alias("encoding"),
    )


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions of a sink that were committed, in order; a
    folder that is not there has none."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/manifest/_SUCCESS"))
    return sorted(int(m.getPath().getParent().getParent().getName().split("=")[1]) for m in marks or ())


def write_chunks(chunks: DataFrame, pages: DataFrame, source_dir: str, folder: str,
                 chunk_tokens: int = fv.CHUNK_TOKENS, overlap_tokens: int = fv.OVERLAP_TOKENS) -> DataFrame:
    """Chunks as Parquet plus a manifest, as a new version of the sink; returns
    the manifest.

    Chunks are written first and counted from the written files, so the text
    work runs once. The manifest, whose writer marks its success last, commits
    the version: whatever fails before leaves the version before it in force,
    and a later run overwrites the remains. One run writes at a time.
    """
    spark = chunks.sparkSession
    version = f"{folder}/version={max(_versions(spark, folder), default=0) + 1}"
    chunks.write.mode("overwrite").parquet(f"{version}/chunks")
    written = spark.read.schema(chunks.schema).parquet(f"{version}/chunks")
    row = manifest(pages, written, source_dir, chunk_tokens, overlap_tokens)
    row.write.mode("overwrite").json(f"{version}/manifest")
    return spark.read.schema(row.schema).json(f"{version}/manifest")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the newest committed version of a sink; an error if there is
    none."""
    versions = _versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no committed chunks in {folder}")
    return spark.read.parquet(f"{folder}/version={versions[-1]}/chunks")


def explode_envelopes(envelopes: DataFrame, value: str = "value") -> DataFrame:
    """Chunks out of nested documents ``{metadata, chunks[]}``, one per row."""
    parsed = envelopes.select(F.from_json(value, ENVELOPE_SCHEMA).alias("e"))
    return parsed.select("e.metadata", F.explode("e.chunks").alias("c")).select("metadata.encoding", "c.*")


def write_envelopes(chunks: DataFrame, folder: str) -> None:
    """One nested document per source, one a line, in as many files as there
    are tasks."""
    per_file = chunks.groupBy("source_name").agg(F.collect_list(F.struct(*chunks.columns)).alias("chunks"))
    metadata = F.struct(F.col("source_name").alias("source_dir"), F.lit(fv.ENCODING_NAME).alias("encoding"))
    per_file.select(F.to_json(F.struct(metadata.alias("metadata"), "chunks")).alias("value")).write.text(folder)


def scan_envelopes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Chunks out of nested chunk files, with the encoding they were counted
    in. A file is one document, or with ``lines`` holds one a line; such files
    are split among tasks."""
    files = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", not lines).json(path)
    return files.select("metadata.encoding", F.explode("chunks").alias("c")).select("encoding", "c.*")


def scan_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios out of a nested file ``{"scenarios": [...]}``."""
    files = spark.read.schema(f"scenarios array<struct<{_fields(SCENARIO_SCHEMA)}>>").option("multiLine", True).json(path)
    return files.select(F.explode("scenarios").alias("s")).select("s.*")


def explode_scenarios(envelopes: DataFrame, value: str = "value") -> DataFrame:
    schema = f"scenarios array<struct<{_fields(SCENARIO_SCHEMA)}>>"
    return envelopes.select(F.explode(F.from_json(value, schema)["scenarios"]).alias("s")).select("s.*")


def _fields(schema: str) -> str:
    return ",".join(c.strip().replace(" ", ":", 1) for c in schema.split(","))
