"""The searchable collection: upsert by id, info, reset, as a table or stored
in a folder as a base with deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.session import broadcast_if_small

METADATA = [
    ("source_name", "string", ""), ("page_number", "int", 0), ("section_title", "string", ""),
    ("medical_category", "string", fv.DEFAULT_CATEGORY), ("token_count", "int", 0),
    ("char_start", "int", 0), ("char_end", "int", 0),
]


def with_metadata(chunks: DataFrame) -> DataFrame:
    """id, embedding, text and the metadata struct; missing values get their
    defaults, missing columns too."""
    have = set(chunks.columns)
    fields = [
        (F.coalesce(F.col(n), F.lit(d)) if n in have else F.lit(d)).cast(t).alias(n) for n, t, d in METADATA
    ]
    return chunks.select(F.col("chunk_id").alias("id"), "embedding", "text", F.struct(*fields).alias("metadata"))


def upsert(existing: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """Rows of ``batch`` replace those of the same id; others are added.

    Only the ids of the batch meet the existing rows. A small batch is
    broadcast, so the vectors of the collection are neither shuffled nor
    sorted. Of repeated ids inside a batch one row is added: the one with the
    largest ``order``, or any one without it.
    """
    rest = F.struct(*[c for c in batch.columns if c != "id"])
    one = F.max_by(rest, order) if order else F.any_value(rest)
    batch = batch.groupBy("id").agg(one.alias("_row")).select("id", "_row.*").select(*existing.columns)
    ids = broadcast_if_small(batch.select("id"))
    return existing.join(ids, "id", "left_anti").unionByName(batch)


def info(collection: DataFrame, name: str, alpha: float = fv.DEFAULT_ALPHA) -> DataFrame:
    return collection.agg(F.count("*").alias("count")).select(
        F.lit(name).alias("name"), "count", F.lit(alpha).alias("alpha")
    )


def reset(collection: DataFrame) -> DataFrame:
    """An empty collection with the same schema."""
    return collection.sparkSession.createDataFrame([], collection.schema)


# --- a collection in a folder ---------------------------------------------------
#
# Version 1 and each compaction are a base; an upsert or a removal is a delta of
# its rows alone. A version holds once its mark is there, and readers merge the
# newest base with the deltas after it.

TAKEN_OUT = "removed"


def _committed(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, kind) of the committed versions in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "version=*/kind=*/_SUCCESS"))
    names = [(m.getPath().getParent().getParent().getName(), m.getPath().getParent().getName()) for m in marks or ()]
    return sorted((int(v.split("=")[1]), k.split("=")[1]) for v, k in names)


def _write(rows: DataFrame, folder: str, kind: str, number: int | None) -> int:
    have = _committed(rows.sparkSession, folder)
    number = max((n for n, _ in have), default=0) + 1 if number is None else number
    if number not in {n for n, _ in have}:
        rows.write.mode("overwrite").parquet(f"{folder}/version={number}/kind={kind}")
    return number


def write_base(collection: DataFrame, folder: str, number: int | None = None) -> int:
    """The rows as a version that stands for all before it; returns its number."""
    return _write(collection.withColumn(TAKEN_OUT, F.lit(False)), folder, "base", number)


def write_upsert(batch: DataFrame, folder: str, order: str | None = None, number: int | None = None) -> int:
    """One row of each id of ``batch`` (see ``upsert``) as a delta: what is
    written grows with the batch, not with the collection. A ``number`` names
    the version; if that is committed already nothing is written, so that a
    batch of a stream may be run again. One run writes at a time."""
    rest = F.struct(*[c for c in batch.columns if c != "id"])
    one = F.max_by(rest, order) if order else F.any_value(rest)
    rows = batch.groupBy("id").agg(one.alias("_row")).select("id", "_row.*")
    return _write(rows.withColumn(TAKEN_OUT, F.lit(False)), folder, "delta", number)


def write_removal(ids: DataFrame, folder: str, number: int | None = None) -> int:
    """A delta that takes the rows of ``ids`` (column id) out."""
    return _write(ids.select("id").distinct().withColumn(TAKEN_OUT, F.lit(True)), folder, "delta", number)


def read_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The rows as of the newest committed version; an error if there is no
    base.

    Of the deltas only id and version are compared, and the ids they hold are
    broadcast where few, so the vectors of the base are not shuffled.
    """
    have = _committed(spark, folder)
    bases = [n for n, kind in have if kind == "base"]
    if not bases:
        raise FileNotFoundError(f"no committed collection in {folder}")
    base = spark.read.parquet(f"{folder}/version={bases[-1]}/kind=base")
    later = [n for n, kind in have if n > bases[-1]]
    if not later:
        return base.drop(TAKEN_OUT)
    deltas = None
    for n in later:
        part = spark.read.schema(base.schema).parquet(f"{folder}/version={n}/kind=delta").withColumn("_version", F.lit(n))
        deltas = part if deltas is None else deltas.unionByName(part)
    newest = deltas.groupBy("id").agg(F.max("_version").alias("_newest"))
    ids = broadcast_if_small(newest.select(F.col("id").alias("_id"), "_newest"))
    same = F.col("id").eqNullSafe(F.col("_id"))
    rest = base.join(ids, same, "left_anti")
    fresh = deltas.join(ids, same & (F.col("_version") == F.col("_newest")), "left_semi").filter(~F.col(TAKEN_OUT))
    return rest.unionByName(fresh.drop("_version")).drop(TAKEN_OUT)


def compact(spark: SparkSession, folder: str) -> int:
    """The merged rows as a new base; older versions stay readable by those who
    still read them."""
    return write_base(read_stored(spark, folder), folder)


def clear(spark: SparkSession, folder: str) -> int:
    """A base without rows."""
    return write_base(reset(read_stored(spark, folder)), folder)
