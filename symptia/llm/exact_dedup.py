"""Exact deduplication with two-pass Bloom filtering.

The first pass enters the digest of every text into a Bloom filter that counts
each bit as unseen, seen once or seen more than once. A text whose every bit is
seen more than once may be repeated; any other text certainly is not. In the
second pass only the possibly repeated rows are shuffled and grouped by digest;
the rest pass straight through with a group of their own.

Wrong suspicions cost a shuffled row, never a wrong answer: groups are formed
on the whole SHA-256 digest. The filter has 16 bits a row and is at most 128 MB;
beyond about 500 million rows it fills up and more rows take the shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.bloom import filter_bits, holds, repeated_bits
from symptia.llm.common import byte_values, documents, materialise

PROBES = 4


def digest(text: bytes) -> bytes:
    """SHA-256 of a text with A-Z lower-cased; other letters stay."""
    return hashlib.sha256(text.lower()).digest()


def probes(digests: list[bytes], bits: int) -> np.ndarray:
    """Bit positions of each digest, one row of ``PROBES`` each."""
    words = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 4)
    return (words[:, :PROBES] & np.uint64(bits - 1)).astype(np.int64)


def _checker(bitmap, bits: int):
    def check(texts: pa.Array) -> pa.Array:
        digests = [digest(t) for t in byte_values(texts)]
        at = probes(digests, bits)
        maybe = pa.array(holds(bitmap.value, at))
        return pa.StructArray.from_arrays([pa.array(digests, pa.binary()), maybe], ["sha", "maybe"])

    return F.arrow_udf(check, "sha binary, maybe boolean")


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row as the struct ``row``, with ``keep_id``, ``group_size``,
    ``kept`` and ``sha`` (binary).

    Texts are equal when identical after lower-casing A-Z; a null text equals
    an empty one. The row with the largest id stays; null ids come before all
    others, and of rows that share even the id exactly one stays. An empty
    table gives an empty result. All input columns travel inside ``row``, so
    no name can clash.
    """
    spark = docs.sparkSession
    bits = filter_bits(docs.count())
    marked = repeated_bits(
        documents(docs, doc_id, text).select("text"), bits,
        lambda batch: probes([digest(t) for t in byte_values(batch.column(0))], bits))
    bitmap = spark.sparkContext.broadcast(marked)
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("id"),
        _checker(bitmap, bits)(F.col(text).cast("string")).alias("mark"))
    keyed = keyed.select("row", "id", "mark.sha", "mark.maybe")
    straight = keyed.filter(~F.col("maybe")).select(
        "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    suspects = materialise(
        keyed.filter("maybe").select("row", "id", "sha", F.monotonically_increasing_id().alias("place")), "suspects")
    groups = suspects.groupBy("sha").agg(
        F.max(F.struct("id", "place")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    grouped = suspects.join(groups, "sha").select(
        "row", F.col("top.id").alias("keep_id"), "group_size", (F.col("place") == F.col("top.place")).alias("kept"), "sha")
    return straight.unionByName(grouped)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return exact_groups(docs, doc_id, text).filter("kept").select("row.*")
