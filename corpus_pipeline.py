"""The text preparation pipeline: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import cloudpickle  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402

import symptia  # noqa: E402
from symptia.llm import exact_dedup, langid, near_copies, packing, pii  # noqa: E402
from symptia.llm.common import materialise, read, small_batches, tidy_shuffles  # noqa: E402

# functions that run in tasks travel with the job, so executors need no
# installed copy of this repository
cloudpickle.register_pickle_by_value(symptia)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; the rest go."""
    small_batches(spark)
    return langid.keep_spoken(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    small_batches(spark)
    return exact_dedup.exact_dedup(docs)


def near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies the document with the smallest id: those whose SimHash
    fingerprints op7 links, and those that share four fifths of their shingles."""
    small_batches(spark)
    tidy_shuffles(spark)
    return near_copies.keep_first(docs, fingerprints=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced in the text and n_chars counted anew."""
    small_batches(spark)
    return pii.redact(docs, "text", n_chars="n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their place in the sequences."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copy),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: SQL has no expression for suffix automata or genetic packing; the tests hold
#: each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each over all that its predecessor kept."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
