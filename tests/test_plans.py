"""Shapes of physical plans that matter at size."""

import os

import pytest
from pyspark.sql import functions as F

from checks import inputs
from symptia.operators import chunking, collection, guardrails, lexicon, retrieval
from symptia.plans import triage
from symptia.sources import corpus

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def test_row_local_jobs_do_not_shuffle(spark):
    turns = table(spark, "conversations")
    docs = inputs.corpus_of(table(spark, "documents"))
    for df in (
        guardrails.check_messages(turns).select("conv_id", "violation_type"),
        triage.triage_events(triage.triage_rules(turns, inputs.lexicon(spark), ["conv_id", "turn"], F.lit("english")), ["conv_id", "turn"]),
        chunking.chunk_pages(docs),
        corpus.split_readable(docs)[1],
    ):
        assert "Exchange" not in plan(df)


def test_exploded_arrays_are_computed_once(spark):
    chunks = plan(chunking.chunk_pages(inputs.corpus_of(table(spark, "documents"))))
    # once to cut the page, once to count the tokens of a chunk
    assert chunks.count("regexp_extract_all") == 2


def test_search_prunes_and_pushes(spark):
    rows = table(spark, "embeddings").withColumnRenamed("vec_id", "id")
    queries = rows.select(F.col("id").alias("query_id"), "embedding").limit(5)
    got = plan(retrieval.nearest(queries, rows, 3, {"label": 2}))
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,2), IsNotNull(embedding)]" in got
    # the top list is cut before the only shuffle and after it
    assert got.count("Exchange hashpartitioning") == 1 and got.count("WindowGroupLimit") == 2
    docs = table(spark, "documents").select(F.col("doc_id").alias("id"), "text", "lang", F.array(F.lit(1.0)).alias("embedding"))
    assert "text" not in plan(retrieval.nearest(queries, docs, 3)).split("ReadSchema")[-1]


def test_small_batches_do_not_shuffle_the_collection(spark):
    docs = table(spark, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    got = plan(collection.upsert(docs, docs.limit(3)))
    # only the batch is shuffled, to one row per id
    assert "BroadcastHashJoin" in got and got.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in got


def test_rules_need_not_read_invalid_messages(spark):
    entries = spark.createDataFrame([(0, "سعال", "so3al", "سعال", "cough", "x", "y", "z")], "entry_no int, " + ", ".join(
        f"{c} string" for c in lexicon.FIELDS))
    said = ["i want to die", "i want to die " + "x" * 2000, "so3al", "عندي سعال", "", None, "chest pain"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, text string")

    def run(**options):
        return triage.triage_rules(rows, entries, ["id"], F.lit("english"), **options).orderBy("id").collect()

    full, lean = run(), run(judge_invalid=False)
    assert [r.step for r in lean][:2] == ["blocked", "invalid"] and full[1].rule == "suicidal" and lean[1].rule is None
    valid = [i for i, r in enumerate(full) if r.step != "invalid"]
    assert [full[i] for i in valid] == [lean[i] for i in valid]
    same = ["step", "level", "reply", "conditions", "actions", "needs_clarification", "used_fallback"]
    assert [[r[c] for c in same] for r in full] == [[r[c] for c in same] for r in lean]
