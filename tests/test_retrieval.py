import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symptia.operators import collection, hooks, retrieval
from symptia.plans import search


def brute_force(q, c, ids, k):
    q = q / np.linalg.norm(q, axis=1, keepdims=True)
    c = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    s = np.round(np.maximum(0, (1 + q @ c.T) / 2), retrieval.DIGITS)
    return [[ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]] for i in range(len(q))]


@pytest.mark.parametrize("ids_are_text", [False, True])
@pytest.mark.parametrize("bound", [1000, 5])
def test_nearest_is_exact(spark, monkeypatch, bound, ids_are_text):
    """Both ways, with a third of the rows being copies of one vector and a
    zero vector among them."""
    monkeypatch.setattr(retrieval, "GRID_ROWS", 40)
    rng = np.random.default_rng(3)
    c = rng.normal(size=(300, 8))
    c[100:200], c[7] = c[100], 0.0
    q = np.vstack([rng.normal(size=(20, 8)), c[100:101]])
    ids = [f"c{i}" if ids_are_text else i for i in range(300)]
    kind = "string" if ids_are_text else "bigint"
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, c)], f"id {kind}, embedding array<double>").repartition(7)
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id bigint, embedding array<double>")
    got = retrieval.nearest(queries, rows, 12, broadcast_queries=bound).collect()
    want = brute_force(q, c, ids, 12)
    for i in range(len(q)):
        assert [r.id for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == want[i]


def test_filter_and_small_collections(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)], i % 2, "x") for i in range(6)], "id int, embedding array<double>, label int, s string")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = retrieval.nearest(queries, rows, 10, {"label": 1, "s": "x"}).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 3, 5] and all(0 <= r.vector_score <= 1 for r in got)
    assert retrieval.nearest(queries.filter("false"), rows, 3).count() == 0
    assert retrieval.nearest(queries, rows.filter("false"), 3).count() == 0


def test_keyword_scores(spark):
    docs = ["fever fever cough", "coughing all night long", "the patient has nothing", "fever " * 30]
    pool = spark.createDataFrame([(1, i, d) for i, d in enumerate(docs)] + [(2, 0, docs[0])], "query_id int, id int, text string")
    queries = spark.createDataFrame([(1, "fever and cough, fever"), (2, "of the")], "query_id int, query_text string")
    got = {(r.query_id, r.id): r.keyword_score for r in retrieval.keyword_scores(queries, pool).collect()}

    def idf(term):
        return np.log(5 / (sum(term in d for d in docs) + 1)) + 1

    assert got[1, 0] == pytest.approx((2 * (2 / 3) * idf("fever") + (1 / 3) * idf("cough")) / 3)
    assert got[1, 1] == 0.0  # "cough" is part of a word here: no term, yet it lowers the weight
    assert got[1, 2] == 0.0 and got[1, 3] == pytest.approx(min(2 * idf("fever") / 3, 1.0)) and got[2, 0] == 0.0


def test_merge_prefers_earlier_variant(spark):
    hits = spark.createDataFrame([(1, "a", 0.5, 0.1, 0.4, 1), (1, "a", 0.9, 0.0, 0.4, 0), (1, "a", 0.1, 0.0, 0.3, 2), (1, "b", 0.2, 0.0, 0.2, 2)],
                                 "query_id int, id string, vector_score double, keyword_score double, score double, variant_no int")
    got = {r.id: (r.variant_no, r.vector_score, r.matched_variants) for r in retrieval.merge_variants(hits).collect()}
    assert got == {"a": (0, 0.9, [0, 1, 2]), "b": (2, 0.2, [2])}


def test_rerank(spark):
    cands = spark.createDataFrame([(1, i, 0.5) for i in range(3)] + [(2, 0, 0.5)], "query_id int, id int, score double")
    answers = spark.createDataFrame([(1, 0, "1.4"), (1, 1, "dunno"), (2, 0, "1")], "query_id int, id int, answer string")
    got = {(r.query_id, r.id): (r.rerank_score, r.relevance_score) for r in retrieval.rerank(cands, answers, k=2).collect()}
    assert got[1, 0] == (1.0, pytest.approx(0.85)) and got[1, 1] == (-1.0, 0.5) and got[1, 2] == (-1.0, 0.5)
    assert got[2, 0] == (-1.0, 0.5)  # not more candidates than results
    assert retrieval.rerank(cands, None, k=2).filter("relevance_score <> score").count() == 0


def test_context(spark):
    rows = spark.createDataFrame([(1, i, "x" * 500, f"s{i}") for i in range(1, 7)], "query_id int, rank int, text string, source string")
    parts = retrieval.numbered_context(rows).collect()[0].context.split("\n\n")
    assert parts == [f"[{i}] {'x' * 400} (source: s{i})" for i in range(1, 5)]


def test_hooks_let_go_of_vectors(spark):
    """Of a large Arrow batch only the vectors of a slice are Python objects."""
    class Vector(list):
        live = 0

        def __init__(self):
            Vector.live += 1
            super().__init__([float(Vector.live)])

        def __del__(self):
            Vector.live -= 1

    texts = spark.range(0, 3000, 1, 1).select(F.col("id").cast("string").alias("t"))
    most = hooks.embed(texts, "t", lambda ts: [Vector() for _ in ts]).agg(F.max(F.col("embedding")[0])).first()[0]
    assert most <= 200


def test_hooks_batch(spark):
    sizes = []
    assert hooks.batched(lambda t: sizes.append(len(t)) or t, list("abcdefg"), 3) == list("abcdefg") and sizes == [3, 3, 1]
    with pytest.raises(ValueError):
        hooks.batched(lambda t: t[:1], ["a", "b"], 2)
    df = hooks.embed(spark.range(250).select(F.col("id").cast("string").alias("t")), "t", lambda ts: [[float(len(ts))]] * len(ts))
    assert df.filter(F.col("embedding")[0] > 100).count() == 0 and df.count() == 250
    vec = hooks.hashed_features(["a b a", ""])
    assert sum(v * v for v in vec[0]) == pytest.approx(1.0) and sum(vec[1]) == 0.0


def test_upsert(spark):
    def make(rows):
        return collection.with_metadata(spark.createDataFrame(rows, "chunk_id string, embedding array<double>, text string, page_number int"))

    old = make([("a", [1.0], "old", 1), ("b", [1.0], "keep", None)])
    new = make([("a", [2.0], "new", 3), ("c", [3.0], "add", None)])
    once = collection.upsert(old, new)
    twice = collection.upsert(once, new)
    for df in (once, twice):
        assert {r.id: r.text for r in df.collect()} == {"a": "new", "b": "keep", "c": "add"} and df.count() == 3
    meta = {r.id: r.metadata for r in once.collect()}["b"]
    assert (meta.page_number, meta.medical_category, meta.section_title) == (0, "general", "")
    assert collection.reset(once).count() == 0 and collection.reset(once).schema == once.schema
    repeated = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "id string, text string, no int")
    assert [r.text for r in collection.upsert(repeated.filter("false"), repeated, "no").collect()] == ["y"]


def test_retrieve_end_to_end(spark):
    docs = [(i, t) for i, t in enumerate(["fever in children", "broken arm", "cough and fever", "sleep habits", "arm pain at night", "chest cold", "skin rash"])]
    coll = hooks.embed(spark.createDataFrame(docs, "id int, text string"), "text")
    queries = spark.createDataFrame([(1, " fever "), (2, "arm")], "query_id int, query_text string")
    out = search.retrieve(queries, coll, lambda df: hooks.embed(df, "query_text"), k=2, candidates=3).orderBy("query_id", "rank").collect()
    assert {r.id for r in out if r.query_id == 1} == {0, 2} and {r.id for r in out if r.query_id == 2} == {1, 4}
    assert all(r.rerank_score == -1.0 for r in out)


def test_rows_without_a_vector_take_no_part(spark):
    rows = [(i, [1.0, float(i)] if i % 3 else None) for i in range(12)]
    collection = spark.createDataFrame(rows, "id int, embedding array<double>").repartition(40)
    queries = collection.limit(12).withColumnRenamed("id", "query_id")
    for most in (100, 1):
        got = retrieval.nearest(queries, collection, 3, broadcast_queries=most).collect()
        assert len(got) == 8 * 3 and all(r.id % 3 and r.query_id % 3 for r in got)


def test_partitions_do_not_multiply_the_candidates(spark):
    collection = spark.range(3000).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("embedding")).repartition(400)
    queries = collection.limit(5).withColumnRenamed("id", "query_id")
    partial = retrieval._broadcast_top(collection, queries.select("query_id", "embedding").toArrow(), 2, "query_id long, id long, vector_score double")
    assert partial.count() <= retrieval.SEARCH_TASKS * spark.sparkContext.defaultParallelism * 5 * 2


def test_many_queries_hold_no_block_of_rows(spark, monkeypatch):
    """Rows stream past a block of queries, results leave tile by tile."""
    monkeypatch.setattr(retrieval, "GRID_ROWS", 30)
    monkeypatch.setattr(retrieval, "TILE_QUERIES", 8)
    rows = [(i, [float(i % 7), float(i % 11), 1.0]) for i in range(100)]
    collection = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = collection.withColumnRenamed("id", "query_id")
    many = retrieval.nearest(queries, collection, 3, broadcast_queries=10)
    assert "CoGroups" not in many._jdf.queryExecution().executedPlan().toString()
    few = retrieval.nearest(queries, collection, 3)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    top = retrieval._Tiles(np.eye(3)[[0, 1, 2] * 7], 2)
    top.add(np.eye(3), np.arange(3))
    assert [b.num_rows for b in top.batches(pa.array(range(21)), pa.int64())] == [16, 16, 10]


def test_term_frequencies_shuffle_no_keywords(spark):
    docs = spark.createDataFrame(
        [(1, "Fever and cough, fever"), (2, None), (3, ""), (4, "rash")], "doc_id int, text string")
    got = retrieval.term_frequencies(docs, "doc_id")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = {(1, "fever"): 2 / 3, (1, "cough"): 1 / 3, (4, "rash"): 1.0}
    assert {(r.doc_id, r.term): r.tf for r in got.collect()} == pytest.approx(want)
    # an id of several rows is one document, a null id too
    more = docs.union(spark.createDataFrame([(1, "fever fever cough"), (None, "rash"), (None, "rash")], docs.schema))
    want |= {(1, "fever"): 4 / 3, (1, "cough"): 2 / 3, (None, "rash"): 2.0}
    assert {(r.doc_id, r.term): r.tf for r in retrieval.term_frequencies(more, "doc_id").collect()} == pytest.approx(want)
