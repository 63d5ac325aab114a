"""Queries and SQL twins for the collection and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import q, read, sql_strip
from checks.text_rules import SQL_KEYWORDS
from symptia.functions import fixed_values as fv
from symptia.functions import messages as copy
from symptia.functions import text
from symptia.operators import collection as coll
from symptia.operators import hooks, retrieval
from symptia.plans import search
from symptia.session import materialise, shared_dir

QUERIES, SQL = {}, {}
R = 6  # digits compared


def vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def as_queries(spark, sf):
    return vectors(spark, sf).select(F.col("id").alias("query_id"), "embedding")


def texts(spark, sf):
    """Documents with hashed-word vectors."""
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    return hooks.embed(docs, "text")


def items(spark, sf):
    """Every benchmark passage is a query."""
    return read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def item_queries(spark, sf):
    return hooks.embed(items(spark, sf), "query_text")


COS = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"


def sql_near(k: int, where: str = "TRUE") -> str:
    return (
        f"near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, id) AS rank FROM "
        f"(SELECT a.query_id, b.id, round(greatest(0.0, (1 + {COS}) / 2), 9) AS vector_score FROM qs a, rows b WHERE {where})) WHERE rank <= {k})"
    )


EMB = "rows AS (SELECT vec_id AS id, embedding, label FROM embeddings), qs AS (SELECT vec_id AS query_id, embedding FROM embeddings)"


def sql_hashed(source: str, ids: str, col: str, name: str) -> str:
    dims = ", ".join(f"count(*) FILTER (b = {i})" for i in range(hooks.HASH_DIM))
    return (
        f"{name}_w AS (SELECT {ids}, unnest(regexp_extract_all(lower({col}), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {source}), "
        f"{name}_b AS (SELECT {ids}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {hooks.HASH_DIM} AS b FROM {name}_w), "
        f"{name} AS (SELECT s.{ids}, coalesce(v.e, list_resize([]::BIGINT[], {hooks.HASH_DIM}, 0)) AS e FROM {source} s LEFT JOIN "
        f"(SELECT {ids}, [{dims}] AS e FROM {name}_b GROUP BY 1) v USING ({ids}))"
    )


DOCS = (
    sql_hashed("documents", "doc_id", "text", "dv") + ", " + sql_hashed("benchmark", "item_id", "text", "iv")
    + ", rows AS (SELECT doc_id AS id, e AS embedding, text, lang FROM dv JOIN documents USING (doc_id)), "
    "qs AS (SELECT item_id AS query_id, e AS embedding, text AS query_text FROM iv JOIN benchmark USING (item_id))"
)

# ---------------------------------------------------------------- collection


def _existing_and_batch(spark, sf):
    docs = read(spark, sf, "documents")
    chunk = docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.array(F.lit(1.0)).alias("embedding"), "text",
                        F.col("source").alias("source_name"))
    labels = read(spark, sf, "labels").select(
        F.concat(F.lit("c"), F.col("doc_id") * 2).alias("chunk_id"), F.array(F.lit(2.0)).alias("embedding"),
        F.concat(F.lit("label "), "quality").alias("text"), F.lit(None).cast("string").alias("source_name"),
        F.when(F.col("toxic") == 1, "emergency").alias("medical_category"))
    return coll.with_metadata(chunk), coll.with_metadata(labels)


def upserted(spark, sf):
    existing, batch = _existing_and_batch(spark, sf)
    return coll.upsert(existing, batch)


QUERIES["collection_upsert"] = lambda spark, sf: upserted(spark, sf).select(
    "id", F.md5("text").alias("text_md5"), "metadata.source_name", "metadata.medical_category", "metadata.token_count")
UPSERTED = (
    "batch AS (SELECT 'c' || doc_id * 2 AS id, 'label ' || quality AS text, '' AS source_name, CASE WHEN toxic = 1 THEN 'emergency' ELSE 'general' END AS medical_category FROM labels), "
    "merged AS (SELECT id, text, source_name, medical_category FROM batch UNION ALL SELECT 'c' || doc_id, text, source, 'general' FROM documents "
    "WHERE 'c' || doc_id NOT IN (SELECT id FROM batch))"
)
SQL["collection_upsert"] = f"WITH {UPSERTED} SELECT id, md5(text) AS text_md5, source_name, medical_category, CAST(0 AS BIGINT) AS token_count FROM merged"
QUERIES["collection_info"] = lambda spark, sf: coll.info(upserted(spark, sf), "documents").unionByName(
    coll.info(coll.reset(upserted(spark, sf)), "after reset"))
SQL["collection_info"] = (
    f"WITH {UPSERTED} SELECT 'documents' AS name, count(*) AS count, CAST(0.7 AS DOUBLE) AS alpha FROM merged UNION ALL SELECT 'after reset', 0, CAST(0.7 AS DOUBLE)"
)



def stored(spark, sf):
    """The same upsert as a delta of a stored collection, then the toxic ones
    taken out."""
    existing, batch = _existing_and_batch(spark, sf)
    folder = shared_dir(spark, "collection")
    coll.write_base(existing, folder)
    coll.write_upsert(batch, folder)
    coll.write_removal(read(spark, sf, "labels").filter("toxic = 1").select(F.concat(F.lit("c"), "doc_id").alias("id")), folder)
    return coll.read_stored(spark, folder)


QUERIES["stored_collection"] = lambda spark, sf: stored(spark, sf).select(
    "id", F.md5("text").alias("text_md5"), "metadata.source_name", "metadata.medical_category")
SQL["stored_collection"] = (
    f"WITH {UPSERTED} SELECT id, md5(text) AS text_md5, source_name, medical_category FROM merged "
    "WHERE NOT EXISTS (SELECT 1 FROM labels WHERE toxic = 1 AND 'c' || labels.doc_id = merged.id)"
)

# ------------------------------------------------------------------- vectors
QUERIES["metadata_filtered_search"] = lambda spark, sf: retrieval.nearest(
    as_queries(spark, sf), vectors(spark, sf), 3, {"label": 2}).select("query_id", "id", "rank", F.round("vector_score", R).alias("vector_score"))
SQL["metadata_filtered_search"] = f"WITH {EMB}, {sql_near(3, 'label = 2')} SELECT query_id, id, rank, round(vector_score, {R}) AS vector_score FROM near"
QUERIES["nearest_neighbours"] = lambda spark, sf: retrieval.nearest(
    as_queries(spark, sf), vectors(spark, sf), 32).select("query_id", "id", "rank", F.round("vector_score", R).alias("vector_score"))
SQL["nearest_neighbours"] = f"WITH {EMB}, {sql_near(32)} SELECT query_id, id, rank, round(vector_score, {R}) AS vector_score FROM near"
QUERIES["vector_array_scoring"] = lambda spark, sf: vectors(spark, sf).select(
    "id", F.round(hooks.dot(hooks.unit_vector(F.col("embedding")), hooks.unit_vector(F.col("embedding"))), R).alias("self_similarity"),
    F.round(F.greatest(F.lit(0.0), F.lit(1.0) - (F.lit(1.0) - F.element_at(hooks.unit_vector(F.col("embedding")), 1)) / 2), R).alias("axis_score"))
SQL["vector_array_scoring"] = (
    f"SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), {R}) AS self_similarity, "
    f"round(greatest(0.0, 1 - (1 - CAST(embedding[1] AS DOUBLE) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) / 2), {R}) AS axis_score FROM embeddings"
)
QUERIES["text_embedding"] = lambda spark, sf: texts(spark, sf).select("id", F.posexplode("embedding").alias("dim", "v")).filter("v > 0").select(
    "id", "dim", F.round("v", R).alias("v"))
SQL["text_embedding"] = (
    f"WITH {sql_hashed('documents', 'doc_id', 'text', 'dv')}, n AS (SELECT doc_id AS id, e, sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) AS norm, "
    f"unnest(range(0, {hooks.HASH_DIM})) AS dim FROM dv) SELECT id, dim, round(e[dim + 1] / norm, {R}) AS v FROM n WHERE e[dim + 1] > 0"
)

# ------------------------------------------------------------------ keywords
QUERIES["term_frequency"] = lambda spark, sf: retrieval.term_frequencies(read(spark, sf, "documents"), "doc_id").select(
    "doc_id", "term", F.round("tf", R).alias("tf"))
SQL["term_frequency"] = (
    f"WITH t AS (SELECT doc_id, {SQL_KEYWORDS.format('text')} AS t FROM documents), u AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM t) "
    f"SELECT doc_id, term, round(count(*) / greatest(any_value(n), 1), {R}) AS tf FROM u GROUP BY doc_id, term"
)


def candidate_pool(spark, sf):
    """The 20 nearest documents of every benchmark passage."""
    near = retrieval.nearest(item_queries(spark, sf), texts(spark, sf), 20).select("query_id", "id", "vector_score")
    return materialise(near.join(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), "pool")


POOL = (
    f"{DOCS}, {sql_near(20)}, pool AS (SELECT n.query_id, n.id, n.vector_score, r.text, qs.query_text FROM near n JOIN rows r USING (id) JOIN qs USING (query_id)), "
    f"qt AS (SELECT query_id, unnest({SQL_KEYWORDS.format('query_text')}) AS term FROM qs), "
    "idf AS (SELECT t.query_id, t.term, ln((count(*) + 1) / (count(*) FILTER (contains(lower(p.text), t.term)) + 1)) + 1 AS idf "
    "FROM (SELECT DISTINCT * FROM qt) t JOIN pool p USING (query_id) GROUP BY 1, 2), "
    f"dt AS (SELECT id, unnest(t) AS term, len(t) AS n FROM (SELECT id, {SQL_KEYWORDS.format('text')} AS t FROM rows)), "
    "tf AS (SELECT id, term, count(*) / any_value(n) AS tf FROM dt GROUP BY 1, 2), "
    "nq AS (SELECT query_id, count(*) AS n FROM qt GROUP BY 1), "
    "kw AS (SELECT p.query_id, p.id, p.vector_score, least(coalesce(sum(tf.tf * idf.idf), 0.0) / coalesce(any_value(nq.n), 1), 1.0) AS keyword_score FROM pool p "
    "LEFT JOIN nq ON nq.query_id = p.query_id LEFT JOIN qt ON qt.query_id = p.query_id LEFT JOIN idf ON idf.query_id = qt.query_id AND idf.term = qt.term "
    "LEFT JOIN tf ON tf.id = p.id AND tf.term = qt.term GROUP BY 1, 2, 3)"
)


def idfs(spark, sf):
    terms = items(spark, sf).select("query_id", F.explode(F.array_distinct(text.keyword_tokens("query_text"))).alias("term"))
    return retrieval.pool_idf(terms, candidate_pool(spark, sf)).select("query_id", "term", F.round("idf", R).alias("idf"))


QUERIES["pool_idf"] = idfs
SQL["pool_idf"] = f"WITH {POOL} SELECT query_id, term, round(idf, {R}) AS idf FROM idf"
QUERIES["keyword_score"] = lambda spark, sf: retrieval.keyword_scores(items(spark, sf), candidate_pool(spark, sf)).select(
    "query_id", "id", F.round("keyword_score", R).alias("keyword_score"))
SQL["keyword_score"] = f"WITH {POOL} SELECT query_id, id, round(keyword_score, {R}) AS keyword_score FROM kw"


def fusion(spark, sf):
    pool = candidate_pool(spark, sf)
    keyword = retrieval.keyword_scores(items(spark, sf), pool)
    both = pool.drop("text").join(keyword, ["query_id", "id"])
    return both.select(
        "query_id", "id", F.round(retrieval.fuse(F.col("vector_score"), F.col("keyword_score")), R).alias("score"),
        F.round(retrieval.fuse(F.col("vector_score"), F.col("keyword_score"), 0.2), R).alias("keyword_heavy"))


QUERIES["hybrid_fusion"] = fusion
SQL["hybrid_fusion"] = (
    f"WITH {POOL} SELECT query_id, id, round(0.7 * vector_score + 0.3 * keyword_score, {R}) AS score, "
    f"round(0.2 * vector_score + 0.8 * keyword_score, {R}) AS keyword_heavy FROM kw"
)
QUERIES["hybrid_search"] = lambda spark, sf: search.hybrid_search(item_queries(spark, sf), texts(spark, sf), 5).select(
    "query_id", "id", "rank", F.round("score", R).alias("score"))
SQL["hybrid_search"] = (
    f"WITH {POOL} SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(0.7 * vector_score + 0.3 * keyword_score, 9) DESC, id) AS rank, "
    f"round(round(0.7 * vector_score + 0.3 * keyword_score, 9), {R}) AS score FROM kw) WHERE rank <= 5"
)
QUERIES["top_k_per_query"] = lambda spark, sf: retrieval.top_k(
    read(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", 5, "n_chars", "doc_id").select("source", "doc_id", "rank")
SQL["top_k_per_query"] = "SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 5"


# ------------------------------------------------------------ merge and rerank
def variant_hits(spark, sf):
    """Neighbours by label group as if found by three variants of one query."""
    e = read(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("query_id"), F.pmod("event_id", F.lit(11)).alias("id"), F.pmod("event_id", F.lit(3)).cast("int").alias("variant_no"),
        (F.col("value") / 100).alias("vector_score"), F.lit(0.0).alias("keyword_score"), F.round(F.col("value") / 10, 0).alias("score"))


VARIANT_HITS = (
    "hits AS (SELECT user_id AS query_id, event_id % 11 AS id, event_id % 3 AS variant_no, value / 100 AS vector_score, round(value / 10, 0) AS score FROM events), "
    "merged AS (SELECT query_id, id, max(score) AS score, arg_max(variant_no, [score, -variant_no]) AS variant_no, "
    "string_agg(DISTINCT variant_no, ',' ORDER BY variant_no) AS variants FROM hits GROUP BY 1, 2)"
)
QUERIES["variant_merge"] = lambda spark, sf: retrieval.merge_variants(variant_hits(spark, sf)).select(
    "query_id", "id", "score", "variant_no", F.array_join(F.col("matched_variants").cast("array<string>"), ",").alias("variants"))
SQL["variant_merge"] = f"WITH {VARIANT_HITS} SELECT query_id, id, score, variant_no, variants FROM merged"


def answers(spark, sf):
    merged = retrieval.merge_variants(variant_hits(spark, sf))
    return merged.filter((F.col("query_id") + F.col("id")) % 4 != 0).select(
        "query_id", "id", F.when((F.col("query_id") + F.col("id")) % 4 == 1, "n/a").otherwise(
            F.concat(F.col("id") / 8, F.lit(" of 1"))).alias("answer"))


SQL_RERANK = "CASE (query_id + id) % 4 WHEN 0 THEN -1.0 WHEN 1 THEN -1.0 ELSE least(id / 8, 1.0) END"
QUERIES["model_score_join"] = lambda spark, sf: retrieval.rerank(
    retrieval.merge_variants(variant_hits(spark, sf)), answers(spark, sf), k=0).select("query_id", "id", F.round("rerank_score", R).alias("rerank_score"))
SQL["model_score_join"] = f"WITH {VARIANT_HITS} SELECT query_id, id, round({SQL_RERANK}, {R}) AS rerank_score FROM merged"
QUERIES["rerank_gate"] = lambda spark, sf: retrieval.rerank(
    retrieval.merge_variants(variant_hits(spark, sf)), answers(spark, sf), k=10).select(
    "query_id", "id", F.round("relevance_score", R).alias("relevance_score"))
SQL["rerank_gate"] = (
    f"WITH {VARIANT_HITS}, g AS (SELECT *, count(*) OVER (PARTITION BY query_id) > 10 AS gate, {SQL_RERANK} AS rr FROM merged) "
    f"SELECT query_id, id, round(CASE WHEN gate AND rr >= 0 THEN 0.3 * score + 0.7 * rr ELSE score END, {R}) AS relevance_score FROM g"
)


def context(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("lang").alias("query_id"), "doc_id", "text", "source", "n_chars")
    return retrieval.numbered_context(retrieval.top_k(docs, "query_id", 5, "n_chars", "doc_id"))


QUERIES["numbered_context"] = context
SQL["numbered_context"] = (
    "WITH r AS (SELECT lang AS query_id, text, source, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) "
    "SELECT query_id, string_agg('[' || rank || '] ' || substr(text, 1, 400) || ' (source: ' || source || ')', chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 4 GROUP BY 1"
)


# ------------------------------------------------------------------- retrieve
def _terms(spark, sf):
    """Symptoms of a query stand-in: its last words as standard and English terms."""
    w = text.words("query_text")
    pair = F.array(*[F.struct(F.element_at(w, -1).alias("msa_equivalent"), x.alias("english_medical_term")) for x in (F.lit(""), F.element_at(w, 1))])
    return items(spark, sf).select("query_id", F.when(F.col("query_id") % 3 > 0, pair).alias("symptoms"))


SQL_W = "regexp_split_to_array(" + sql_strip("text") + ", '\\s+')"
VARIANTS = (
    f"bundle AS (SELECT item_id AS query_id, {sql_strip('text')} AS o, CASE WHEN item_id % 3 > 0 THEN {SQL_W}[-1] ELSE {sql_strip('text')} END AS m, "
    f"CASE WHEN item_id % 3 > 0 THEN {SQL_W}[1] ELSE {sql_strip('text')} END AS e FROM benchmark), "
    "variants0 AS (SELECT query_id, 0 AS p, o AS query_text FROM bundle UNION ALL SELECT query_id, 1, m FROM bundle WHERE m <> o UNION ALL SELECT query_id, 2, e FROM bundle WHERE e <> o AND e <> m), "
    "variants AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) - 1 AS BIGINT) AS variant_no, query_text FROM variants0)"
)
QUERIES["query_variants"] = lambda spark, sf: search.query_variants(items(spark, sf), _terms(spark, sf))
SQL["query_variants"] = f"WITH {VARIANTS} SELECT query_id, variant_no, query_text FROM variants"


def _half_score(texts_: list[str]) -> list[str]:
    return [f"{len(t) % 10 / 10}" if len(t) % 3 else "unsure" for t in texts_]


def retrieved(spark, sf):
    return search.retrieve(
        items(spark, sf), texts(spark, sf), lambda df: hooks.embed(df, "query_text"), _terms(spark, sf),
        lambda df: hooks.score(df, "prompt", _half_score).select("query_id", "id", "answer"),
    ).select("query_id", "id", "rank", F.round("relevance_score", R).alias("relevance_score"), F.round("rerank_score", R).alias("rerank_score"))


QUERIES["retrieve_passages"] = retrieved
PROMPT_LEN = (
    f"length(replace(replace({q(copy.PROMPTS['rerank'])}, '{{query}}', b.text), '{{chunk}}', substr(d.text, 1, {fv.RERANK_CHARS})))"
)
SQL["retrieve_passages"] = (
    f"WITH {sql_hashed('documents', 'doc_id', 'text', 'dv')}, {VARIANTS}, vt AS (SELECT row_number() OVER () AS tid, query_text FROM (SELECT DISTINCT query_text FROM variants)), "
    + sql_hashed("vt", "tid", "query_text", "iv")
    + ", rows AS (SELECT doc_id AS id, e AS embedding, text, lang FROM dv JOIN documents USING (doc_id)), qs AS (SELECT tid AS query_id, e AS embedding, query_text FROM iv JOIN vt USING (tid)), "
    + POOL[POOL.index("near AS"):].replace("rank <= 20", f"rank <= {4 * fv.CANDIDATES_PER_QUERY}")
    + f", found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(0.7 * vector_score + 0.3 * keyword_score, 9) AS score FROM kw)) WHERE rank <= {fv.CANDIDATES_PER_QUERY}), "
    "merged AS (SELECT v.query_id, f.id, max(f.score) AS score FROM variants v JOIN vt ON vt.query_text = v.query_text JOIN found f ON f.query_id = vt.tid GROUP BY 1, 2), "
    f"ans AS (SELECT m.*, count(*) OVER (PARTITION BY m.query_id) > {fv.TOP_K} AS gate, {PROMPT_LEN} AS pl FROM merged m JOIN documents d ON d.doc_id = m.id JOIN benchmark b ON b.item_id = m.query_id), "
    "rr AS (SELECT query_id, id, score, CASE WHEN gate AND pl % 3 <> 0 THEN (pl % 10) / 10 ELSE -1.0 END AS rerank_score FROM ans), "
    "fin AS (SELECT *, round(CASE WHEN rerank_score >= 0 THEN 0.3 * score + 0.7 * rerank_score ELSE score END, 9) AS rel FROM rr) "
    f"SELECT query_id, id, rank, round(rel, {R}) AS relevance_score, round(rerank_score, {R}) AS rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, id) AS rank FROM fin) WHERE rank <= {fv.TOP_K}"
)
