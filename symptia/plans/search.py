"""Hybrid search and multi-variant retrieval over a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv
from symptia.functions import messages, text
from symptia.operators import retrieval
from symptia.session import broadcast_if_small, materialise


def hybrid_search(
    queries: DataFrame, collection: DataFrame, k: int = fv.TOP_K, filters: dict | None = None,
    alpha: float = fv.DEFAULT_ALPHA, **options,
) -> DataFrame:
    """The k best rows per query by fused score.

    ``queries`` (query_id, query_text, embedding), ``collection`` (id,
    embedding, text, ...). The vector side picks ``4k`` candidates, which are
    also the pool the keyword weights are computed over. Texts are fetched
    for candidates only: the search itself reads ids and vectors.
    """
    near = retrieval.nearest(queries, collection, fv.POOL_FACTOR * k, filters, **options)
    # written once: it feeds the text lookup, the scores and the result
    near = materialise(near.select("query_id", "id", "vector_score"), "candidates")
    pool = near.join(
        collection.select("id", "text").join(broadcast_if_small(near.select("id").distinct()), "id", "left_semi"), "id"
    )
    keyword = retrieval.keyword_scores(queries, pool)
    fused = near.join(keyword, ["query_id", "id"], "left").select(
        "query_id", "id", "vector_score", F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"),
    )
    scored = fused.withColumn("score", F.round(retrieval.fuse(F.col("vector_score"), F.col("keyword_score"), alpha), retrieval.DIGITS))
    return retrieval.top_k(scored, "query_id", k, "score", "id")


def query_variants(queries: DataFrame, symptoms: DataFrame | None = None) -> DataFrame:
    """Long form (query_id, variant_no, query_text) of the query bundle: the
    query, its standard-Arabic terms and its English terms, without repeats.

    ``symptoms`` (query_id, symptoms) holds ordered matches; without terms a
    variant falls back to the query and disappears as a repeat.
    """
    original = text.strip("query_text")
    if symptoms is None:
        variants = text.ordered_distinct(original)
    else:
        queries = queries.join(symptoms, "query_id", "left")

        def terms(field: str):
            names = F.filter(F.transform("symptoms", lambda m: m[field]), lambda s: s != "")
            joined = F.array_join(F.array_distinct(names), " ")
            return F.coalesce(F.nullif(joined, F.lit("")), original)

        variants = text.ordered_distinct(original, terms("msa_equivalent"), terms("english_medical_term"))
    return queries.select("query_id", F.posexplode(variants).alias("variant_no", "query_text"))


def retrieve(
    queries: DataFrame, collection: DataFrame, embed, symptoms: DataFrame | None = None, score=None,
    candidates: int = fv.CANDIDATES_PER_QUERY, k: int = fv.TOP_K, rerank: bool = True,
    filters: dict | None = None, alpha: float = fv.DEFAULT_ALPHA,
) -> DataFrame:
    """Ranked passages per query over all its variants.

    ``embed`` adds an embedding column to (…, query_text); ``score`` turns
    (query_id, id, prompt) into (query_id, id, answer), or is None.
    """
    variants = query_variants(queries, symptoms)
    # a variant text is searched once even when many queries share it
    key = F.sha2("query_text", 256)
    distinct = embed(variants.select(key.alias("query_id"), "query_text").distinct())
    found = hybrid_search(distinct, collection, candidates, filters, alpha).drop("rank").withColumnRenamed("query_id", "text_key")
    hits = variants.select("query_id", "variant_no", key.alias("text_key")).join(found, "text_key")
    merged = materialise(retrieval.merge_variants(hits), "merged")
    answers = None
    if rerank and score is not None:
        wanted = merged.join(collection.select("id", "text").join(broadcast_if_small(merged.select("id").distinct()), "id", "left_semi"), "id")
        prompts = wanted.join(queries.select("query_id", "query_text"), "query_id").select(
            "query_id", "id",
            text.fill(messages.PROMPTS["rerank"], query=F.col("query_text"), chunk=text.truncate("text", fv.RERANK_CHARS)).alias("prompt"))
        answers = score(prompts)
    ranked = retrieval.rerank(merged, answers, k, rerank)
    ranked = ranked.withColumn("relevance_score", F.round("relevance_score", retrieval.DIGITS))
    return retrieval.top_k(ranked, "query_id", k, "relevance_score", "id")
