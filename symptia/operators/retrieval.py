"""Exact nearest neighbours, keyword scoring, fusion, merging and reranking.

Nearest neighbours never pair rows in a join. A task turns the vectors of its
partitions into matrices, multiplies them with a block of queries and keeps a
running top list, so it emits ``tasks x queries x k`` rows, not one row per
pair. The number of tasks is bounded, however many partitions there are. Few
queries are broadcast; many are spread over blocks that the rows stream past.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from symptia.functions import fixed_values as fv
from symptia.functions import messages, parsing, text
from symptia.functions.rows import explode_rows, join_on
from symptia.session import materialise

# Queries sent to every task: 20,000 vectors of 768 doubles are about 120 MB.
BROADCAST_QUERIES = 20_000
# Tasks of a search per core: partitions are read one after another into the same
# top list, so that their number does not multiply what is shuffled.
SEARCH_TASKS = 4
# Similarities are compared after rounding, so equal vectors tie exactly
# whatever order a matrix product added them in; ties go to the smaller id.
DIGITS = 9
# Queries of a task where they are too many to broadcast.
GRID_ROWS = 50_000


def metadata_filter(df: DataFrame, filters: dict | None) -> DataFrame:
    """Keep rows equal to every given value. It runs before the search and is
    pushed into the file scan."""
    if not filters:
        return df
    return df.filter(functools.reduce(lambda a, b: a & b, [F.col(k) == v for k, v in filters.items()]))


# ---------------------------------------------------------- nearest neighbours
def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _ids(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.asarray(column.to_pylist())


def _similarity(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """In one array, as a tile is the largest thing a search holds."""
    out = queries @ rows.T
    out += 1.0
    out /= 2.0
    np.maximum(out, 0.0, out=out)
    return np.round(out, DIGITS, out=out)


# One similarity block: 512 queries by 2,048 rows of doubles are 8 MB, of which
# a tile needs up to four at a time.
TILE_QUERIES, TILE_ROWS = 512, 2048


class _Tiles:
    """Top lists of any number of queries, worked on in bounded tiles."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.tops = [_Top(queries[at : at + TILE_QUERIES], k) for at in range(0, len(queries), TILE_QUERIES)]

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        by_id = np.argsort(ids, kind="stable")
        for at in range(0, len(by_id), TILE_ROWS):
            part = by_id[at : at + TILE_ROWS]
            for top in self.tops:
                top.add(rows[part], ids[part])

    def batches(self, query_ids: pa.Array, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The lists of one tile of queries at a time, from arrays."""
        for i, top in enumerate(self.tops):
            if top.scores is not None:
                own = query_ids.slice(i * TILE_QUERIES, len(top.scores))
                places = pa.array(np.repeat(np.arange(len(own)), top.scores.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [own.take(places), pa.array(top.ids.reshape(-1), id_type), pa.array(top.scores.reshape(-1))],
                    names=["query_id", "id", "vector_score"])


class _Top:
    """Running top list of every query over the rows seen so far, ordered by
    similarity and then by id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.scores, self.ids = None, None

    def add(self, rows: np.ndarray, ids: np.ndarray) -> None:
        """Rows come in the order of their ids."""
        self._merge(*self._first_k(_similarity(self.queries, rows), ids))

    def _first_k(self, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best columns of every row; equal scores by column order."""
        if scores.shape[1] <= self.k:
            return scores, np.broadcast_to(ids, scores.shape)
        kth = np.partition(scores, -self.k, axis=1)[:, -self.k][:, None]
        above, ties = scores > kth, scores == kth
        room = self.k - above.sum(axis=1, keepdims=True)
        columns = np.nonzero(above | (ties & (np.cumsum(ties, axis=1) <= room)))[1].reshape(-1, self.k)
        return np.take_along_axis(scores, columns, axis=1), ids[columns]

    def _merge(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.scores is not None:
            scores = np.concatenate([self.scores, scores], axis=1)
            ids = np.concatenate([self.ids, ids], axis=1)
        order = np.argsort(ids, axis=1, kind="stable")
        scores, ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)
        order = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores, self.ids = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _candidates_schema(queries: DataFrame, collection: DataFrame) -> str:
    q, c = queries.schema["query_id"].dataType.simpleString(), collection.schema["id"].dataType.simpleString()
    return f"query_id {q}, id {c}, vector_score double"


def _broadcast_top(collection: DataFrame, queries: pa.Table, k: int, schema: str) -> DataFrame:
    spark = collection.sparkSession
    query_ids, vectors = queries["query_id"].combine_chunks(), queries["embedding"].combine_chunks()
    block = _matrix(vectors, len(vectors[0]))
    id_type = to_arrow_type(collection.schema["id"].dataType)
    shared = spark.sparkContext.broadcast((query_ids, block))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        top = _Tiles(matrix, k)
        for b in batches:
            if b.num_rows:
                top.add(_matrix(b.column("embedding"), matrix.shape[1]), _ids(b.column("id")))
        yield from top.batches(ids, id_type)

    tasks = SEARCH_TASKS * spark.sparkContext.defaultParallelism
    return collection.select("id", "embedding").coalesce(tasks).mapInArrow(task, schema)


def _grid_top(collection: DataFrame, queries: DataFrame, k: int, schema: str, n_queries: int) -> DataFrame:
    """Blocks of queries against slices of the rows. A task holds one block of
    queries with its top lists; its rows follow in Arrow batches and are not
    held, however many there are. There are as many slices as make a task for
    every core. Blocks come from hashed ids, so none grows with a hot value."""
    cores = collection.sparkSession.sparkContext.defaultParallelism
    blocks = -(-n_queries // GRID_ROWS)
    slices = max(1, -(-SEARCH_TASKS * cores // blocks))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(name, F.lit(n)), F.lit(n)).cast("int")

    none = {n: F.lit(None).cast(df.schema[c].dataType) for n, df, c in (("query_id", queries, "query_id"), ("id", collection, "id"))}
    vector = F.col("embedding").cast("array<double>").alias("embedding")
    left = queries.select("query_id", none["id"].alias("id"), vector, part("query_id", blocks).alias("qb")).withColumn("cb", every(slices))
    right = collection.select(none["query_id"].alias("query_id"), "id", vector, part("id", slices).alias("cb")).withColumn("qb", every(blocks))
    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1))).withColumn("task", F.col("qb") * slices + F.col("cb"))
    id_type = to_arrow_type(collection.schema["id"].dataType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tasks one after the other, each with its queries first."""
        task, held, top = None, [], None
        for batch in batches:
            marks = batch.column("task").to_numpy() * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(marks)) + 1).tolist(), len(marks)] if len(marks) else []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if marks[a] // 2 != task:
                    if top is not None:
                        yield from top.batches(ids, id_type)
                    task, held, top = marks[a] // 2, [], None
                piece = batch.slice(a, b - a)
                if marks[a] % 2 == 0:
                    held.append((piece.column("query_id"), _matrix(piece.column("embedding"), len(piece.column("embedding")[0]))))
                elif held or top is not None:
                    if top is None:
                        ids, block = pa.concat_arrays([i for i, _ in held]), np.concatenate([m for _, m in held])
                        top, held = _Tiles(block, k), []
                    top.add(_matrix(piece.column("embedding"), block.shape[1]), _ids(piece.column("id")))
        if top is not None:
            yield from top.batches(ids, id_type)

    placed = both.repartition(blocks * slices, "task").sortWithinPartitions("task", "side")
    return placed.select("task", "side", "query_id", "id", "embedding").mapInArrow(search, schema)


def nearest(
    queries: DataFrame, collection: DataFrame, k: int, filters: dict | None = None,
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """The k most similar rows per query: query_id, id, vector_score, rank.

    ``queries`` (query_id, embedding) and ``collection`` (id, embedding).
    Similarity is ``max(0, 1 - cosine distance / 2)``; the search is exact.
    Rows and queries without a vector take no part.
    """
    collection = metadata_filter(collection, filters).filter(F.col("embedding").isNotNull())
    queries = queries.filter(F.col("embedding").isNotNull())
    schema = _candidates_schema(queries, collection)
    queries = queries.select("query_id", "embedding")
    # the size check reads at most one query more than may be broadcast
    first = queries.limit(broadcast_queries + 1).toArrow()
    if not first.num_rows:
        return collection.sparkSession.createDataFrame([], schema + ", rank int")
    if first.num_rows <= broadcast_queries:
        partial = _broadcast_top(collection, first, k, schema)
    else:
        partial = _grid_top(collection, queries, k, schema, queries.count())
    return top_k(partial, "query_id", k, "vector_score", "id")


def top_k(df: DataFrame, by: str, k: int, score: str, tiebreak: str) -> DataFrame:
    """The k best per group. ``row_number() <= k`` is applied per partition
    before the shuffle, so a hot group sends at most k rows from each task."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), F.col(tiebreak))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


# ------------------------------------------------------------ keyword scoring
def term_frequencies(docs: DataFrame, id_col: str) -> DataFrame:
    """Count of each keyword over the number of keywords of its document.

    Counted inside the row, along its sorted keywords, so that no keyword is
    shuffled. Ids are, to find those of several rows; only these rows are grouped.
    """
    again = materialise(docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1").select(id_col), "again")
    if again.isEmpty():
        return _row_frequencies(docs, id_col)
    tokens = join_on(docs, again, [id_col], "left_semi").select(id_col, text.keyword_tokens("text").alias("_t"))
    grouped = (
        explode_rows(tokens, [id_col, F.greatest(F.size("_t"), F.lit(1)).alias("_len")], F.col("_t"), "term")
        .groupBy(id_col, "term")
        .agg((F.count("*") / F.first("_len")).alias("tf"))
    )
    return _row_frequencies(join_on(docs, again, [id_col], "left_anti"), id_col).unionByName(grouped)


def _row_frequencies(docs: DataFrame, id_col: str) -> DataFrame:
    tokens, n = docs.select(id_col, F.sort_array(text.keyword_tokens("text")).alias("_t")), F.size("_t")
    # where the sorted keywords change; a term's count reaches to the next place
    starts = F.when(n > 0, F.filter(
        F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))))
    terms = F.transform("_at", lambda at, i: F.struct(
        F.get("_t", at).alias("term"), (F.coalesce(F.get("_at", i + 1), n) - at).alias("n")))
    runs = explode_rows(tokens.select("*", starts.alias("_at")), [id_col, n.alias("_len")], terms, "_run")
    return runs.select(id_col, "_run.term", (F.col("_run.n") / F.col("_len")).alias("tf"))


def pool_idf(terms: DataFrame, pool: DataFrame) -> DataFrame:
    """``ln((N+1)/(df+1)) + 1`` per query term over the candidates of that
    query; a document counts when it contains the term as a substring.

    ``terms`` (query_id, term) distinct, ``pool`` (query_id, id, text).
    """
    joined = terms.join(pool.select("query_id", F.lower("text").alias("_l")), "query_id")
    return joined.groupBy("query_id", "term").agg(
        (F.log((F.count("*") + 1) / (F.count_if(F.contains("_l", F.col("term"))) + 1)) + 1.0).alias("idf")
    )


def keyword_scores(queries: DataFrame, pool: DataFrame) -> DataFrame:
    """Keyword score per candidate: query_id, id, keyword_score.

    ``queries`` (query_id, query_text), ``pool`` (query_id, id, text) with the
    few candidates of each query. Term weights are computed once per query
    and candidate tokens once per row; terms count as often as they occur.
    """
    terms = queries.select("query_id", text.keyword_tokens("query_text").alias("_terms"))
    joined = pool.join(terms, "query_id").withColumn("_l", F.lower("text"))
    distinct_terms = F.array_distinct("_terms")
    # documents of the pool per term, as one array aligned with the terms
    contained = explode_rows(
        joined, ["query_id"], F.transform(distinct_terms, lambda t: F.contains(F.col("_l"), t).cast("int")), "_in", "_pos"
    )
    weights = (
        contained.groupBy("query_id", "_pos")
        .agg((F.log((F.count("*") + 1) / (F.sum("_in") + 1)) + 1.0).alias("_idf"))
        .groupBy("query_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_idf"))), lambda s: s["_idf"]).alias("_idfs"))
    )
    scored = joined.withColumn("_tokens", text.keyword_tokens("text")).join(weights, "query_id", "left")

    def weight(t: Column) -> Column:
        uses = F.size(F.filter(F.col("_terms"), lambda u: u == t))
        hits = F.size(F.filter(F.col("_tokens"), lambda u: u == t))
        idf = F.element_at(F.col("_idfs"), F.array_position(distinct_terms, t).cast("int"))
        return uses * (hits / F.greatest(F.size("_tokens"), F.lit(1))) * idf

    shared = F.array_intersect(distinct_terms, F.col("_tokens"))
    total = F.aggregate(F.transform(shared, weight), F.lit(0.0), lambda a, v: a + v)
    return scored.select(
        "query_id", "id",
        F.when(F.size("_terms") == 0, 0.0).otherwise(F.least(total / F.size("_terms"), F.lit(1.0))).alias("keyword_score"),
    )


def fuse(vector: Column, keyword: Column, alpha: float | Column = fv.DEFAULT_ALPHA) -> Column:
    alpha = F.lit(alpha) if isinstance(alpha, (int, float)) else alpha
    return alpha * vector + (F.lit(1.0) - alpha) * keyword


# ------------------------------------------------------------ merge and rerank
def merge_variants(hits: DataFrame) -> DataFrame:
    """Best score per query and row over the query variants; on equal scores
    the earliest variant wins. All variants that found the row are listed."""
    best = F.max_by(F.struct("vector_score", "keyword_score", "score", "variant_no"), F.struct("score", -F.col("variant_no")))
    return (
        hits.groupBy("query_id", "id")
        .agg(best.alias("_b"), F.array_sort(F.collect_set("variant_no")).alias("matched_variants"))
        .select("query_id", "id", "_b.*", "matched_variants")
    )


def rerank(candidates: DataFrame, answers: DataFrame | None, k: int = fv.TOP_K, enabled: bool = True) -> DataFrame:
    """Blend model scores in when there are more candidates than results.

    ``answers`` (query_id, id, answer) holds raw model text; a missing or
    unreadable answer is -1 and leaves the score as it was.
    """
    w = Window.partitionBy("query_id")
    sized = candidates.withColumn("_gate", F.lit(enabled) & (F.count("*").over(w) > k))
    if answers is None:
        sized = sized.withColumn("answer", F.lit(None).cast("string"))
    else:
        sized = sized.join(answers, ["query_id", "id"], "left")
    scored = sized.withColumn(
        "rerank_score", F.when(F.col("_gate"), parsing.parse_score(F.col("answer"))).otherwise(fv.UNSCORED)
    )
    final = F.when(
        F.col("rerank_score") >= 0, fv.RERANK_BASE * F.col("score") + fv.RERANK_MODEL * F.col("rerank_score")
    ).otherwise(F.col("score"))
    return scored.withColumn("relevance_score", final).drop("_gate", "answer")


def numbered_context(results: DataFrame, limit: int = fv.CONTEXT_RESULTS, chars: int = fv.CONTEXT_CHARS) -> DataFrame:
    """Text block of the first results per query: query_id, context."""
    line = F.concat(F.lit("["), "rank", F.lit("] "), text.truncate("text", chars), F.lit(" (source: "), "source", F.lit(")"))
    shown = results.filter(F.col("rank") <= limit).select("query_id", "rank", line.alias("line"))
    return shown.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]), "\n\n").alias("context")
    )


def context_or_default(context: Column) -> Column:
    return F.coalesce(context, F.lit(messages.NO_CONTEXT))


__all__ = [
    "context_or_default", "fuse", "keyword_scores", "merge_variants", "metadata_filter",
    "nearest", "numbered_context", "pool_idf", "rerank", "term_frequencies", "top_k",
]
