"""Approximate nearest neighbours on shifted Hilbert curves.

Vectors are projected to a few dimensions, each coordinate is levelled to its
share of the data, shifted, and the point's place on a Hilbert curve becomes
its key. Every ordering has its own projection and shift. Spark range-partitions
and sorts all orderings; a query looks at the windows around its own place in
each of them, and the windows' answers are merged and ranked by the exact
distance between the original vectors.

Equal vectors are one class, so copies neither crowd a window nor cost more than
one entry; a class carries the eleven smallest of its ids, which is all that ten
neighbours of one query can ever need.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symptia.llm.common import materialise, pieces_of

NEIGHBOURS = 10
ORDERINGS = 24
DIMENSIONS = 12  # of the curve
BITS = 5  # a dimension; 60 bits a key
#: Share of all vectors on either side of a query that each ordering shows it.
#: Vectors without any structure (evenly spread directions) need this much for
#: a recall of 0.9; structured ones can do with a fraction of it.
SHARE = 0.02
BUCKET = 2048  # vectors in a task's group
QUERIES = 4096  # queries in a task's group
SAMPLE = 4096  # vectors that the levels are fitted on
BATCH_BYTES = 1 << 20


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of integer points (rows) on the Hilbert curve of their space.

    Works down the bits from the highest: a coordinate with the bit set turns
    the lower bits of the first axis over, one without swaps them with the
    first axis; a Gray code over the axes then gives the place.
    """
    axes = points.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i, axis in enumerate(axes):
            up = (axis >> b) & 1
            swap = np.where(up == 1, 0, (axes[0] ^ axis) & low)
            axes[0] ^= np.where(up == 1, low, swap)
            if i:
                axis ^= swap
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turned = np.zeros(axes.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((axes[-1] >> b) & 1, (1 << b) - 1, 0)
    axes ^= turned
    key = np.zeros(axes.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for axis in axes:
            key = (key << 1) | ((axis >> b) & 1)
    return key


def fit(sample: np.ndarray, orderings: int = ORDERINGS, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per ordering its projection, its shifts, and the levels of a sample."""
    rng = np.random.default_rng(seed)
    width = sample.shape[1]
    out = []
    for _ in range(orderings):
        projection = np.linalg.qr(rng.normal(size=(width, min(DIMENSIONS, width))))[0]
        out.append((projection, rng.uniform(0, 1, projection.shape[1]), np.sort(sample @ projection, axis=0)))
    return out


def curve_keys(vectors: np.ndarray, projection: np.ndarray, shifts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    places = vectors @ projection
    shares = np.column_stack([np.searchsorted(own, p) / len(own) for own, p in zip(levels.T, places.T)])
    cells = ((shares + shifts) / 2 * (1 << BITS)).astype(np.int64)
    return hilbert_keys(np.minimum(cells, (1 << BITS) - 1), BITS)


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each pair once."""
    v = F.col("vector")
    sound = (F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
             & F.exists(v, lambda x: x != 0))
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(sound)
    sizes = own.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return own.filter(F.size("vector") == (sizes[0].size if sizes else 0)).dropDuplicates(["vec_id", "vector"])


def classes(own: DataFrame) -> DataFrame:
    """Distinct vectors: cls, vector, first and ids (its smallest ids)."""
    near = Window.partitionBy("vector", "salt").orderBy("vec_id")
    few = (
        own.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
        .withColumn("n", F.row_number().over(near)).filter(F.col("n") <= NEIGHBOURS + 1)
    )
    grouped = few.groupBy("vector").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, NEIGHBOURS + 1).alias("ids"))
    return grouped.select(F.monotonically_increasing_id().alias("cls"), "vector", F.col("ids")[0].alias("first"), "ids")


def _keyed(curves):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, BATCH_BYTES):
            vectors = matrix(batch.column("vector"))
            for ordering, curve in enumerate(curves.value if len(vectors) else ()):
                keys = pa.array(curve_keys(vectors, *curve))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(vectors), ordering, np.int32)), keys, *batch.columns],
                    ["ordering", "key", *batch.schema.names])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the place of each row among those of its ordering in a sorted
    partition."""
    last, n = -1, 0
    for batch in batches:
        orderings = batch.column("ordering").to_numpy()
        at = np.empty(len(orderings), np.int64)
        for ordering in np.unique(orderings):
            mine = np.flatnonzero(orderings == ordering)
            n = n if ordering == last else 0
            at[mine] = n + np.arange(len(mine))
            last, n = ordering, n + len(mine)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*batch.schema.names, "at"])


def _nearest(shown: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(shown) and len(asked):
        vectors = np.stack(shown["vector"].to_numpy()).astype(np.float64)
        cls, first = shown["cls"].to_numpy(), shown["first"].to_numpy()
        for query_id, query in zip(asked["query_id"], asked["vector"]):
            apart = np.sqrt(((vectors - np.asarray(query, np.float64)) ** 2).sum(axis=1))
            best = np.lexsort((first, apart))[: NEIGHBOURS + 1]
            out += zip([query_id] * len(best), cls[best], apart[best])
    return pd.DataFrame(out, columns=["query_id", "cls", "score"])


def search(vectors: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding",
           share: float = SHARE, orderings: int = ORDERINGS) -> DataFrame:
    """The nearest neighbours found of every row whose id is divisible by
    ``every``: query_id, rank, vec_id, score (Euclidean distance).

    Null ids, and vectors that are null, zero or hold a null, NaN or infinite
    component, take no part; nor do vectors of another length than the most
    frequent one. A row that is there twice counts once. Fewer candidates than
    ten are all returned; an empty table gives no rows. Equal distances go to
    the smaller id.
    """
    spark = vectors.sparkSession
    own = materialise(usable(vectors, vec_id, vector), "vectors")
    distinct = materialise(classes(own), "classes")
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("cls")).limit(SAMPLE).select("vector").toArrow()["vector"]
    curves = spark.sparkContext.broadcast(fit(matrix(sample.combine_chunks()), orderings) if total else [])
    kind = distinct.schema["vector"].dataType.simpleString()
    columns = f"ordering int, key long, cls long, vector {kind}, first long"
    keyed = distinct.select("cls", "vector", "first").mapInArrow(_keyed(curves), columns)
    ordered = keyed.repartitionByRange("ordering", "key", "cls").sortWithinPartitions("ordering", "key", "cls")
    placed = materialise(ordered.mapInArrow(_numbered, f"{columns}, at long").withColumn("part", F.spark_partition_id()), "curves")
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("ordering", "part").count().select(
        "ordering", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    bucket = F.floor((F.col("ahead") + F.col("at")) / BUCKET).alias("bucket")
    shown = placed.join(sizes, ["ordering", "part"]).select("ordering", bucket, "cls", "vector", "first")
    reach = max(1, math.ceil(share * total / BUCKET))
    asked = own.filter(F.col("vec_id") % every == 0).join(distinct.select("cls", "vector"), "vector").select(
        F.col("vec_id").alias("query_id"), "cls")
    parts = max(1, math.ceil((2 * reach + 1) * asked.count() * BUCKET / max(1, total) / QUERIES))
    # a window reaches over whole buckets on both sides of the query's own
    asked = shown.join(asked, "cls").select(
        F.col("ordering").alias("ordering"), F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach)).alias("bucket"),
        F.pmod(F.xxhash64("query_id"), F.lit(parts)).alias("part"), "query_id",
        F.col("vector").alias("vector"))
    shown = shown.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))
    group = ["ordering", "bucket", "part"]
    found = shown.groupBy(*group).cogroup(asked.groupBy(*group)).applyInPandas(_nearest, "query_id long, cls long, score double")
    merged = found.groupBy("query_id", "cls").agg(F.min("score").alias("score"))
    named = merged.join(distinct.select("cls", "ids"), "cls").select(
        "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id <> query_id")
    # an id that stands for several vectors counts with the nearest
    named = named.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= NEIGHBOURS).select(
        "query_id", "rank", "vec_id", "score")
