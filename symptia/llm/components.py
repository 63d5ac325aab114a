"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symptia.llm.common import materialise, release

EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class Forest:
    """Union-find over the nodes seen so far, each set named by its smallest."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != x:
            parent[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        a, b = min(a, b), max(a, b)
        self.parent[b] = a
        self.parent.setdefault(a, a)
        return True


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    flat = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], schema=EDGES)


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a batch's edges only as many as hold its nodes together."""
    for batch in batches:
        forest = Forest()
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
        yield edge_batch([(x, forest.root(x)) for x in forest.parent if forest.root(x) != x])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest
    node of its component; nodes are longs and never null.

    Alternates large-star and small-star steps: each links the neighbours of a
    node to the smallest among them, with grouped minima and equality joins
    only, so no node's neighbours meet in one task. The edges of every round
    are written to the shared folder, and only their number and a checksum
    reach the driver.
    """
    step = materialise(edges.select("a", "b").filter("a <> b").mapInArrow(_forest, "a long, b long"), "edges")
    before = None
    while True:
        both = step.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            step.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        done, step = step, materialise(small.distinct(), "edges")
        release(done)
        after = tuple(step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if after == before:
            break
        before = after
    # the edges of the last round stay until the session's folder goes
    roots = step.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
