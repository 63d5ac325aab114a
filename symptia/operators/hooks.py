"""Where outside models plug in: embedders, scorers, tokenisers.

A hook is a plain function over a list of strings. Spark feeds it in Arrow
batches, so a real client can sit behind it; the defaults need no network.
Tokenisers are column functions (see :func:`symptia.functions.text.pieces`).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symptia.functions import fixed_values as fv

HASH_DIM = 64
Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str]], list[str | None]]


def batched(fn: Callable[[list[str]], list], texts: list[str], size: int) -> list:
    """``fn`` over slices of at most ``size`` texts, results in order."""
    out: list = []
    for at in range(0, len(texts), size):
        part = fn(texts[at : at + size])
        if len(part) != len(texts[at : at + size]):
            raise ValueError("a hook must return one result per text")
        out.extend(part)
    return out


def in_slices(fn: Callable[[list[str]], list], column: pa.Array, size: int, kind: pa.DataType) -> pa.Array:
    """``fn`` over slices of a column, NULL as ''. The strings and results of a
    slice are let go before the next: Python objects take many times the room
    of an array, and an Arrow batch may hold 10,000 long texts."""
    parts = [
        pa.array(batched(fn, [t or "" for t in column.slice(at, size).to_pylist()], size), kind)
        for at in range(0, len(column), size)
    ]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def embed(df: DataFrame, text_col: str, fn: Embedder | None = None, out: str = "embedding",
          batch: int = fv.EMBED_BATCH) -> DataFrame:
    """Adds a vector column; ``fn`` sees at most ``batch`` texts per call."""
    fn = fn or hashed_features

    @F.arrow_udf("array<double>")
    def vectors(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield in_slices(fn, column, batch, pa.list_(pa.float64()))

    return df.withColumn(out, vectors(text_col))


def score(df: DataFrame, prompt_col: str, fn: Scorer, out: str = "answer", batch: int = fv.EMBED_BATCH) -> DataFrame:
    """Adds the raw answer of a scorer or judge; parse it with
    :mod:`symptia.functions.parsing`. A NULL answer is a failed call."""

    @F.arrow_udf("string")
    def answers(prompts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in prompts:
            yield in_slices(fn, column, batch, pa.string())

    return df.withColumn(out, answers(prompt_col))


_WORD = re.compile(r"[^\W_]+")


def hashed_features(texts: list[str], dim: int = HASH_DIM) -> list[list[float]]:
    """Unit vectors of hashed word counts: deterministic, no model needed."""
    buckets: dict[str, int] = {}
    rows = []
    for t in texts:
        row = [0.0] * dim
        for w in _WORD.findall(t.lower()):
            if w not in buckets:
                buckets[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
            row[buckets[w]] += 1.0
        norm = math.sqrt(sum(v * v for v in row))
        rows.append([v / norm for v in row] if norm else row)
    return rows


def unit_vector(vector: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, v: a + v * v))
    return F.when(norm > 0, F.transform(wide, lambda v: v / norm)).otherwise(wide)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, v: s + v)
