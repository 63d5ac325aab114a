"""Exploding computed arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, keep: list, array: Column, out: str, pos: str | None = None) -> DataFrame:
    """``keep`` columns with one row per array element, as ``out``.

    A plain ``explode`` makes the optimizer add a filter ``size(array) > 0``
    below it, which computes a computed array twice. The outer form has no
    such filter; its one empty row per empty array is dropped above it.
    """
    # kept columns are computed below the generator, once per input row; next
    # to it they would be computed for every element
    staged = df.select(*keep, array.alias("_array"))
    names = [c for c in staged.columns if c != "_array"]
    item = F.col("_array")
    generated = F.posexplode_outer(item).alias(pos, out) if pos else F.explode_outer(item).alias(out)
    return staged.select(*names, generated).filter(F.col(out).isNotNull())


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which null keys are equal too; the keys appear once."""
    renamed = right.select(*[F.col(c).alias(f"_on_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return left.join(renamed, on, how).drop(*[f"_on_{k}" for k in keys])
