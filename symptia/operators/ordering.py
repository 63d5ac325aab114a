"""Running values over long ordered groups without one task per group.

A plain ordered window puts a whole key into one task. Here a key is cut into
buckets that follow its order; bucket totals are carried forward over the few
buckets of a key, and the window itself runs inside a bucket. A key holding a
third of all rows thus spreads over as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symptia.functions.rows import join_on

BLOCK = 1024
VALUE_BUCKETS = 256


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list, values: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums per key. ``bucket`` is a column that never
    falls along ``order``; ``order`` must be unique within a key."""
    parts = [*keys, bucket]
    totals = df.groupBy(*parts).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*parts, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in values])
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on(df, carried, parts)
    for n, v in values.items():
        joined = joined.withColumn(n, F.col(f"_{n}") + F.sum(v).over(inside))
    return joined.drop(*[f"_{n}" for n in values])


def preceding(df: DataFrame, keys: list[str], index: str, n: int, value: str, out: str) -> DataFrame:
    """Adds the values of the ``n`` rows before and of the row itself, oldest
    first. ``index`` counts the rows of a key from 1 without gaps; blocks of
    it form the windows, and the last ``n`` rows of a block are repeated as
    context of the next."""
    size = max(BLOCK, n)  # a block reaches into no block but the next
    block = F.floor((F.col(index) - 1) / size)
    own = F.struct(block.alias("b"), F.lit(False).alias("context"))
    repeated = F.struct((block + 1).alias("b"), F.lit(True).alias("context"))
    placed = df.withColumn("_p", F.explode(
        F.when((F.col(index) - 1) % size >= size - n, F.array(own, repeated)).otherwise(F.array(own))
    )).withColumn("_b", F.col("_p.b"))
    w = Window.partitionBy(*keys, "_b").orderBy(index).rowsBetween(-n, 0)
    return placed.withColumn(out, F.collect_list(value).over(w)).filter(~F.col("_p.context")).drop("_p", "_b")


def streaks(df: DataFrame, keys: list[str], bucket: str, order: list, failed: Column, out: str = "streak") -> DataFrame:
    """Length of the run of failures ending at each row; 0 on a success."""
    parts = [*keys, bucket]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumn("_fails", F.sum(failed.cast("int")).over(inside)).withColumn(
        "_at_ok", F.max(F.when(~failed, F.col("_fails"))).over(inside)
    )
    totals = local.groupBy(*parts).agg(F.max("_fails").alias("_n"), F.max("_at_ok").alias("_ok"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    summed = totals.withColumn("_n_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = summed.select(
        *parts, (F.col("_n_before") - F.coalesce(F.max(F.col("_n_before") + F.col("_ok")).over(before), F.lit(0))).alias("_open")
    )
    return join_on(local, carried, parts).withColumn(
        out, F.when(F.col("_at_ok").isNotNull(), F.col("_fails") - F.col("_at_ok")).otherwise(F.col("_open") + F.col("_fails"))
    ).drop("_fails", "_at_ok", "_open")


def order_statistic(df: DataFrame, keys: list[str], value: str, rank: Column, out: str = "value") -> DataFrame:
    """The value at a 1-based position of each group in ascending order.

    ``rank`` is an expression over ``n``, the group size. Equal values are
    counted first, so only distinct values are ordered; buckets cut at
    approximate quantiles of all values keep their share of rows level
    whatever the distribution. The result itself is exact.
    """
    df = df.filter(F.col(value).isNotNull())
    probes = [i / VALUE_BUCKETS for i in range(1, VALUE_BUCKETS)]
    cuts = sorted(set(df.approxQuantile(value, probes, 0.25 / VALUE_BUCKETS)))
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    if cuts:
        splits = [float("-inf"), *cuts, float("inf")]
        counts = Bucketizer(splits=splits, inputCol=value, outputCol="_bucket", handleInvalid="keep").transform(counts)
    else:
        counts = counts.withColumn("_bucket", F.lit(0.0))
    sizes = counts.groupBy(*keys).agg(F.sum("_c").alias("n")).select(*keys, rank.alias("_rank"))
    ranked = running_totals(counts, keys, "_bucket", [value], {"_upto": F.col("_c")})
    hit = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_c") < F.col("_rank"))
    return join_on(ranked, sizes, keys).filter(hit).select(*keys, F.col(value).alias(out))
