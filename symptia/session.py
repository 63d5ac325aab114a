"""Session settings, the shared folder, and the size check behind broadcasts."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may hold and still be copied to every executor. Callers pass
# their own bound when their rows are wide.
BROADCAST_ROWS = 200_000


def build_session(app: str = "symptia", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library relies on; cluster values win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k: str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables and stream checkpoints.

    The cluster names the shared root in ``spark.checkpoint.dir``. Only a local
    session without that setting (tests, laptops) falls back to a temp folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{os.urandom(6).hex()}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input with fewer splits than cores, such as one
    small file with a single row group. A large input has splits enough and
    passes through untouched."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing to the shared folder and reading back."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` holds at most ``rows`` rows; reads no more than rows+1."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after checking the size; otherwise leave the
    choice to the optimizer, which will shuffle on the join key."""
    return F.broadcast(df) if fits(df, rows) else df
