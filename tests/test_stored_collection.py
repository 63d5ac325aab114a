import os

import pytest
from pyspark.sql import functions as F

from symptia.operators import collection


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, "id string, text string")


def rows(spark, folder):
    return {r.id: r.text for r in collection.read_stored(spark, folder).collect()}


def test_base_deltas_removals_and_compaction(spark, make, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        collection.read_stored(spark, folder)
    collection.write_base(make([("a", "1"), ("b", "1"), (None, "1")]), folder)
    collection.write_upsert(make([("a", "2"), ("c", "2")]), folder)
    collection.write_removal(make([("b", ""), ("c", "")]), folder)
    collection.write_upsert(make([("c", "4"), (None, "4"), (None, "4")]), folder)
    expected = {"a": "2", "c": "4", None: "4"}
    assert rows(spark, folder) == expected and collection.read_stored(spark, folder).count() == 3
    assert collection.info(collection.read_stored(spark, folder), "x").first()["count"] == 3
    assert collection.compact(spark, folder) == 5 and rows(spark, folder) == expected
    collection.clear(spark, folder)
    assert rows(spark, folder) == {} and collection.read_stored(spark, folder).columns == ["id", "text"]
    collection.write_upsert(make([("z", "7")]), folder)
    assert rows(spark, folder) == {"z": "7"}


def test_a_batch_run_again_and_a_version_without_its_mark(spark, make, tmp_path):
    folder = str(tmp_path)
    collection.write_base(make([("a", "1")]), folder)
    for text in ("2", "again"):
        collection.write_upsert(make([("a", text)]), folder, number=2)
    assert rows(spark, folder) == {"a": "2"}
    collection.write_upsert(make([("a", "3")]), folder)
    os.remove(tmp_path / "version=3" / "kind=delta" / "_SUCCESS")
    assert rows(spark, folder) == {"a": "2"}
    collection.write_upsert(make([("a", "4")]), folder)
    assert rows(spark, folder) == {"a": "4"}


def test_an_upsert_writes_its_own_rows_only(spark, tmp_path):
    folder = str(tmp_path)
    every = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    collection.write_base(every, folder)
    collection.write_upsert(every.limit(200).withColumn("text", F.md5("text")).coalesce(1), folder)
    size = lambda n: sum(f.stat().st_size for f in (tmp_path / f"version={n}").rglob("*.parquet"))
    assert size(2) < size(1) / 20 and collection.read_stored(spark, folder).count() == 20_000
    assert collection.read_stored(spark, folder).filter("length(text) = 32").count() == 200
