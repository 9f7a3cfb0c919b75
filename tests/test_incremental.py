"""Incremental analysis: changes, replays, late and deleted files."""

import pytest
from pyspark.sql import functions as F

from weftline.streaming.incremental import IncrementalTable

FACTS = "path string, n int"


@pytest.fixture
def table(spark, tmp_path):
    def analyse(files):
        return files.select("path", F.explode(F.split("content", " ")).alias("w")).groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n"))

    return IncrementalTable(spark, str(tmp_path / "t"), analyse, FACTS).create()


def versions(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string, seq long")


def state(table):
    return {r.path: (r.n, r.batch) for r in table.facts().collect()}


def test_only_changes_are_analysed_again(spark, table):
    assert state(table) == {}
    table.upsert(versions(spark, ("a", "x y", 1), ("b", "x", 1), ("c", "z", 1), ("c", "z z z", 2), (None, "x", 1)), 0)
    assert state(table) == {"a": (2, 0), "b": (1, 0), "c": (3, 0)}
    table.create().upsert(versions(spark, ("a", "x y", 2), ("b", "x y z", 2), ("d", None, 1)), 1)
    assert state(table) == {"a": (2, 0), "b": (3, 1), "c": (3, 0)}
    table.upsert(versions(spark, ("b", None, 3), ("c", "late", 1), ("a", "", 3)), 2)
    assert state(table) == {"a": (1, 2), "c": (3, 0)}
    table.upsert(versions(spark, ("b", "x y z", 4), ("b", "x", 2)), 3)
    assert state(table) == {"a": (1, 2), "b": (3, 3), "c": (3, 0)}


def test_a_batch_may_run_again(spark, table):
    batches = [versions(spark, ("a", "x", 1), ("b", "x y", 1)), versions(spark, ("a", "x y z", 2), ("c", "x", 1)), versions(spark, ("b", None, 2))]
    for i, b in enumerate(batches):
        table.upsert(b, i)
    want = state(table)
    table.upsert(batches[2], 2)
    assert state(table) == want
    for again in (0, 1, 2):  # from any batch on
        for i in range(again, 3):
            table.upsert(batches[i], i)
        assert state(table) == want
    # A crash between the two folders of a batch: its facts are there, its files are not.
    table.analyse(versions(spark, ("z", "half done", 1)).select("path", "content")).write.parquet(f"{table.folder}/facts/batch=3")
    assert state(table) == want
    table.upsert(versions(spark, ("z", "done", 1)), 3)
    assert state(table) == want | {"z": (1, 3)}


def test_a_stream_is_followed_across_runs(spark, table, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    stream = lambda: spark.readStream.schema("path string, content string, seq long").parquet(source)
    versions(spark, ("a", "x", 1), ("b", "x y", 1)).write.parquet(source)
    table.follow(stream(), checkpoint).awaitTermination()
    table.follow(stream(), checkpoint).awaitTermination()
    versions(spark, ("b", "y", 2)).write.mode("append").parquet(source)
    table.follow(stream(), checkpoint).awaitTermination()
    assert state(table) == {"a": (1, 0), "b": (1, 1)}
