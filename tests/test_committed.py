"""Runs that are published once and whole; a bucketed cache without an exchange of its own."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

from pagemill.sources import committed as C
from pagemill.sources import sinks

DOCS = "file string, start int, end int, ordinal int, code int, name string, flagged boolean"
OUT = f"{DOCS}, out_name string, pages string"


def docs(spark, n):
    return spark.createDataFrame([(f"f{i}", 1, 2, 1, 7, "plan", False) for i in range(n)], DOCS)


def test_a_run_counts_once(spark, tmp_path):
    path = str(tmp_path / "m")
    assert C.published(spark, path, OUT).count() == 0
    assert sinks.write_manifest(docs(spark, 200), path, "a") and not sinks.write_manifest(docs(spark, 200), path, "a")
    assert sinks.write_manifest(docs(spark, 3), path, "b")
    assert {r["run"]: r["n"] for r in C.published(spark, path, OUT).groupBy("run").agg(F.count("*").alias("n")).collect()} == {"a": 200, "b": 3}
    assert C.published(spark, path, OUT, "b").count() == 3
    # Folders by hash, not one for each file.
    assert len([f for f in os.listdir(f"{path}/run=a") if f.startswith("folder=")]) <= C.FOLDERS
    with pytest.raises(ValueError, match="no name"):
        C.publish(docs(spark, 1), path, "../x")


def test_a_run_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "m")
    broken = docs(spark, 500).withColumn("code", F.when(F.col("file") == "f77", F.raise_error(F.lit("stop")).cast("int")).otherwise(F.col("code")))
    with pytest.raises(Exception, match="stop"):
        C.publish(broken, path, "a")
    assert C.published(spark, path, DOCS).count() == 0
    # Stopped before the rename: staged rows are no outputs, and the next attempt writes over them.
    docs(spark, 9).withColumn("folder", F.lit(0)).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/{C.STAGING}/a")
    assert C.published(spark, path, DOCS).count() == 0
    assert C.publish(docs(spark, 4), path, "a")
    assert C.published(spark, path, DOCS).count() == 4 and os.listdir(f"{path}/{C.STAGING}") in ([], [".a.crc"])


def test_of_two_at_once_one_stays(spark, tmp_path):
    path = str(tmp_path / "m")
    assert C.publish(docs(spark, 4), path, "a")
    docs(spark, 9).write.parquet(f"{path}/{C.STAGING}/late")
    assert C._rename(spark, f"{path}/{C.STAGING}/late", f"{path}/run=a") is False
    assert C.published(spark, path, DOCS).count() == 4


def test_cache(spark, tmp_path):
    """Lookups and appends; a second session opens the same folder; the cache's side is read in place."""
    cache = C.Cache(spark, str(tmp_path / "c"), "raw string, ms int", buckets=8)
    make = lambda a, z: spark.range(a, z).select(F.concat(F.lit("k"), F.col("id") % 1_000).alias("key"), F.col("id").cast("string").alias("raw"), F.lit(1).alias("ms"))
    assert cache.missing(make(0, 5)).count() == 5 and cache.found(make(0, 5)).count() == 0
    cache.add(make(0, 600))
    cache.add(make(300, 1_200))  # 1000 to 1199 repeat the keys 0 to 199
    cache.add(spark.createDataFrame([(None, "x", 1)], "key string, raw string, ms int"))
    rows = {r["key"]: r["raw"] for r in cache.rows.collect()}
    assert rows == {f"k{i}": str(i) for i in range(1_000)} and cache.rows.count() == 1_000
    asked = spark.createDataFrame([("k5",), ("k5",), ("new",), ("new",)], "key string")
    assert [r["raw"] for r in cache.found(asked).collect()] == ["5", "5"]
    assert [r["key"] for r in cache.missing(asked).collect()] == ["new"]
    spark.sql(f"drop table {cache.name}")
    again = C.Cache(spark, str(tmp_path / "c"), "raw string, ms int", buckets=8)
    assert again.rows.count() == 1_000
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        again.found(make(0, 5_000)).explain("simple")
    plan = out.getvalue()
    assert plan.count("Exchange") == 1 and "SortMergeJoin" in plan  # the requests'
    assert "Bucketed: true" in plan or "SelectedBucketsCount" in plan
