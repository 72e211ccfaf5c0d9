"""Sinks: the manifest of split documents and result files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .committed import publish


def output_name(stem: Column, ordinal: Column, code: Column, name: Column, flagged: Column) -> Column:
    """``stem_001_01005_name[_REVIEW].pdf``."""
    return F.concat(
        stem, F.lit("_"), F.lpad(ordinal.cast("string"), 3, "0"), F.lit("_"), F.lpad(code.cast("string"), 5, "0"), F.lit("_"), T.safe_filename(name),
        F.when(flagged, "_REVIEW").otherwise(""), F.lit(".pdf"),
    )


def manifest(docs: DataFrame) -> DataFrame:
    """Adds out_name and the page label to documents (file, start, end, ordinal, code, name, flagged)."""
    return docs.withColumn("out_name", output_name(F.col("file"), F.col("ordinal"), F.col("code"), F.col("name"), F.col("flagged"))).withColumn("pages", T.range_label(F.col("start"), F.col("end")))


def write_manifest(docs: DataFrame, path: str, run: str = "0") -> bool:
    """Publishes a run's manifest as a whole; False (and nothing is written) if that run is there already."""
    return publish(manifest(docs), path, run)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Results as JSON lines: ``overwrite`` for the latest, ``append`` for a history."""
    df.write.mode(mode).json(path)


def pending(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (prompt) split into answered (key, raw) and still to ask, by the cache's key."""
    keyed = requests.withColumn("key", T.cache_key(F.col("prompt")))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def unfinished(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Inputs (stem) of which no output name (name) begins with ``stem_``.

    A prefix test as an equi-join: every output offers each of its prefixes that
    ends before an underscore.
    """
    parts = F.split("name", "_")
    stems = outputs.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "_"))).alias("stem")).distinct()
    return inputs.join(stems, "stem", "left_anti")


def shard(inputs: DataFrame, listed: DataFrame, listed_rel: DataFrame | None = None) -> DataFrame:
    """Inputs (path, rel_path) named in a list (name) by either path; every such row once, equal rows as often as they are there.

    With a second list the first names absolute paths and the second relative ones; without it one list names both.
    """
    kept = inputs.where("path is not null or rel_path is not null")
    for col, names in (("path", listed), ("rel_path", listed if listed_rel is None else listed_rel)):
        kept = kept.join(names.select(F.col("name").alias(f"__{col}")).distinct(), F.col(col) == F.col(f"__{col}"), "left")
    return kept.where("__path is not null or __rel_path is not null").drop("__path", "__rel_path")


def write_evaluation_set(path: str, truth: DataFrame, strata: DataFrame, masks: DataFrame) -> None:
    """The three tables of an evaluation set below ``path``."""
    for name, df in (("truth", truth), ("strata", strata), ("masks", masks)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_state(path: str, todo: DataFrame, predictions: DataFrame) -> int:
    """Pending requests, and predictions only where none is pending; the exit code: 3 while some are, else 0."""
    todo.write.mode("overwrite").json(f"{path}/pending")
    if not todo.isEmpty():
        return 3
    predictions.write.mode("overwrite").json(f"{path}/predictions")
    return 0


def cached(path: str, requests: DataFrame, key: list[str], make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table of what ``make`` gives per ``key``, kept below ``path``: only requests that it lacks are made and appended."""
    spark, keys = requests.sparkSession, requests.select(*key).distinct()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        new = requests.join(spark.read.parquet(path).select(*key), key, "left_anti")
        if not new.isEmpty():
            make(new).write.mode("append").parquet(path)
    else:
        make(requests).write.parquet(path)
    return spark.read.parquet(path).join(keys, key, "left_semi")
