"""Outputs of runs that count as a whole or not at all, and a cache that is never dealt anew.

``publish`` writes a run's rows to a staging folder and renames it to ``run=...``: that
rename is the commit.  What a failed run left in staging is not read and is
overwritten by the next attempt; a run that is published already stays as it is.

``Cache`` is a table bucketed by key.  Requests are dealt by key to its buckets; the
cache itself is read bucket by bucket, without an exchange, however large it is.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import delete

FOLDERS = 64
STAGING = "_staging"


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _files(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, source: str, target: str) -> bool:
    """Moves a folder; False if the target is there already."""
    jvm, (a, fs), b = spark._jvm, _files(spark, source), _files(spark, target)[0]
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(a, b, spark.sparkContext._gateway.new_array(kind, 0))
    except Exception as e:
        if "FileAlreadyExistsException" in str(e) or "already exists" in str(e):
            return False
        raise
    return True


def publish(df: DataFrame, path: str, run: str, by: str = "file", folders: int = FOLDERS) -> bool:
    """Adds a run's rows below ``path``, in at most ``folders`` folders by hash of ``by``; False if the run is there already."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"no name of a run: {run!r}")
    spark, target, staged = df.sparkSession, f"{path}/run={run}", f"{path}/{STAGING}/{run}"
    if exists(spark, target):
        return False
    part = F.pmod(F.xxhash64(by), F.lit(folders)).cast("int")
    df.withColumn("folder", part).repartition("folder").write.mode("overwrite").partitionBy("folder").parquet(staged)
    done = _rename(spark, staged, target)
    if not done:
        delete(spark, staged)
    return done


def published(spark: SparkSession, path: str, schema: str, run: str | None = None) -> DataFrame:
    """The rows of all runs (or one) that were published, with ``run``."""
    root, fs = _files(spark, path)
    found = [str(x.getPath()) for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"run={run or '*'}")) or []]
    full = f"{schema}, run string"
    return spark.read.schema(full).option("basePath", path).parquet(*found) if found else spark.createDataFrame([], full)


class Cache:
    """Rows by key below ``path``: at most one for each key is kept.

    ``columns``: the other columns' types, such as ``raw string``.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str = "raw string", buckets: int = FOLDERS):
        self.spark, self.buckets = spark, buckets
        self.name = f"pagemill_cache_{hashlib.sha256(path.encode()).hexdigest()[:16]}"
        self.columns = [c.split()[0] for c in columns.split(",")]
        spark.sql(f"create table if not exists {self.name} (key string, {columns}) using parquet clustered by (key) sorted by (key) into {buckets} buckets location '{path}'")

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def _dealt(self, requests: DataFrame) -> DataFrame:
        return requests.repartition(self.buckets, "key")

    def found(self, requests: DataFrame) -> DataFrame:
        """Requests with a row, and its columns."""
        return self._dealt(requests).join(self.rows.hint("merge"), "key")

    def missing(self, requests: DataFrame) -> DataFrame:
        """Distinct keys' requests without a row."""
        return self._dealt(requests).join(self.rows.select("key").hint("merge"), "key", "left_anti").dropDuplicates(["key"])

    def add(self, answers: DataFrame) -> None:
        """Appends rows of keys that the cache lacks, one for each; what it has stays."""
        self.missing(answers.where("key is not null")).select("key", *self.columns).sortWithinPartitions("key").write.insertInto(self.name)
