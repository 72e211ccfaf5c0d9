"""Folders that the driver and all executors share, and tables kept there for a while."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver's Python ends.

    Only a local master may do without the setting, and gets its temporary folder.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.gettempdir()
    top = f"{root.rstrip('/')}/pagemill-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, top))
    return f"{top}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read back: made once for several uses, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone: nothing is left to ask
        for spark, path in _made:
            delete(spark, path)
