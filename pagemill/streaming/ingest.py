"""Incremental runs: verdict files that arrive in a folder, decided once.

``available_now`` drains what has arrived and stops; the checkpoint remembers what was
taken, and a batch that is run again after its write (a stop before the checkpoint)
replaces its own rows, so a restart neither repeats nor skips: a supervisor can simply
start it again.  ``live_now`` does the same for pages in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.decision import VERDICTS, boundaries
from . import live


def read_verdicts(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.schema(VERDICTS)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(folder)


def write_epoch(df: DataFrame, path: str, epoch: int) -> None:
    """The rows of one batch as ``epoch=N`` below ``path``; a batch that is run again takes the place of itself."""
    df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_epochs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches that were written to their end, with ``epoch``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    done = [str(x.getPath().getParent()) for x in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(p, "epoch=*/_SUCCESS")) or []]
    r = spark.read.schema(f"{schema}, epoch int").option("basePath", path)
    return r.parquet(*done) if done else spark.createDataFrame([], f"{schema}, epoch int")


def _drain(rows: DataFrame, write, checkpoint: str) -> None:
    rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def available_now(spark: SparkSession, folder: str, out: str, checkpoint: str) -> None:
    """Decides all verdicts that have arrived and adds boundaries to ``out``; a page sequence arrives whole."""

    def batch(df: DataFrame, epoch: int) -> None:
        write_epoch(boundaries(df, df.select("file", "total_pages").distinct()), out, epoch)

    _drain(read_verdicts(spark, folder), batch, checkpoint)


def live_now(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int | None = None, keep_ms: int | None = None) -> None:
    """Decides pages that have arrived, in any order; starts that are final are added to ``out``, the rest waits in the state."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, live.STORE)
    try:
        _drain(live.boundaries(read_verdicts(spark, folder, files_per_batch), keep_ms), lambda df, epoch: write_epoch(df, out, epoch), checkpoint)
    finally:
        spark.conf.set(name, before)
