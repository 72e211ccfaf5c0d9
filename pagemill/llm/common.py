"""Expressions and helpers shared by the training-data operators.

Column names that begin with ``__pagemill_`` are reserved; all others may be in callers' tables.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: White space of every contract: space and U+0009..U+000D, nothing else.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = "[ \\t-\\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_made: list[tuple[SparkSession, str]] = []


def crc32_sql(value: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a number's decimal text: one step for each character and bit."""
    steps = f"flatten(list_transform(string_split(cast({value} as varchar), ''), lambda ch: [ascii(ch)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(4294967295::bigint, list_reduce({steps}, lambda acc, x: case when x >= 0 then xor(acc, x) else xor(acc >> 1, 3988292384 * (acc & 1)) end, 4294967295::bigint))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    Catalyst may inline a projected expression into a lambda body, where it
    would run once per element; a one-element ``transform`` binds it instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(s: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(s, UPPER, LOWER)


def words(s: Column) -> Column:
    """Runs of non-space characters, in order; null and blank give an empty array."""
    bare = F.btrim(F.coalesce(s, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RE))


def window_hashes(ws: Column, n: int) -> Column:
    """64-bit hashes of every window of ``n`` consecutive elements (none when shorter)."""
    return F.when(
        F.size(ws) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(ws) - n),
            lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(n)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def digest128(s: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string, as cheap as one long compare each."""
    return F.xxhash64(s), F.xxhash64(F.lit(7919), s)


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", grows: bool = True) -> DataFrame:
    """Equi-join on columns of both (null keys equal), keeping those of ``left``.

    No side is copied; adaptive execution splits the partitions of hot keys.  A
    right side that ``grows`` with the corpus is never broadcast (packed ids look
    small in Parquet and are not in memory); others by Spark's own size check.
    """
    renamed = right.select(*[F.col(c).alias(f"__pagemill_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = F.lit(True)
    for c in on:
        cond = cond & F.col(c).eqNullSafe(F.col(f"__pagemill_r_{c}"))
    return left.join(renamed.hint("merge") if grows else renamed, cond, how).drop(*[f"__pagemill_r_{c}" for c in on])


def scratch_dir(spark: SparkSession) -> str:
    """Folder that every executor sees: ``spark.checkpoint.dir``; only a local master may do without, and gets its temporary folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = f"{tempfile.gettempdir()}/pagemill-scratch"
    return f"{conf.rstrip('/')}/pagemill-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under ``scratch_dir``, deleted when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/{name}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path.rsplit("/", 1)[0]))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(spark: SparkSession) -> None:
    """Lets the driver forget what is done: Spark then deletes shuffle files that no table refers to, and unloads compiled plans."""
    gc.collect()
    spark._jvm.System.gc()


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM is gone: nothing is left to ask
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends there.

    Survives lost executors (unlike a local checkpoint) and lets one computation
    feed several consumers.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Workspace:
    """Tables in the shared folder that one operator call needs, gone when its result is stored."""

    def __init__(self, spark: SparkSession, grows: bool = False):
        self.spark = spark
        self.grows = grows
        self.paths: list[str] = []
        self.tables: list[tuple[DataFrame, str]] = []

    def store(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back; joins of tables that ``grow`` are sort-merge joins (see ``joined``)."""
        path = scratch(self.spark, name)
        self.paths.append(path)
        schema = df.schema
        df.write.parquet(path)
        back = self.spark.read.schema(schema).parquet(path)
        back = back.hint("merge") if self.grows else back
        self.tables.append((back, path))
        return back

    def drop(self, table: DataFrame) -> None:
        """Deletes a table that ``store`` returned and that nothing reads any more."""
        path = next(p for t, p in self.tables if t is table)
        drop_path(self.spark, path)
        self.paths.remove(path)
        self.tables = [(t, p) for t, p in self.tables if p != path]

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` stored (it stays until Python ends), everything else deleted."""
        done = stored(df, name)
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths.clear()
        self.tables.clear()
        tidy(self.spark)
        return done


def numbered(space: Workspace, df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``idx``, a row's place from 0 among those with equal ``keys`` by ``order`` (nulls first), and ``n``, how many those are.

    Rows are dealt by ranges of (keys, order) and counted within each, so a key with
    a third of all rows is numbered by many tasks; a window sees one row per key and range.
    ``df`` should be stored: ranges are sampled first.
    """
    at, part, first, offset = (f"__pagemill_{x}" for x in ("at", "part", "first", "offset"))
    by = [F.asc_nulls_first(c) for c in (*keys, *order)]
    dealt = space.store(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()), name)
    dealt = dealt.withColumn(part, F.shiftright(at, 33))
    size = dealt.groupBy(*keys, part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    before = F.sum("n").over(w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    size = size.select(*keys, part, first, F.coalesce(before, F.lit(0)).alias(offset), F.sum("n").over(w).alias("n"))
    return joined(dealt, size, [*keys, part], grows=False).withColumn("idx", F.col(at) - F.col(first) + F.col(offset)).drop(at, part, first, offset)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
