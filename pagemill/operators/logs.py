"""Ordered log analytics over (section, seq, ...): as-of columns, carried state, attribution.

Every function works inside a section; a file's lines or a user's events are one
section, so the windows are dealt over sections and sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(section: str, seq: list[str]):
    return Window.partitionBy(section).orderBy(*seq)


def next_marker(value: Column, section: str, seq: list[str]) -> Column:
    """The first non-null value from this line on (markers close their section)."""
    # Backwards: a frame that runs to the end would be read anew for every row.
    back = Window.partitionBy(section).orderBy(*[F.desc(c) for c in seq])
    return F.last(value, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))


def previous_marker(value: Column, section: str, seq: list[str]) -> Column:
    """The last non-null value up to this line (markers open their section)."""
    return F.last(value, ignorenulls=True).over(_order(section, seq).rowsBetween(Window.unboundedPreceding, 0))


def stash(df: DataFrame, section: str, seq: list[str], value: Column, taker: Column) -> DataFrame:
    """Adds ``stashed``: the last value since the previous taker, for each taker (used once)."""
    w = _order(section, seq)
    d = df.withColumn("__take", taker.cast("int")).withColumn("__epoch", F.coalesce(F.sum("__take").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = F.last(value, ignorenulls=True).over(Window.partitionBy(section, "__epoch").orderBy(*seq).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("stashed", F.when(F.col("__take") == 1, last)).drop("__take", "__epoch")


def carried(value: Column, section: str, seq: list[str], default: int = 0) -> Column:
    """Current iteration: the last value seen, ``default`` before any."""
    return F.coalesce(previous_marker(value, section, seq), F.lit(default))


def active_before(starts: Column, resets: Column, section: str, seq: list[str]) -> Column:
    """Whether a start without a later reset lies before this row."""
    w = _order(section, seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(starts, 1).when(resets, 0), ignorenulls=True).over(w), F.lit(0)) == 1


def first_emitted(iteration: Column, emits: Column, section: str, page: str, seq: list[str]) -> Column:
    """The lowest iteration that emitted this page on an earlier line."""
    w = Window.partitionBy(section, page).orderBy(*seq).rowsBetween(Window.unboundedPreceding, -1)
    return F.min(F.when(emits, iteration)).over(w)


def attribution(events: DataFrame, keys: list[str], signal: str) -> DataFrame:
    """Per key the sorted set of signals that resolve to it."""
    return events.groupBy(*keys).agg(F.array_sort(F.collect_set(signal)).alias("signals"))


def first_fragment(names: DataFrame, fragments: DataFrame) -> DataFrame:
    """name -> label of the first (by idx) fragment that the name contains.

    ``fragments`` is a dimension table; Spark broadcasts it within its own threshold.
    """
    hit = names.select("name").distinct().join(fragments, F.contains("name", "fragment"))
    return hit.groupBy("name").agg(F.min_by("label", "idx").alias("label"))
