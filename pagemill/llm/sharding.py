"""Shards by fixed virtual slots and a versioned slot-to-shard map.

A record's slot is the hash of its doc_id, size and CRC-32 modulo ``SLOTS``, for ever.
A map says which shard each slot is in.  Bytes and rows are summed per slot; the
map of version 0 deals slots out in turn, and ``rebalance`` edits a map into its
next version: a slot moves from a fuller to an emptier shard as long as that brings
the two closer, so afterwards no shard holds more than the emptiest one and its own
smallest slot together.  ``grow`` edits one for a further shard, which takes slots and
gives none.  Versions are files of a folder, written once and never changed.

What reaches the driver is a row per slot, ``SLOTS`` at most at any size of the data;
the map is joined back as a broadcast of the same bound.  A record's place in its
shard counts the slots before its own and the records before it in its slot, so no
shard is ever sorted in one task.

Defined results: a null text has no bytes and differs from none in size; equal rows
are records of their own in one slot; null doc_ids are hashed by size and text; a very
long text is one record that no shard can split; an empty table gives no rows and an
even map; of the further columns of documents none is used.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, scratch

SLOTS, OVERHEAD = 16_384, 16
VERSION = "version={:06d}"


def slot(doc_id: Column, size: Column, crc: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, whatever the number of shards."""
    return F.pmod(F.xxhash64(doc_id, size, crc), F.lit(slots)).cast("int")


def even(shards: int, slots: int = SLOTS) -> list[int]:
    """The first map: slots dealt out in turn."""
    return [k % shards for k in range(slots)]


def rebalance(old: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """``old`` edited until no single move of a slot evens two shards out.

    The slot that moves is the largest of the fullest shard that can give one of at
    most half the difference to the emptiest shard, else its smallest lighter than that
    difference.  Slots without weight stay.
    """
    new, load = list(old), [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for k, w in weight.items():
        if w > 0:
            load[old[k]] += w
            held[old[k]].append((w, k))
    for h in held:
        h.sort()
    while True:
        low = min(range(shards), key=lambda s: (load[s], s))
        for high in sorted(range(shards), key=lambda s: (-load[s], s)):
            gap = load[high] - load[low]
            if held[high] and held[high][0][0] < gap:
                break
        else:
            return new
        at = max(bisect.bisect_right(held[high], (gap // 2, len(old))) - 1, 0)
        w, k = held[high].pop(at)
        bisect.insort(held[low], (w, k))
        load[high], load[low], new[k] = load[high] - w, load[low] + w, low


def grow(old: list[int], weight: dict[int, int], shards: int) -> list[int]:
    """``old`` edited for one shard more: each shard gives slots, its smallest first, while it is above the new mean; none moves elsewhere."""
    new, load = list(old), [0] * shards
    for k, w in weight.items():
        load[old[k]] += w
    mean = sum(load) / (shards + 1)
    for k, w in sorted(weight.items(), key=lambda x: (x[1], x[0])):
        s = old[k]
        if w > 0 and load[s] - w >= mean:
            load[s], new[k] = load[s] - w, shards
    return new


def save_map(spark: SparkSession, path: str, version: int, slot_map: list[int]) -> None:
    """Adds a version to the folder; an existing one is an error."""
    spark.createDataFrame(list(enumerate(slot_map)), "virtual_slot int, shard int").coalesce(1).write.mode("error").parquet(f"{path}/{VERSION.format(version)}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/{VERSION.format(version)}")


def weights(records: DataFrame) -> dict[int, int]:
    """Bytes per slot (columns virtual_slot, size): at most ``SLOTS`` rows reach the driver."""
    return {r["virtual_slot"]: r["w"] for r in records.groupBy("virtual_slot").agg(F.sum("size").alias("w")).collect()}


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return d.withColumn("virtual_slot", slot(F.col("doc_id"), F.col("size"), F.col("text_crc32"), slots))


def assign(found: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds to ``records`` their shard, by a map, and their place in it, gapless from 0."""
    m = F.broadcast(slot_map)  # SLOTS rows of two integers
    n = found.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n")).join(m, "virtual_slot")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    start = n.select("virtual_slot", "shard", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32"))
    # At most SLOTS rows, like the map.
    return found.withColumn("own", own).join(F.broadcast(start), "virtual_slot").withColumn("slot", F.col("start") + F.col("own") - 1).drop("own", "start")


def shard(docs: DataFrame, shards: int, path: str | None = None, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot and map_version of every document, by bytes.

    Versions 0 (even) and 1 (edited for these documents' bytes) go to ``path``, a
    new folder of the shared one if none is given.
    """
    spark = docs.sparkSession
    found = Workspace(spark).store(records(docs, slots), "records")
    path = path or scratch(spark, "slot_map")
    first = even(shards, slots)
    save_map(spark, path, 0, first)
    save_map(spark, path, 1, rebalance(first, weights(found), shards))
    return assign(found, load_map(spark, path, 1)).withColumn("map_version", F.lit(1))
