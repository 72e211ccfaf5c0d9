"""Prefix trie of conversations, from their sorted order.

A turn is the 128-bit digest of its role and text; a conversation is the sequence of
its turns' digests (16 bytes a turn, with the turns' word counts), the only thing that
is gathered in one row.  Conversations are dealt by ranges of (sequence, conv_id) into
blocks, so copies lie side by side and a group of copies spans blocks.

lcp[i] is the number of turns that sorted conversation i shares with the one before.
Its Cartesian tree gives the trie: the nearest smaller values left and right of i
bound the conversations below one branching node, equal values with equal bounds are
one node.  A task finds them within its block by a stack.  What stays open there (one
value for each depth at most) is answered by the blocks' minima: the nearest block
with a smaller minimum, then that block's staircase of last (or first) smaller
values.  Sums between two bounds come from the staircases' partial sums and the
blocks' totals.  Then each block expands its nodes to the depths between them and
their parents, and whole conversations to those below their last branching node.

What reaches the driver and is broadcast is eight numbers a block (some MB of
conversations each).  All else is joined by block.  SHA-256 has no partial sums: the
ids of copies within a block are hashed there, those of a group over several blocks
pass through one task as a stream of small pieces, never held together.

Defined results: rows without conv_id belong to no conversation; null role and text
are empty; turns with equal numbers (null first) are ordered by digest; repeated
turns count each; negative ids are taken as they are (the remainder truncates
towards zero); very long texts only cost their digest; an empty table gives no rows,
not even a root; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from .common import Workspace, joined

FAMILY, HEADS = 20, 4
BLOCK_BYTES, LEAST_BLOCKS = 8_000_000, 16
DIGEST, PIECE = 16, 8_000
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max
NONE_SHA = hashlib.sha256(b"").hexdigest()
SUMS = ("n", "total", "own", "leaf")
_PART = [(k, pa.int64()) for k in (*SUMS, "low")]
_STAIRS = pa.list_(pa.struct([("value", pa.int32()), ("pos", pa.int32()), ("len", pa.int32()), *_PART]))
_OPENED = pa.list_(pa.struct([("value", pa.int32()), ("side", pa.string()), ("here", pa.bool_()), ("forks", pa.int64())]))
_SUMMARY = pa.schema([("block", pa.int32()), ("least", pa.int32()), ("starts", pa.bool_()), *_PART, ("head", pa.list_(pa.string())), ("tail", pa.list_(pa.string())), ("opened", _OPENED), ("falling", _STAIRS), ("rising", _STAIRS)])
_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = pa.schema([*[(k, pa.int64()) for k in _LONGS], ("ends_sha256", pa.string())])


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order as ``seq``: array of (digest, words)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    words = F.regexp_count(text, F.lit(WORD)).cast("int")
    t = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), words.alias("words")).alias("t"))
    order = F.transform(F.sort_array(F.collect_list("t")), lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words")))
    return t.groupBy("conv_id").agg(order.alias("seq"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """``sequences`` with the first h turns of each taken from the first conversation of its 20; h is the id's CRC-32 modulo 4."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = convs.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, HEADS - 1).alias("first"))
    met = joined(convs.select("*", base.alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int").alias("h")), heads, ["base"], "left")
    none = F.array().cast(convs.schema["seq"].dataType)
    first = F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))
    return met.select("conv_id", F.concat(first, F.slice("seq", F.col("h") + 1, F.size("seq"))).alias("seq"))


class Block:
    """Sorted conversations of one block.

    ``lcp`` has an entry more than there are conversations: the next block's first.
    It is -1 before the first conversation of all and behind the last.
    """

    def __init__(self, t: pa.Table, before: bytes | None, behind: bytes | None):
        keys, ids = t["key"].to_pylist(), t["conv_id"].to_numpy()
        order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], ids[i])), np.int64)
        keys, self.ids = [keys[i] for i in order.tolist()], ids[order].astype(np.int64)
        n = self.n = len(keys)
        self.len = np.array([len(k) // DIGEST for k in keys], np.int64)
        flat = t["words"].combine_chunks().take(pa.array(order)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.at = np.r_[0, np.cumsum(self.len)]
        self.words = np.r_[0, np.cumsum(flat)]
        chain = [before or b"", *keys, behind or b""]
        self.lcp = shared(chain)
        # Whether a conversation (the last entry: the next block's first) equals the one before.
        self.same = np.array([a == b for a, b in zip(chain, chain[1:], strict=False)])
        for at, key in ((0, before), (n, behind)):
            if key is None:
                self.lcp[at], self.same[at] = -1, False
        # A conversation owns the nodes that none before it has; it has a leaf if the next doesn't go on.
        self.total = self.words[self.at[1:]] - self.words[self.at[:-1]]
        self.own = self.words[self.at[1:]] - self.words[self.at[:-1] + np.maximum(self.lcp[:-1], 0)]
        leaf = (self.lcp[1:] < self.len).astype(np.int64)
        self.sums = {"n": np.arange(n + 1), **{k: np.r_[0, np.cumsum(x)] for k, x in (("total", self.total), ("own", self.own), ("leaf", leaf))}}
        self._nodes()

    def _nodes(self) -> None:
        """Distinct (value, left, right) of the entries from 0 on; ``of_entry`` says which is an entry's (-1: none).

        left is -1 where it lies before the block; right n + 1 where it lies behind the next block's first.
        """
        n, lcp = self.n, self.lcp.tolist()
        left, right, stack = [-1] * n, [n + 1] * n, []
        for i in range(n + 1):
            while stack and lcp[stack[-1]] > lcp[i]:
                right[stack.pop()] = i
            if i < n:
                if stack:
                    j = stack[-1]
                    left[i] = left[j] if lcp[j] == lcp[i] else j
                stack.append(i)
        nodes, self.of_entry = np.unique(np.column_stack([self.lcp[:n], left, right]), axis=0, return_inverse=True)
        self.of_entry = self.of_entry.reshape(-1)
        self.value, self.left, self.right = nodes.T
        # Another child begins at each entry behind which the conversation goes on.
        self.forks = np.bincount(self.of_entry, self.len > self.lcp[:n], len(nodes)).astype(np.int64)
        self.side = np.where(self.left < 0, "L", "R")
        self.open = ((self.left < 0) | (self.right > n)) & (self.value >= 0)
        self.closed = (self.value >= 0) & ~self.open

    def part(self, a: int, z: int) -> dict[str, int]:
        """Sums over conversations [a, z) and their smallest id."""
        return {k: int(self.sums[k][z] - self.sums[k][a]) for k in SUMS} | {"low": int(self.ids[a:z].min()) if z > a else NO_ID}

    def copies(self) -> tuple[int, int | None]:
        """Where the copies of the conversation before the block end, and where those begin that go on behind it."""
        new = np.flatnonzero(~self.same[: self.n])
        if not len(new):
            return self.n, None
        return int(new[0]), int(new[-1]) if self.same[self.n] else None


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()


def shared(chain: list[bytes]) -> np.ndarray:
    """Number of leading digests that each key shares with the one before it."""
    size = np.array([len(k) // DIGEST for k in chain], np.int64)
    flat = np.frombuffer(b"".join(chain), np.uint64).reshape(-1, 2)
    at = np.r_[0, np.cumsum(size)]
    out = np.minimum(size[1:], size[:-1])
    row = np.repeat(np.arange(len(out)), out)
    k = np.arange(len(row)) - np.repeat(np.r_[0, np.cumsum(out)][:-1], out)
    other = np.flatnonzero((flat[at[row] + k] != flat[at[row + 1] + k]).any(axis=1))
    np.minimum.at(out, row[other], k[other])
    return out


def _stairs(values: np.ndarray) -> list[int]:
    """Places of the strict minima of all before."""
    low = np.minimum.accumulate(values)
    return [0, *(np.flatnonzero(low[1:] < low[:-1]) + 1).tolist()]


def _pieces(ids: np.ndarray, joined_on: bool) -> list[str]:
    text = "," * joined_on + ",".join(map(str, ids.tolist()))
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


def _summary(t: pa.Table, bounds: pa.Table) -> pa.Table:
    """What other blocks may ask of this one, in one row."""
    b = Block(t, bounds["before"][0].as_py(), bounds["behind"][0].as_py())
    n, own = b.n, b.lcp[: b.n]
    head, tail = b.copies()
    stair = lambda i, part: {"value": int(own[i]), "pos": i, "len": int(b.len[i])} | part
    opened = [{"value": int(b.value[k]), "side": str(b.side[k]), "here": bool(b.right[k] < n), "forks": int(b.forks[k])} for k in np.flatnonzero(b.open)]
    row = {"block": bounds["block"][0].as_py(), "least": int(own.min()), "starts": tail is not None, **b.part(0, n)}
    row |= {"head": _pieces(b.ids[:head], True) if head else [], "tail": [] if tail is None else _pieces(b.ids[tail:], False), "opened": opened}
    row |= {"falling": [stair(n - 1 - i, b.part(n - 1 - i, n)) for i in _stairs(own[::-1])], "rising": [stair(i, b.part(0, i)) for i in _stairs(own)]}
    return pa.Table.from_pylist([row], _SUMMARY)


class Minima:
    """Numbers of all blocks in order, for searches and sums between two."""

    def __init__(self, rows: list):
        self.least, self.low = (np.array([r[k] for r in rows], np.int64) for k in ("least", "low"))
        self.before = {k: np.r_[0, np.cumsum([r[k] for r in rows])].astype(np.int64) for k in SUMS}
        starts = np.array([r["starts"] for r in rows])
        # The block in which the copies begin that a block's first ones go on.
        last = np.maximum.accumulate(np.where(starts, np.arange(len(rows)), -1))
        self.begun = np.r_[-1, last[:-1]]
        self.tables = {k: self._table(x) for k, x in (("least", self.least), ("low", self.low))}

    @staticmethod
    def _table(x: np.ndarray) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... entries from each on."""
        out = [x]
        while 2 << (len(out) - 1) <= len(x):
            half = 1 << (len(out) - 1)
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out

    def nearest(self, block: int, value: int, step: int) -> int:
        """The nearest block before (-1) or behind (1) with an entry below ``value``; the number of blocks if there is none behind."""
        t, n, at = self.tables["least"], len(self.least), block + step
        for k in range(len(t) - 1, -1, -1):
            first = at if step > 0 else at - (1 << k) + 1
            while 0 <= first < len(t[k]) and t[k][first] >= value:
                at += step << k
                first += step << k
        return min(at, n)

    def between(self, a: int, z: int) -> dict[str, int]:
        """Sums and smallest id of blocks [a, z)."""
        low = NO_ID
        if z > a:
            k = (z - a).bit_length() - 1
            low = int(min(self.tables["low"][k][a], self.tables["low"][k][z - (1 << k)]))
        return {k: int(self.before[k][z] - self.before[k][a]) for k in SUMS} | {"low": low}


def _resolve(opened: DataFrame, minima) -> DataFrame:
    """Adds the blocks of an open node's bounds and the sums of those between."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m: Minima = minima.value
        for f in frames:
            rows = []
            for b, v, side, here in zip(f["block"], f["value"], f["side"], f["here"], strict=True):
                lb = m.nearest(b, v, -1) if side == "L" else b
                rb = b if here else m.nearest(b, v, 1)
                rows.append({"lb": lb, "rb": rb, **m.between(lb + 1, rb)})
            yield pd.concat([f, pd.DataFrame(rows, columns=["lb", "rb", *SUMS, "low"], index=f.index)], axis=1)

    return opened.mapInPandas(run, "block int, value int, side string, here boolean, forks long, lb int, rb int, n long, total long, own long, leaf long, low long")


def _crossing(summary: DataFrame, minima) -> tuple[DataFrame, DataFrame]:
    """Nodes over several blocks, by the block and place of their first conversation, and to each asking block their smallest id."""
    opened = _resolve(summary.select("block", F.inline("opened")), minima)
    f = summary.select(F.col("block").alias("lb"), F.col("least").alias("lb_least"), "falling")
    r = summary.select(F.col("block").alias("rb"), "rising")
    below = lambda c: F.get(F.filter(c, lambda x: x["value"] < F.col("value")), F.lit(0))
    met = joined(joined(opened, f, ["lb"], grows=False), r, ["rb"], "left", grows=False).withColumn("a", below("falling")).withColumn("z", below("rising"))
    right = F.coalesce(F.col("z.value"), F.lit(-1))
    met = met.withColumn("up", F.greatest(F.col("a.value"), right)).withColumn("by_left", F.col("a.value") >= right)
    sums = [(F.col(k) + F.col(f"a.{k}") + F.coalesce(F.col(f"z.{k}"), F.lit(0))).alias(k) for k in SUMS]
    met = met.select(
        "block", "value", "side", "forks", "lb", F.col("a.pos").alias("pos"), (F.col("a.len") > F.col("value")).cast("long").alias("first_child"), "up", *sums, F.least("low", "a.low", F.coalesce("z.low", F.lit(NO_ID))).alias("low"),
        F.when(F.col("by_left"), F.col("lb")).otherwise(F.col("rb")).alias("up_block"), F.when(F.col("by_left") & (F.col("lb_least") < F.col("up")), "R").otherwise("L").alias("up_side"),
    )
    answers = met.select("block", "value", "side", "low")
    same = ["lb", "pos", "value", "first_child", "up", *SUMS, "low", "up_block", "up_side"]
    nodes = met.groupBy(*same).agg(F.sum("forks").alias("forks")).withColumn("children", F.col("forks") + F.col("first_child"))
    parents = answers.select(F.col("block").alias("up_block"), F.col("value").alias("up"), F.col("side").alias("up_side"), F.col("low").alias("parent"))
    return joined(nodes, parents, ["up_block", "up", "up_side"], "left", grows=False), answers


def _stream(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each group's pieces (begun, block, k, piece), read in order one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        out = lambda: pa.RecordBatch.from_pydict({"begun": pa.array([at], pa.int32()), "sha": [h.hexdigest()]})
        for b in batches:
            for begun, piece in zip(b["begun"].to_pylist(), b["piece"].to_pylist(), strict=True):
                if begun != at:
                    if h is not None:
                        yield out()
                    at, h = begun, hashlib.sha256()
                h.update(piece.encode())
        if h is not None:
            yield out()

    order = ["begun", "block", "k"]
    return pieces.repartition("begun").sortWithinPartitions(*order).select(*order, "piece").mapInArrow(run, "begun int, sha string")


def _expand(t: pa.Table, aux: pa.Table) -> pa.Table:
    """All nodes whose first conversation is in this block, one row for each depth."""
    x = {k: aux[k][0].as_py() for k in ("before", "behind", "nodes", "answers", "sha")}
    b = Block(t, x["before"], x["behind"])
    n = b.n
    told = {(r["value"], r["side"]): r["low"] for r in x["answers"] or []}
    wide = {(r["pos"], r["value"]): r for r in x["nodes"] or []}
    shut = np.flatnonzero(b.closed)
    low = np.zeros(len(b.value), np.int64)
    low[shut] = [b.ids[a:z].min() for a, z in zip(b.left[shut].tolist(), b.right[shut].tolist(), strict=True)]
    for k in np.flatnonzero(b.open).tolist():
        low[k] = told[int(b.value[k]), str(b.side[k])]

    def parent(a: int, z: int) -> int | None:
        """Smallest id of the node right above conversations [a, z)."""
        p, q = int(b.lcp[a]), int(b.lcp[z])
        if max(p, q) < 0:
            return None
        if p >= q:
            return int(low[b.of_entry[a]])
        return int(low[b.of_entry[z]]) if z < n else wide[a, q]["low"]

    _, tail = b.copies()
    first = np.flatnonzero(~b.same[:n])
    ends = np.r_[first[1:], n][: len(first)]
    sha = {a: _sha(b.ids[a:z]) for a, z in zip(first.tolist(), ends.tolist(), strict=True) if a != tail}
    if tail is not None:
        sha[tail] = x["sha"]
    rows: list[tuple] = []  # a, upper depth, value, sums, low, children, parent
    for k in shut.tolist():
        a, z = int(b.left[k]), int(b.right[k])
        rows.append((a, int(max(b.lcp[a], b.lcp[z])), int(b.value[k]), *[int(b.sums[s][z] - b.sums[s][a]) for s in SUMS], int(low[k]), int(b.forks[k] + (b.len[a] > b.value[k])), parent(a, z)))
    for r in wide.values():
        rows.append((r["pos"], r["up"], r["value"], *[r[s] for s in SUMS], r["low"], r["children"], r["parent"]))
    up = np.maximum(b.lcp[:-1], b.lcp[1:])
    for i in np.flatnonzero(b.len > up).tolist():
        rows.append((i, int(up[i]), int(b.len[i]), 1, int(b.total[i]), int(b.own[i]), 1, int(b.ids[i]), 0, parent(i, i + 1)))
    if not rows:
        return pa.Table.from_pylist([], NODES)
    a, upper, value, count, total, own, leaf, conv, children = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:9])
    above = pa.array([r[9] for r in rows], pa.int64())
    which = np.repeat(np.arange(len(rows)), value - upper)
    nth = np.arange(len(which)) - np.repeat(np.r_[0, np.cumsum(value - upper)][:-1], value - upper)
    depth = upper[which] + 1 + nth
    bottom = depth == value[which]
    at = a[which]
    shared_words = b.words[b.at[at] + np.maximum(depth - 1, 0)] - b.words[b.at[at]]
    saved = total[which] - count[which] * shared_words - (own[which] - b.own[at]) - (b.total[at] - shared_words)
    ended = bottom & (b.len[at] == depth)
    conv = pa.array(conv[which])
    return pa.Table.from_arrays(
        [conv, pa.array(depth), pc.if_else(pa.array(nth == 0), above.take(pa.array(which)), conv), pa.array(count[which]), pa.array(np.where(bottom, children[which], 1)), pa.array(leaf[which]), pa.array(saved), pa.array([sha[i] if e else NONE_SHA for i, e in zip(at.tolist(), ended.tolist(), strict=True)])],
        schema=NODES,
    )


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of the prefix trie of conversations (conv_id, seq)."""
    space = Workspace(sequences.sparkSession)
    digests = F.unhex(F.array_join(F.transform("seq", lambda x: F.hex(x["digest"])), ""))
    seqs = space.store(sequences.select("conv_id", digests.alias("key"), F.transform("seq", lambda x: x["words"]).alias("words")), "sequences")
    total = seqs.agg(F.sum(F.octet_length("key") + 4 * F.size("words") + 64)).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(total / BLOCK_BYTES))
    by = space.store(seqs.repartitionByRange(blocks, "key", "conv_id").withColumn("part", F.spark_partition_id()), "blocks")
    space.drop(seqs)
    edge = by.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    w = Window.orderBy("part")  # one row a block
    bounds = space.store(edge.select("part", (F.row_number().over(w) - 1).alias("block"), F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("behind")), "bounds")
    rows = by.groupBy("part")
    summary = space.store(rows.cogroup(bounds.groupBy("part")).applyInArrow(_summary, from_arrow_schema(_SUMMARY)), "summary")
    minima = Minima(summary.select("block", "least", "starts", *SUMS, "low").orderBy("block").collect())
    known = by.sparkSession.sparkContext.broadcast(minima)
    nodes, answers = _crossing(summary, known)
    begun = by.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(minima.begun)], "block int, begun int")
    heads = joined(summary.where("size(head) > 0").select("block", "head"), begun, ["block"], grows=False).select("begun", "block", F.posexplode("head").alias("k", "piece"))
    tails = summary.where("starts").select(F.col("block").alias("begun"), "block", F.posexplode("tail").alias("k", "piece"))
    hashes = _stream(tails.union(heads)).withColumnRenamed("begun", "block")
    kept = ["pos", "value", "up", *SUMS, "low", "children", "parent"]
    owned = nodes.groupBy(F.col("lb").alias("block")).agg(F.collect_list(F.struct(*kept)).alias("nodes"))
    told = answers.groupBy("block").agg(F.collect_list(F.struct("value", "side", "low")).alias("answers"))
    aux = bounds
    for extra in (owned, told, hashes):
        aux = joined(aux, extra, ["block"], "left", grows=False)
    aux = space.store(aux, "aux")
    return space.finish(rows.cogroup(aux.groupBy("part")).applyInArrow(_expand, from_arrow_schema(NODES)), "trie")
