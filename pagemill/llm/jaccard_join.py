"""Exact n-gram Jaccard self-join with set-relation skipping.

Sets are the distinct five-word shingles of a text (a shorter text is one
shingle), as 48-bit hashes (two texts of 500 words mistake a shingle once in 10^9
pairs); two link when 100 * |A n B| >= 75 * |A u B|.

1. *Copies.*  Texts are dealt once into blocks of some MB.  Equal word sequences
   collapse into the member with the smallest doc_id, which stands for all.
2. *Lists.*  A block sends each hash bucket its distinct shingles once, with the
   number of its sets that have them; buckets add up list lengths and send back those
   of shingles that two sets or more have.  Blocks then order their sets' shared
   shingles by list length.  A shingle in every text costs its bucket one entry per
   block, and no list is gathered anywhere.
3. *Index-level skipping.*  A set with fewer shared shingles than any link needs
   is out.  Others enter the index with the rare end of their shingles only
   (prefix), in blocks by size and position; a block is skipped as a whole if its
   best possible overlap is too small.
4. *Stars.*  In each list every set is compared with one leader, not with all.
   A set keeps its leader as pivot, linked or not, with their two differences.
5. *Answer-level skipping.*  Pairs still in different components are settled from
   the pivot's answers.  Under one pivot the differences alone give the overlap,
   and only pairs that can link by it are made; otherwise |x n z| is
   |p n z| - |(p-x) n z| + |(x-p) n z|, and often the sizes of the differences
   decide without looking at z at all.

Pairs within a component are never enumerated; every link between components is
found, so components are exact.

Defined results: null and blank texts have an empty set, link with nothing and
are components of their own; rows are told apart by doc_id and text, so rows with
equal or null doc_id and other texts are sets of their own, linked or not like any
others, and each row gets a result; a component's id is its smallest doc_id, null
only if no member has one; very long texts are whole sets; an empty table gives
none; extra columns are ignored, whatever their names.  ``clean`` keeps of each
component the text of the smallest doc_id (of several, that with the smallest hash);
rows equal in doc_id and text stay or go together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import Workspace, digest128, joined, tidy

N = 5
BLOCK_BYTES, BUCKET_BYTES, LEAST = 8_000_000, 32_000_000, 64
LONG_LIST = 2_000
HASH_BITS = 48
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], np.uint64)
NO_ID = np.iinfo(np.int64).max
_BLK = "__pagemill_block"
_MESSAGE = f"{_BLK} int, blob binary"
REPS, LENGTHS = 1, 2


def shingle_set(text: str | None, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of a text's ``n``-word shingles."""
    w = blobs.hash_words(blobs.words(text))
    if not len(w):
        return w
    k = min(n, len(w))
    s = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        s += w[i : len(w) - k + 1 + i] * _C[i % len(_C)] ** np.uint64(1 + i // len(_C))
    return np.unique(blobs.mix(s) >> np.uint64(64 - HASH_BITS))


class Block:
    """The distinct (doc_id, text) of one block in order, each row's place among them, and a key for every one."""

    def __init__(self, t: pa.Table, n: int):
        self.blk, self.n = t[_BLK][0].as_py(), n
        rows = list(zip([NO_ID if i is None else i for i in t["doc_id"].to_pylist()], [x or "" for x in t["text"].to_pylist()], strict=True))
        self.docs = sorted(set(rows))
        place = {k: i for i, k in enumerate(self.docs)}
        self.of_row = np.array([place[k] for k in rows], np.int64)
        self.ids = np.array([d[0] for d in self.docs], np.int64)
        self.keys = (np.int64(self.blk) << np.int64(32)) + np.arange(len(self.docs), dtype=np.int64)

    def hear(self, values: list[bytes]) -> list[list[np.ndarray]]:
        """Takes in which sets stand for others; the other messages."""
        self.rep, self.rep_doc, rest = self.keys.copy(), self.ids.copy(), []
        for v in values:
            kind, *cols = blobs.unpack(v)
            if kind[0] == REPS:
                self.rep[cols[0]], self.rep_doc[cols[0]] = cols[1], cols[2]
            else:
                rest.append(cols)
        self.stands = self.rep == self.keys
        return rest

    def sets(self) -> list[np.ndarray]:
        return [shingle_set(text, self.n) for _, text in self.docs]

    def lists(self, sets: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct shingles of the sets that stand for themselves, how many of those have each, and where buckets begin."""
        own = [x for x, stands in zip(sets, self.stands, strict=True) if stands]
        h, n = np.unique(np.concatenate(own) if own else np.empty(0, np.uint64), return_counts=True)
        return h, n, np.searchsorted(h >> np.uint64(HASH_BITS - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _rows(keys: list[int], values: list[bytes], name: str = _BLK) -> pa.Table:
    return pa.Table.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], [name, "blob"])


def _digests(n: int, bits: int):
    """Digests of a block's word sequences, by bucket."""

    def run(t: pa.Table) -> pa.Table:
        b = Block(t, n)
        ws = [blobs.words(text) for _, text in b.docs]
        some = np.flatnonzero([len(w) > 0 for w in ws])
        sig = np.array([np.frombuffer(xxhash.xxh3_128_digest(b" ".join(ws[i])), "<u8") for i in some], np.uint64).reshape(-1, 2)
        bucket = (sig[:, 0] >> np.uint64(64 - bits)).astype(np.int64)
        keys, values = [], []
        for k in np.unique(bucket).tolist():
            at = np.flatnonzero(bucket == k)
            keys.append(k)
            values.append(blobs.pack(np.array([b.blk], np.int64), some[at].astype(np.uint32), sig[at, 0], sig[at, 1], b.ids[some[at]], rising=(1,)))
        return _rows(keys, values, "bucket")

    return run


def _classes(t: pa.Table) -> pa.Table:
    """Per class of two or more: to each member's block, the key and doc_id of the first by (doc_id, key)."""
    parts = [blobs.unpack(v) for v in t["blob"].to_pylist()]
    place, s0, s1, ids = (np.concatenate([p[k] for p in parts]) for k in range(1, 5))
    blk = np.repeat([int(p[0][0]) for p in parts], [len(p[1]) for p in parts]).astype(np.int64)
    key = (blk << np.int64(32)) + place.astype(np.int64)
    by = np.lexsort((key, ids, s1, s0))
    new = np.ones(len(by), bool)
    new[1:] = (s0[by][1:] != s0[by][:-1]) | (s1[by][1:] != s1[by][:-1])
    first = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = ~new
    me, rep = by[later], first[later]
    order = np.lexsort((place[me], blk[me]))
    me, rep = me[order], rep[order]
    at = np.r_[0, np.flatnonzero(np.diff(blk[me])) + 1, len(me)] if len(me) else np.array([0])
    keys, values = [], []
    for x, y in zip(at, at[1:], strict=False):
        keys.append(int(blk[me[x]]))
        values.append(blobs.pack(np.array([REPS], np.uint8), place[me[x:y]], key[rep[x:y]], ids[rep[x:y]], rising=(1,)))
    return _rows(keys, values)


def _send(n: int, bits: int):
    """A block's distinct shingles to every bucket."""

    def run(t: pa.Table, heard: pa.Table) -> pa.Table:
        if not len(t):
            return _rows([], [], "bucket")
        b = Block(t, n)
        b.hear(heard["blob"].to_pylist())
        h, count, edges = b.lists(b.sets(), bits)
        keys = np.flatnonzero(np.diff(edges)).tolist()
        return _rows(keys, [blobs.pack(np.array([b.blk], np.int64), h[edges[k] : edges[k + 1]], count[edges[k] : edges[k + 1]].astype(np.uint32), rising=(1,)) for k in keys], "bucket")

    return run


def _lengths(t: pa.Table) -> pa.Table:
    """List lengths of a bucket's shingles in two sets or more, to each block that has them."""
    bucket = t["bucket"][0].as_py()
    parts = [blobs.unpack(v) for v in t["blob"].to_pylist()]
    h, at = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[2] for p in parts]), len(h)).astype(np.uint32)
    ends = np.cumsum([len(p[1]) for p in parts])
    keys, values = [], []
    for p, mine in zip(parts, np.split(total[at], ends[:-1]), strict=True):
        shared = np.flatnonzero(mine > 1)
        if len(shared):
            keys.append(int(p[0][0]))
            values.append(blobs.pack(np.array([LENGTHS], np.uint8), np.array([bucket], np.int64), shared.astype(np.uint32), mine[shared], rising=(2,)))
    return _rows(keys, values)


_SHARED = "doc_id long, t0 long, t1 long, n int, key long, rep long, rep_doc long, fps array<long>, dfs array<int>"


def _shared(n: int, bits: int):
    """Every row's set size and who stands for it; for the sets that stand, shared shingles by (list length, hash)."""

    def run(t: pa.Table, heard: pa.Table) -> pa.Table:
        if not len(t):
            return pa.table({k: pa.array([], v) for k, v in types})
        b = Block(t, n)
        lengths = b.hear(heard["blob"].to_pylist())
        sets = b.sets()
        h, _, edges = b.lists(sets, bits)
        df = np.zeros(len(h), np.int32)
        for bucket, place, length in lengths:
            df[edges[bucket[0]] + place.astype(np.int64)] = length
        none = np.empty(0, np.int64)
        fps, dfs = [none] * len(sets), [none] * len(sets)
        for i in np.flatnonzero(b.stands).tolist():
            d = df[np.searchsorted(h, sets[i])]
            m = int((d > 1).sum())
            # Fewer shared shingles than any link needs: out.
            if m and 4 * m >= 3 * len(sets[i]):
                x, d = sets[i][d > 1], d[d > 1]
                by = np.lexsort((x, d))
                fps[i], dfs[i] = x[by].view(np.int64), d[by]
        size = np.array([len(x) for x in sets], np.int32)
        r = b.of_row
        # Of equal rows the first carries the set.
        once = np.zeros(len(r), bool)
        once[np.unique(r, return_index=True)[1]] = True
        unknown = lambda a: pa.array(a, pa.int64(), mask=a == NO_ID)
        cols = [t["doc_id"], t["t0"], t["t1"], pa.array(size[r]), pa.array(b.keys[r]), pa.array(b.rep[r]), unknown(b.rep_doc[r])]
        cols += [pa.array([x[i] if o else none for i, o in zip(r.tolist(), once.tolist(), strict=True)], kind) for x, kind in ((fps, pa.list_(pa.int64())), (dfs, pa.list_(pa.int32())))]
        return pa.Table.from_arrays(cols, [k for k, _ in types])

    types = [("doc_id", pa.int64()), ("t0", pa.int64()), ("t1", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("rep", pa.int64()), ("rep_doc", pa.int64()), ("fps", pa.list_(pa.int64())), ("dfs", pa.list_(pa.int32()))]
    return run


def shared(docs: DataFrame, n: int = N) -> DataFrame:
    """A row per document: size of its set, the key of the set that stands for it and that one's doc_id; see ``_shared``."""
    blocks = blobs.bucket_count(docs, BLOCK_BYTES, LEAST)
    bits = blobs.bucket_count(docs, BUCKET_BYTES, LEAST).bit_length() - 1
    ids = F.col("doc_id").cast("long")
    t0, t1 = digest128(F.coalesce(F.col("text"), F.lit("")))
    # One exchange of the texts; every step reads it.
    dealt = docs.select(ids.alias("doc_id"), "text", t0.alias("t0"), t1.alias("t1"), F.pmod(F.xxhash64(ids, F.col("text")), F.lit(blocks)).cast("int").alias(_BLK)).groupBy(_BLK)
    reps = dealt.applyInArrow(_digests(n, bits), "bucket int, blob binary").groupBy("bucket").applyInArrow(_classes, _MESSAGE)
    lengths = dealt.cogroup(reps.groupBy(_BLK)).applyInArrow(_send(n, bits), "bucket int, blob binary").groupBy("bucket").applyInArrow(_lengths, _MESSAGE)
    return dealt.cogroup(reps.unionByName(lengths).groupBy(_BLK)).applyInArrow(_shared(n, bits), _SHARED)


def linked(both: Column, n1: Column, n2: Column) -> Column:
    """100 * both >= 75 * (n1 + n2 - both) in integers."""
    return 7 * both >= 3 * (n1 + n2)


def _sets(rows: DataFrame) -> DataFrame:
    """Sets that can have a link: doc_id (their key from here on), n, shared shingles in (list length, hash) order."""
    # How common its shingles are: an original has more of them in common than any of its edited copies.
    hub = F.aggregate("dfs", F.lit(0).cast("long"), lambda a, x: a + x) / F.col("n")
    return rows.where(F.size("fps") > 0).select(F.col("key").alias("doc_id"), "n", "fps", "dfs", hub.alias("hub"))


def _index(sets: DataFrame) -> DataFrame:
    """(fp, df, doc_id, n, hub, pos): the prefix of each set; shingles that no other set has come first and need no entry."""
    need = F.floor((3 * F.col("n") + 3) / 4).cast("int")
    keep = F.size("fps") - need + 1
    both = F.arrays_zip(F.slice("fps", 1, keep).alias("fp"), F.slice("dfs", 1, keep).alias("df"))
    rows = sets.select("doc_id", "n", "hub", F.posexplode(both).alias("i", "x"), (F.col("n") - F.size("fps")).alias("u"))
    return rows.select(F.col("x.fp").alias("fp"), F.col("x.df").alias("df"), "doc_id", "n", "hub", (F.col("u") + F.col("i")).alias("pos"))


def _by_list(index: DataFrame, lists: DataFrame) -> DataFrame:
    """Index rows with what their list has; a list is dealt over one task per ``LONG_LIST`` sets, its length being known on both sides."""
    parts = F.ceil(F.col("df") / LONG_LIST).cast("int")
    left = index.withColumn("__salt", F.pmod(F.hash("doc_id"), parts))
    right = lists.withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return left.join(right, ["fp", "df", "__salt"]).drop("__salt")


def _can(n1: Column, p1: Column, n2: Column, p2: Column) -> Column:
    """Whether sets that first meet at these positions can have the overlap of a link."""
    return linked(F.least(n1 - p1, n2 - p2), n1, n2)


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) with the overlap, what a has more, what b has more, and whether they link."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("fps").alias("fa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("hub").alias("hub"), F.col("fps").alias("fb"))
    # Plain joins: sets are large rows not to be copied; adaptive execution splits a leader with very many pairs.
    full = pairs.join(b, "b").join(a, "a").withColumn("plus", F.array_except("fa", "fb"))
    both = F.size("fa") - F.size("plus")
    full = full.withColumn("both", both).withColumn("link", linked(both, F.col("na"), F.col("nb")))
    # Half in common makes a pivot; of others only the answer is kept.
    near = 2 * F.col("both") >= F.col("na")
    return full.select("a", "b", "na", "hub", "both", "link", F.when(near, F.col("plus")).alias("plus"), F.when(near, F.array_except("fb", "fa")).alias("minus"))


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """(doc_id, comp) of every end of the edges (a, b); comp is the smallest id reachable.

    Labels sink along edges and jump to their label's label until none changes.
    """
    both = space.store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    done, before = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc_id"), F.least("a", "m").alias("comp")), None
    while True:
        labels = done.select("doc_id", "comp")
        near = joined(both, labels.select(F.col("doc_id").alias("b"), "comp"), ["b"]).groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("low"))
        sunk = labels.join(near, "doc_id").select("doc_id", F.col("comp").alias("old"), F.least("comp", "low").alias("comp"))
        jump = joined(sunk, labels.select(F.col("doc_id").alias("comp"), F.col("comp").alias("up")), ["comp"])
        done = space.store(jump.select("doc_id", "old", F.least("comp", "up").alias("comp")), "labels")
        if before is not None:
            space.drop(before)
        before = done
        if done.where("old <> comp").isEmpty():
            space.drop(both)
            return done.select("doc_id", "comp")


def _star_round(index: DataFrame, sets: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Every set compared with one leader in each of its lists: the one with the most common shingles.

    Later rounds take lists of several components and lead with the best set
    outside the first leader's component.
    """
    best = F.max(F.struct("hub", "doc_id", "n", "pos", "comp"))
    own = index.withColumn("comp", F.col("doc_id")) if comp is None else index.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    lead = own.groupBy("fp", "df").agg(best.alias("l"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    if comp is not None:
        rest = _by_list(own, lead.select("fp", "df", F.col("l.comp").alias("first"))).where(F.col("comp") != F.col("first"))
        lead = rest.groupBy("fp", "df").agg(best.alias("l"))
    lead = lead.select("fp", "df", F.col("l.doc_id").alias("b"), F.col("l.n").alias("nb"), F.col("l.pos").alias("pb"), F.col("l.comp").alias("cb"))
    met = _by_list(own, lead).where((F.col("doc_id") != F.col("b")) & (F.col("comp") != F.col("cb")) & _can(F.col("n"), F.col("pos"), F.col("nb"), F.col("pb")))
    return _compare(met.select(F.col("doc_id").alias("a"), "b").distinct(), sets)


def _pivots(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Per set (doc_id): pivot, both, plus, minus; of several the most common leader, without one itself."""
    best = F.max_by(F.struct("b", "both", "plus", "minus"), F.struct("hub", "b"))
    led = stars.where("plus is not null").groupBy("a").agg(best.alias("p"))
    none = F.array().cast("array<bigint>")
    j = sets.select("doc_id", "n", F.size("fps").alias("m")).join(led.withColumnRenamed("a", "doc_id"), "doc_id", "left")
    own = F.col("p").isNull()
    return j.select(
        "doc_id", "n", "m", F.when(own, F.col("doc_id")).otherwise(F.col("p.b")).alias("pivot"), F.when(own, F.col("m")).otherwise(F.col("p.both")).alias("both"),
        F.when(own, none).otherwise(F.col("p.plus")).alias("plus"), F.when(own, none).otherwise(F.col("p.minus")).alias("minus"),
    )


def _within(groups: DataFrame) -> DataFrame:
    """Links (a, b) between components inside pivot groups, from the members' differences alone.

    Members x, z of pivot p have |p| - |(p-x) u (p-z)| + |(x-p) n (z-p)| in common.
    They link only if they share a shingle that p lacks, or if |p n x| and |p n z|
    both are enough for their sizes; only such pairs are made, and only of members
    outside the pivot's component with others, not of the many inside with each other.
    """
    cols = ["doc_id", "n", "both", "comp", "plus", "minus"]
    left = groups.select("pivot", *[F.col(c).alias(f"x_{c}") for c in cols], "m_pivot")
    small = groups.select("pivot", "doc_id", "n", "both", "comp", F.size("plus").alias("k"))
    enough = lambda c: 7 * F.col(c) >= 3 * (F.col("n") + F.col("n2"))
    other = small.select("pivot", F.col("doc_id").alias("z"), F.col("n").alias("n2"), F.col("both").alias("both2"), F.col("comp").alias("comp2"), F.col("k").alias("k2"))
    # By size: x offers itself under every size that its overlap with the pivot allows a partner.
    reach = F.floor((7 * F.col("both") - 3 * F.col("n")) / 3).cast("int")
    low = F.ceil(0.75 * F.col("n")).cast("int")
    outside = groups.where("comp <> comp_pivot").select("doc_id")
    offers = small.where(reach >= low).join(outside, "doc_id", "left_semi").select("*", F.explode(F.sequence(low, F.least(reach, F.floor(F.col("n") / 0.75).cast("int")))).alias("n2"))
    sized = offers.join(other, ["pivot", "n2"]).where((F.col("comp") != F.col("comp2")) & enough("both2"))
    # By a shingle that the pivot lacks.
    odd = groups.select("pivot", "doc_id", "n", "both", "comp", F.size("plus").alias("k"), F.explode("plus").alias("fp"))
    odd2 = odd.select("pivot", "fp", F.col("doc_id").alias("z"), F.col("n").alias("n2"), F.col("both").alias("both2"), F.col("comp").alias("comp2"), F.col("k").alias("k2"))
    bound = 7 * (F.least("both", "both2") + F.least("k", "k2")) >= 3 * (F.col("n") + F.col("n2"))
    odd_pairs = odd.join(outside, "doc_id", "left_semi").join(odd2, ["pivot", "fp"]).where((F.col("comp") != F.col("comp2")) & bound)
    ends = ["pivot", F.least("doc_id", "z").alias("x_doc_id"), F.greatest("doc_id", "z").alias("z")]
    pairs = sized.select(*ends).union(odd_pairs.select(*ends)).distinct()
    z = groups.select("pivot", F.col("doc_id").alias("z"), F.col("n").alias("z_n"), F.col("plus").alias("z_plus"), F.col("minus").alias("z_minus"))
    full = pairs.join(left, ["pivot", "x_doc_id"]).join(z, ["pivot", "z"])
    both = F.col("m_pivot") - F.size(F.array_union("x_minus", "z_minus")) + F.size(F.array_intersect("x_plus", "z_plus"))
    return full.where(linked(both, F.col("x_n"), F.col("z_n"))).select(F.col("x_doc_id").alias("a"), F.col("z").alias("b"))


def _across(index: DataFrame, groups: DataFrame, space: Workspace) -> DataFrame:
    """Candidate pairs (a, z) of different components and pivots, list blocks skipped by size and position."""
    own = index.join(groups.select("doc_id", "comp", "pivot"), "doc_id")
    open_lists = own.groupBy("fp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("pivot").alias("p0"), F.max("pivot").alias("p1")).where("lo <> hi and p0 <> p1").select("fp")
    own = space.store(own.join(open_lists, "fp", "left_semi").drop("hub"), "open")
    # A very long list has a part for each LONG_LIST of its sets, so that a block stays bounded.
    block = own.groupBy("fp", "df", "pivot", F.floor(F.log2("n") * 2).alias("nb"), F.floor(F.col("pos") / 8).alias("pb"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("df") / LONG_LIST)).alias("part")).agg(
        F.min("pos").alias("pos_lo"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"), F.collect_list(F.struct("doc_id", "n", "pos", "comp")).alias("members")
    )
    block = block.withColumnRenamed("pivot", "pivot2")
    best = F.least(F.col("n") - F.col("pos"), F.col("n_hi") - F.col("pos_lo"))
    met = _by_list(own, block).where((F.col("pivot") != F.col("pivot2")) & (7 * best >= 3 * (F.col("n") + F.col("n_lo"))))
    fits = lambda m: (F.col("doc_id") < m["doc_id"]) & (F.col("comp") != m["comp"]) & _can(F.col("n"), F.col("pos"), m["n"], m["pos"])
    pairs = met.select("doc_id", F.explode(F.filter("members", fits)).alias("m"))
    return pairs.select(F.col("doc_id").alias("a"), F.col("m.doc_id").alias("z")).distinct()


def _from_pivots(pairs: DataFrame, groups: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """Linked pairs (a, b) of (a, z), derived from what is known of a's pivot."""
    mine = groups.select(F.col("doc_id").alias("a"), "pivot", F.col("n").alias("na"), "plus", "minus")
    p = pairs.join(mine, "a").join(sets.select(F.col("doc_id").alias("z"), F.col("n").alias("nz")), "z")
    p = space.store(p, "rest")
    fp, fz = sets.select(F.col("doc_id").alias("pivot"), F.col("fps").alias("fp")), sets.select(F.col("doc_id").alias("z"), F.col("fps").alias("fz"))
    # The pivot's answers, once for all sets that have it.
    asked = p.select("pivot", "z").distinct()
    answers = asked.join(fp, "pivot").join(fz, "z").select("pivot", "z", F.size(F.array_intersect("fp", "fz")).alias("known"))
    p = p.join(answers, ["pivot", "z"])
    known, na, nz = F.col("known"), F.col("na"), F.col("nz")
    sure = p.where(linked(known - F.size("minus"), na, nz)).select("a", F.col("z").alias("b"))
    maybe = p.where(~linked(known - F.size("minus"), na, nz) & linked(known + F.size("plus"), na, nz))
    exact = maybe.join(fz, "z")
    both = known - F.size(F.array_intersect("minus", "fz")) + F.size(F.array_intersect("plus", "fz"))
    return sure.union(exact.where(linked(both, na, nz)).select("a", F.col("z").alias("b")))


def _join(docs: DataFrame, n: int = N, rounds: int = 2) -> DataFrame:
    """doc_id, t0 and t1 (hashes of the text), n_shingles, component_id and label (one number per component) of every row."""
    space = Workspace(docs.sparkSession, grows=True)
    rows = space.store(shared(docs, n), "shared")
    sets = _sets(rows)
    every = rows.select("doc_id", "t0", "t1", F.col("n").cast("long").alias("n_shingles"), "rep", "rep_doc")
    index = space.store(_index(sets), "index")
    tidy(space.spark)
    stars = comp = None
    for _ in range(rounds):
        found = space.store(_star_round(index, sets, comp), "stars")
        stars = found if stars is None else stars.union(found)
        comp = components(stars.where("link"), space)
    groups = _pivots(stars, sets).join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    # What is asked of a pivot is put together first, so that the one join with its many members can be split.
    asked = sets.select(F.col("doc_id").alias("pivot"), F.size("fps").alias("m_pivot")).join(comp.select(F.col("doc_id").alias("pivot"), F.col("comp").alias("comp_pivot")), "pivot", "left")
    asked = space.store(asked.withColumn("comp_pivot", F.coalesce("comp_pivot", "pivot")), "asked")
    groups = space.store(groups.join(asked, "pivot"), "groups")
    rest = _within(groups).union(_from_pivots(_across(index, groups, space), groups, sets, space))
    rest = space.store(rest, "links")
    if not rest.isEmpty():
        comp = components(stars.where("link").select("a", "b").union(rest), space)
    linked_ = joined(every, comp.select(F.col("doc_id").alias("rep"), "comp"), ["rep"], "left")
    # Labels are keys of sets; a component is named by its smallest doc_id.
    low = linked_.where("comp is not null").groupBy("comp").agg(F.min("rep_doc").alias("low"))
    out = joined(linked_, low, ["comp"], "left").select(
        "doc_id", "t0", "t1", "n_shingles", F.when(F.col("comp").isNull(), F.col("rep_doc")).otherwise(F.col("low")).alias("component_id"), F.coalesce("comp", "rep").alias("label")
    )
    return space.finish(out, "components")


def join(docs: DataFrame, n: int = N, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _join(docs, n, rounds).select("doc_id", "n_shingles", "component_id")


def clean(docs: DataFrame, n: int = N, rounds: int = 2) -> DataFrame:
    """One document of every component, that with its smallest doc_id; all columns."""
    first = _join(docs, n, rounds).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("label").agg(F.min(F.struct("doc_id", "t0", "t1")).alias("k"))
    key = ["__pagemill_id", "__pagemill_t0", "__pagemill_t1"]
    keep = first.select(*[F.col(f"k.{c}").alias(k) for c, k in zip(("doc_id", "t0", "t1"), key, strict=True)])
    t0, t1 = digest128(F.coalesce(F.col("text"), F.lit("")))
    known = docs.select(*[c.alias(k) for c, k in zip((F.col("doc_id").cast("long"), t0, t1), key, strict=True)], *docs.columns)
    return joined(known, keep, key, "left_semi").select(*docs.columns)
