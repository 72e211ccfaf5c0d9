"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks (native).

Texts and items become words (lower case, letters and digits) and five-word
shingles; an item of fewer words is one shingle.  A text is looked at if it has one of
the shingles that no match can miss all of (a quarter of an item's).  There a window of
an item's size may start anywhere.  A text shorter than the item is one window, of its
own size.  Moved on word by word, a window gains shingles of the item only where one
stands at its end, so the first of the best windows starts at such a place or at 0: a
running sum over the places where shingles enter and leave (a repeated one counts as
often as the item has it) leaves the starts at which enough of the item's shingles
meet for the threshold, and no window that matches better is passed over.

Each such window and item gets a 64-bit SimHash of its shingles weighted by how often
they occur.  ``RADIUS`` + 1 blocks of the fingerprint index the items; fingerprints
within the radius agree on at least one block, so all of them meet.  Exact weighted
Jaccard (sum of minima over sum of maxima) of the shingle counts then decides at
``THRESHOLD``.  Pairs further apart than the radius are not compared; ``radius=63``
compares all (README: recall of both).  A window is compared only with the items whose
shingles asked for it: blocks alone cannot prune at this radius, 21 blocks of 64 bits
have three bits each.

Unrelated by size: nothing is capped.  The items' tell-tale shingles are broadcast
only while they are at most ``BROADCAST_SHINGLES`` (counted first); above, they meet the
texts' by shuffle.

Defined results: null, empty and blank texts match nothing; items without words
match nothing; an item repeated under two item_ids is reported for both; of windows
with equal similarity the first is reported; rows are told apart by doc_id and text
(repeated rows are reported once, rows with equal or null doc_id and other texts
each); very long texts are searched whole; an empty table gives none; extra columns
are ignored, kept by ``clean``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Workspace, digest128, joined, let, window_hashes

SHINGLE, THRESHOLD, RADIUS = 5, 0.75, 20
BROADCAST_SHINGLES = 100_000
LANES = 0x0000000100000001


def norm_words(s: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(s, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")


def simhash(shingle: Column) -> list[Column]:
    """Aggregates of exploded shingle hashes: 32 sums, each counting two of the 64 bits."""
    return [F.sum(F.shiftrightunsigned(shingle, k).bitwiseAND(F.lit(LANES))).alias(f"b{k}") for k in range(32)]


def fingerprint(size: Column) -> Column:
    """The 64 bits from the sums: a bit is set where at least half of the weight has it."""
    fp = F.lit(0).cast("long")
    for k in range(32):
        low, high = F.col(f"b{k}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"b{k}"), 32)
        for bit, n in ((k, low), (k + 32, high)):
            fp = fp.bitwiseOR(F.shiftleft((2 * n >= size).cast("long"), bit))
    return fp


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) pairs: ``radius`` + 1 disjoint runs of bits that cover the fingerprint."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    runs = [(i, a, b - a) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for i, a, w in runs])


def _items(bench: DataFrame) -> DataFrame:
    ws = bench.select("item_id", norm_words(F.col("text")).alias("ws")).where("size(ws) > 0")
    hashes = window_hashes(F.col("ws"), SHINGLE)
    for k in range(1, SHINGLE):
        hashes = F.when(F.size("ws") == k, F.array(F.xxhash64(*[F.get("ws", F.lit(i)) for i in range(k)]))).otherwise(hashes)
    return ws.select("item_id", F.least(F.size("ws"), F.lit(SHINGLE)).alias("k"), F.size("ws").alias("n_words"), hashes.alias("h")).withColumn("m", F.size("h"))


def _row_key(docs: DataFrame) -> list[Column]:
    """What tells rows apart: doc_id and two hashes of the text."""
    return [F.col("doc_id").alias("__pagemill_id"), *[h.alias(f"__pagemill_t{i}") for i, h in enumerate(digest128(F.coalesce(F.col("text"), F.lit(""))))]]


KEY = ["__pagemill_id", "__pagemill_t0", "__pagemill_t1"]


def _tells(shingles: DataFrame, threshold: float) -> DataFrame:
    """(k, hash) of which each item needs one in a text that matches it.

    Jaccard t with an item of m shingles takes t * m of them, so a match misses at
    most m - ceil(t * m) and has one of any m - ceil(t * m) + 1.
    """
    shared = shingles.groupBy("k", "hash").agg(F.count(F.lit(1)).alias("n_items"))
    shingles = joined(shingles, shared, ["k", "hash"], grows=False)
    # Those of few items first: what many items share is likelier to be in many texts.
    before = F.coalesce(F.sum("n_item").over(Window.partitionBy("item_id").orderBy("n_items", "hash").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    enough = F.col("m") - F.ceil(F.col("m") * F.lit(threshold) - 1e-9) + 1
    return shingles.withColumn("before", before).where(F.col("before") < enough).select("k", "hash").distinct()


def _hit_docs(space: Workspace, docs: DataFrame, own: DataFrame, ks: list[int]) -> DataFrame:
    """``KEY``, k and the k-word shingle hashes of documents that have one of ``own``; repeated rows once."""
    per_k = lambda ws: F.array(*[F.struct(F.lit(k).alias("k"), window_hashes(ws, k).alias("h")) for k in ks])
    # Generated rows keep what follows from being moved below, where it would hash again.
    hashed = lambda d: d.select(*KEY, F.explode(let(norm_words(F.col("text")), per_k)).alias("x")).select(*KEY, "x.k", "x.h")
    keyed = docs.select(*_row_key(docs), "text")
    own = own.select(F.col("k").alias("__k"), F.col("hash").alias("__hash"))
    own = F.broadcast(own) if own.count() <= BROADCAST_SHINGLES else own.hint("merge")
    ids = hashed(keyed).select(*KEY, "k", F.explode("h").alias("hash")).join(own, (F.col("k") == F.col("__k")) & (F.col("hash") == F.col("__hash")), "left_semi")
    ids = space.store(ids.select(*KEY).distinct(), "ids")
    found = hashed(joined(keyed, ids, KEY, "left_semi", grows=False)).where(F.size("h") > 0)
    return found.groupBy(*KEY, "k").agg(F.first("h").alias("h"))


def _starts(hits: DataFrame, threshold: float) -> DataFrame:
    """Starts of windows that gain a shingle of the item there and hold enough of them, from (row, k, item_id, m, len, n_item, hash, pos)."""
    pair = ["row", "k", "item_id", "m", "len"]
    at = hits.groupBy(*pair, "hash", "n_item").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    # Of a shingle's places in a window the first n_item count: one counts from behind its n_item-th forerunner on.
    span = F.transform("p", lambda x, i: F.struct(F.greatest(F.lit(0), x - F.col("m") + 1, F.coalesce(F.get("p", i - F.col("n_item").cast("int")) + 1, F.lit(0))).alias("lo"), x.alias("hi")))
    e = at.select(*pair, F.explode(span).alias("s")).select(*pair, F.explode(F.array(F.struct(F.col("s.lo").alias("start"), F.lit(1).alias("d")), F.struct((F.col("s.hi") + 1).alias("start"), F.lit(-1).alias("d")))).alias("e"))
    e = e.groupBy(*pair, "e.start").agg(F.sum("e.d").alias("d"))
    both = F.sum("d").over(Window.partitionBy(*pair).orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    e = e.withColumn("both", both).withColumn("size", F.least("len", "m"))
    # Jaccard t of bags of m and size shingles needs t(m+size)/(1+t) of them in common.
    least = F.ceil((F.col("m") + F.col("size")) * F.lit(threshold / (1 + threshold)) - 1e-9)
    return e.where((F.col("d") > 0) & (F.col("both") >= least) & (F.col("start") <= F.greatest(F.col("len") - F.col("m"), F.lit(0)))).select("row", "k", "item_id", "m", "size", "start")


def matches(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance and similarity of the best window of each row and item.

    n_words are the window's: the item's, or all of a shorter text's.
    """
    return _matches(docs, bench, threshold, radius).drop(*KEY)


def _matches(docs: DataFrame, bench: DataFrame, threshold: float, radius: int) -> DataFrame:
    space = Workspace(docs.sparkSession)
    items = space.store(_items(bench), "items")
    shingles = items.select("item_id", "k", "m", F.explode("h").alias("hash")).groupBy("item_id", "k", "m", "hash").agg(F.count(F.lit(1)).alias("n_item"))
    ks = [r["k"] for r in items.select("k").distinct().orderBy("k").collect()]
    if not ks:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, item_id long, start_word int, n_words int, distance int, similarity double, {KEY[0]} {kind}, {KEY[1]} long, {KEY[2]} long")
    # Few rows are left from here on; each gets a number that stands for its key.
    texts = space.store(_hit_docs(space, docs, space.store(_tells(shingles, threshold), "tells"), ks), "texts")
    texts = space.store(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    places = texts.select("row", "k", F.size("h").alias("len"), F.posexplode("h").alias("pos", "hash"))
    hits = joined(places, shingles.select("k", "hash", "item_id", "m", "n_item"), ["k", "hash"], grows=False)
    asked = _starts(hits, threshold)
    # A window is made once, whichever items asked for it; only those are compared with it.
    asked = space.store(asked, "asked")
    window = ["row", "m", "size", "start"]
    t = texts.select(F.col("row").alias("__r"), "h")
    starts = asked.select(*window).distinct()
    windows = space.store(starts.join(t, F.col("row") == F.col("__r")).select(*window, F.explode(F.slice("h", F.col("start") + 1, F.col("m"))).alias("hash")), "windows")
    prints = items.select("item_id", "m", F.explode("h").alias("hash")).groupBy("item_id", "m").agg(*simhash(F.col("hash"))).select("item_id", fingerprint(F.col("m")).alias("fp_item"))
    fps = windows.groupBy(*window).agg(*simhash(F.col("hash"))).select(*window, fingerprint(F.col("size")).alias("fp"))
    index = prints.select("item_id", "fp_item", F.explode(blocks(F.col("fp_item"), radius)).alias("b")).select("item_id", "fp_item", "b.*")
    probe = joined(asked, fps, window).select(*window, "k", "item_id", "fp", F.explode(blocks(F.col("fp"), radius)).alias("b")).select(*window, "k", "item_id", "fp", "b.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item")))
    pairs = joined(probe, index, ["item_id", "block", "value"], grows=False).where(distance <= radius).groupBy(*window, "k", "item_id").agg(F.first(distance).alias("distance"))
    bag = windows.groupBy("row", "m", "start", "hash").agg(F.count(F.lit(1)).alias("n_win"))
    common = joined(bag, shingles.select("m", "hash", "item_id", "n_item"), ["m", "hash"], grows=False).groupBy("row", "start", "item_id").agg(F.sum(F.least("n_win", "n_item")).alias("both"))
    scored = joined(pairs, common, ["row", "start", "item_id"]).withColumn("similarity", F.col("both") / (F.col("m") + F.col("size") - F.col("both")))
    best = F.max_by(F.struct("start", "distance", "similarity"), F.struct("similarity", -F.col("start")))
    found = scored.where(F.col("similarity") >= threshold).groupBy("row", "item_id", (F.col("size") + F.col("k") - 1).alias("n_words")).agg(best.alias("w"))
    out = joined(found, texts.select("row", *KEY), ["row"]).select(
        F.col(KEY[0]).alias("doc_id"), "item_id", F.col("w.start").alias("start_word"), "n_words", F.col("w.distance").cast("int").alias("distance"), F.round("w.similarity", 6).alias("similarity"), *KEY
    )
    return space.finish(out, "matches")


def clean(docs: DataFrame, bench: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """Rows without a match, all their columns."""
    bad = _matches(docs, bench, threshold, radius).select(*KEY).distinct()
    return joined(docs.select(*_row_key(docs), *docs.columns), bad, KEY, "left_anti", grows=False).select(*docs.columns)


#: The same pairs without fingerprints: exact similarity of the windows at every start.
ORACLE = r"""
with iw as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
i as (select item_id, ws, len(ws) as n_words, len(ws) - 4 as m from iw where len(ws) >= 5),
ish as (select item_id, m, n_words, array_to_string(ws[j+1:j+5], ' ') as sh from (select *, unnest(generate_series(0, m - 1)) as j from i)),
ic as (select item_id, m, n_words, sh, count(*) as n_item from ish group by all),
dw as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
dsh as (select doc_id, len(ws) - 4 as len, pos, array_to_string(ws[pos+1:pos+5], ' ') as sh from (select *, unnest(generate_series(0, len(ws) - 5)) as pos from dw where len(ws) >= 5)),
hit as (select doc_id, len, pos, item_id, m, n_words, n_item, sh from dsh join ic using (sh)),
enough as (select doc_id, item_id, m, n_words, len, least(len, m) as size from hit group by all having count(*) >= ceil((m + least(len, m)) * 0.75 / 1.75 - 1e-9)),
st as (select *, unnest(generate_series(0, greatest(len - m, 0))) as start from enough),
wc as (select st.doc_id, st.item_id, st.m, st.n_words, size, start, sh, n_item, count(*) as n_win from st join hit on hit.doc_id = st.doc_id and hit.item_id = st.item_id and pos between start and start + st.m - 1 group by all),
sim as (select doc_id, item_id, m, n_words, size, start, sum(least(n_win, n_item)) as b from wc group by all),
ok as (select *, b / (m + size - b) as s from sim where b / (m + size - b) >= 0.75)
select doc_id, item_id, arg_max(start, row(s, -start))::int as start_word, (size + 4)::int as n_words, round(max(s), 6) as similarity from ok group by doc_id, item_id, size
"""
