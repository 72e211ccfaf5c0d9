"""Substring dedup by hashing lines, paragraphs or the sentences of lines.

A text's words (A-Z lowered, white space collapsed) are cut into units: lines,
paragraphs, or line pieces that end at a sentence or clause mark (``sentence``,
the default: a passage that was pasted into the middle of a line has whole pieces
of its own, but no whole line).  Lines and paragraphs are hashed whatever their
length.  A sentence of fewer than ``MIN_WORDS`` words repeats by chance, so what is
hashed is, from every one on, the shortest run of whole sentences with that many
words, and a shorter text as a whole; ``min_words=1`` takes every sentence.  Digests
are grouped over all documents; the earliest occurrence (smallest doc_id, then place)
stays, every other one is removed.

A removed run of sentences is then grown word by word while its neighbours equal
those of the kept occurrence, back to the last cut before it and on to the first cut
``min_words`` words after it: there the digests decide anew.  So a repeated
passage goes as a whole, also the ends that are no whole unit.  Each removed word
has an equal one in an earlier place; where a run overlaps its own copy, one
period stays.  Removed spans keep their offsets in the original text, in code
points, end exclusive, with the white space on one side of them.

Texts are dealt once into blocks of some MB.  Blocks and digest buckets exchange
packed columns only: (1) each block sends one entry per distinct digest to the
digest's bucket, however often it occurs there; (2) a bucket answers the blocks
whose digests stand earlier elsewhere; (3) blocks ask the kept occurrences' blocks
for the words around their runs; (4) those answer; (5) blocks cut their texts.  A
line in a third of all documents costs a bucket one entry per block.

Defined results: null stays null, empty and blank texts stay; a run repeated
inside one document is removed there too; rows with equal doc_id and text are one
document (all get the same cut), rows with equal or null doc_id and other texts
are documents of their own, a null doc_id being the smallest; an empty table gives
none; very long texts are processed whole, in a block of their own size; extra
columns are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blobs

MIN_WORDS = 10
BLOCK_BYTES, LEAST_BLOCKS = 8_000_000, 64
#: Characters that end a piece of a line: sentence and clause marks.
MARKS = ".!?,;:。！？，、；：…"
NO_ID = np.iinfo(np.int64).min
_BLK = "__pagemill_block"
_MESSAGE = f"{_BLK} int, blob binary"
REMOVED = "__pagemill_removed"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("kept_doc_id", T.LongType())]))
_SPANS_PA = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("kept_doc_id", pa.int64())]))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The last three bytes of a word that ends with a mark, shorter marks filled by zeros.
_ONE = np.array([ord(c) for c in MARKS if ord(c) < 128], np.int32)
_THREE = np.array([int.from_bytes(c.encode(), "big") for c in MARKS if ord(c) > 127], np.int32)


class Words:
    """Words of one text: 64-bit hashes, byte offsets, and whether a unit ends after each."""

    def __init__(self, text: str, unit: str):
        raw = text.encode("utf-8", "surrogatepass")
        self.hash = blobs.hash_words(raw.lower().split())
        b = np.frombuffer(raw, np.uint8)
        space = _SPACE[b]
        edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
        self.bytes, self.start, self.end = b, edge[::2], edge[1::2]
        n = len(self.hash)
        lines = np.r_[0, np.cumsum(b == 0x0A)]
        gap = lines[np.r_[self.start[1:], len(b)]] - lines[self.end] if n else np.empty(0, np.int64)
        cut = gap >= (2 if unit == "paragraph" else 1)
        if unit == "sentence" and n:
            last = [b[np.maximum(self.end - k, 0)].astype(np.int32) for k in (1, 2, 3)]
            cut |= np.isin(last[0], _ONE) | np.isin(last[0] | last[1] << 8 | last[2] << 16, _THREE)
        if n:
            cut[-1] = True
        self.cuts = np.flatnonzero(cut) + 1

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """From each unit's first word, the shortest run of whole units with ``least`` words: first word and end; a text of fewer is one."""
        if 0 < len(self.hash) < least:
            return np.array([0]), np.array([len(self.hash)])
        first = np.r_[0, self.cuts[:-1]] if len(self.cuts) else self.cuts
        at = np.searchsorted(self.cuts, first + least)
        has = at < len(self.cuts)
        return first[has], self.cuts[at[has]]

    def around(self, a: int, z: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words from the cut before ``a`` (backwards), and from ``z`` to the first cut ``least`` words on."""
        before = self.cuts[: np.searchsorted(self.cuts, a)]
        low = int(before[-1]) if len(before) else 0
        at = np.searchsorted(self.cuts, z + least)
        high = int(self.cuts[at]) if at < len(self.cuts) else len(self.hash)
        return self.hash[low:a][::-1], self.hash[z:high]

    def span(self, a: int, z: int) -> tuple[int, int]:
        """Bytes of the words [a, z) with the white space before them if a line or the text ends behind, else with that after them."""
        ends = z == len(self.start) or bool((self.bytes[self.end[z - 1] : self.start[z]] == 0x0A).any())
        if ends and a:
            return int(self.end[a - 1]), int(self.end[z - 1])
        return int(self.start[a]), int(self.start[z]) if z < len(self.start) else int(self.end[z - 1])


class Block:
    """The distinct (doc_id, text) of one block in rank order, and where each row's stands."""

    def __init__(self, t: pa.Table, unit: str):
        ids = [NO_ID if i is None else int(i) for i in t["doc_id"].to_pylist()]
        keys = list(zip(ids, t["text"].to_pylist(), strict=True))
        self.docs = sorted({k for k in keys if k[1]})
        place = {k: i for i, k in enumerate(self.docs)}
        self.of_row = [place.get(k, -1) for k in keys]
        self.unit = unit

    def words(self, i: int) -> Words:
        return Words(self.docs[i][1], self.unit)


class Digests:
    """A block's runs, grouped by digest within each bucket: the first occurrence of every digest, and all of them."""

    def __init__(self, block: Block, least: int, bits: int):
        hi, lo, doc, start, end = [], [], [], [], []
        for i in range(len(block.docs)):
            w = block.words(i)
            a, z = w.runs(least)
            data = w.hash.tobytes()
            d = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[8 * x : 8 * y]) for x, y in zip(a.tolist(), z.tolist(), strict=True)), ">u8").reshape(-1, 2)
            hi.append(d[:, 0].astype(np.uint64))
            lo.append((d[:, 1] >> np.uint64(32)).astype(np.uint32))
            doc.append(np.full(len(a), i, np.uint32))
            start.append(a.astype(np.uint32))
            end.append(z.astype(np.uint32))
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        hi, lo, doc, start, end = (cat(x, k) for x, k in ((hi, np.uint64), (lo, np.uint32), (doc, np.uint32), (start, np.uint32), (end, np.uint32)))
        order = np.lexsort((start, doc, lo, hi))
        self.hi, self.lo, self.doc, self.start, self.end = hi[order], lo[order], doc[order], start[order], end[order]
        new = np.ones(len(hi), bool)
        new[1:] = (self.hi[1:] != self.hi[:-1]) | (self.lo[1:] != self.lo[:-1])
        self.first = np.flatnonzero(new)
        self.group = np.cumsum(new) - 1
        self.count = np.diff(np.r_[self.first, len(hi)])
        # Buckets are runs of the sorted digests.
        self.edges = np.searchsorted(self.hi[self.first] >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))


def _rows(blk: list[int], values: list[bytes], name: str = _BLK) -> pa.Table:
    return pa.Table.from_arrays([pa.array(blk, pa.int32()), pa.array(values, pa.binary())], [name, "blob"])


def _send(unit: str, least: int, bits: int):
    """(1) Entries of a block for every bucket."""

    def run(t: pa.Table) -> pa.Table:
        block = Block(t, unit)
        ids = np.array([k[0] for k in block.docs], np.int64)
        d = Digests(block, least, bits)
        keys, values = [], []
        here = np.array([t[_BLK][0].as_py()], np.int32)
        for b in np.flatnonzero(np.diff(d.edges)).tolist():
            x, y = d.edges[b], d.edges[b + 1]
            f = d.first[x:y]
            keys.append(b)
            values.append(blobs.pack(here, d.hi[f], d.lo[f], (d.count[x:y] > 1).astype(np.uint8), ids[d.doc[f]], d.doc[f], d.start[f], rising=(1,)))
        return _rows(keys, values, "bucket")

    return run


def _answer(t: pa.Table) -> pa.Table:
    """(2) To each block of a bucket: entries (bucket, ordinal) that repeat, and where the kept occurrence stands."""
    bucket = t["bucket"][0].as_py()
    parts = [blobs.unpack(v) for v in t["blob"].to_pylist()]
    size = [len(p[1]) for p in parts]
    blk = np.repeat([int(p[0][0]) for p in parts], size)
    nth = np.concatenate([np.arange(n) for n in size])
    hi, lo, many, ids, doc, start = (np.concatenate([p[k] for p in parts]) for k in range(1, 7))
    order = np.lexsort((start, doc, blk, ids, lo, hi))
    new = np.ones(len(hi), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(hi)), 0))]
    # Entries that stand behind another, and first ones that occur again in their own block.
    asked = (order != first) | (many[order] > 0)
    me, kept = order[asked], first[asked]
    by = np.lexsort((nth[me], blk[me]))
    me, kept = me[by], kept[by]
    at = np.r_[0, np.flatnonzero(np.diff(blk[me])) + 1, len(me)] if len(me) else np.array([0])
    keys, values = [], []
    for x, y in zip(at, at[1:], strict=False):
        k = kept[x:y]
        keys.append(int(blk[me[x]]))
        values.append(blobs.pack(np.array([bucket], np.int32), nth[me[x:y]].astype(np.uint32), ids[k], blk[k].astype(np.int32), doc[k], start[k], rising=(1,)))
    return _rows(keys, values)


def _ask(unit: str, least: int, bits: int):
    """(3) A block's removed runs: to itself, and to the kept occurrences' blocks what it must know of their neighbours."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(t) or not len(answers):
            return _rows([], [])
        me = t[_BLK][0].as_py()
        block = Block(t, unit)
        d = Digests(block, least, bits)
        group, kept_id, kept_blk, kept_doc, kept_start = [], [], [], [], []
        for v in answers["blob"].to_pylist():
            b, nth, ids, blk, doc, start = blobs.unpack(v)
            group.append(d.edges[b[0]] + nth.astype(np.int64))
            for into, x in ((kept_id, ids), (kept_blk, blk), (kept_doc, doc), (kept_start, start)):
                into.append(x)
        found = np.full(len(d.first), -1, np.int64)
        group = np.concatenate(group)
        found[group] = np.arange(len(group))
        kept_id, kept_blk, kept_doc, kept_start = (np.concatenate(x) for x in (kept_id, kept_blk, kept_doc, kept_start))
        at = found[d.group]
        hit = np.flatnonzero(at >= 0)
        at = at[hit]
        own = (kept_blk[at] == me) & (kept_doc[at] == d.doc[hit]) & (kept_start[at] == d.start[hit])
        hit, at = hit[~own], at[~own]
        a, z, doc = d.start[hit].astype(np.int64), d.end[hit].astype(np.int64), d.doc[hit].astype(np.int64)
        shift = a - kept_start[at]
        order = np.lexsort((a, shift, kept_doc[at], kept_blk[at], doc))
        a, z, doc, shift, at = a[order], z[order], doc[order], shift[order], at[order]
        runs: list[list[int]] = []  # doc, first word, end, kept doc_id, block, doc, shift
        for i, x, y, s, k in zip(doc.tolist(), a.tolist(), z.tolist(), shift.tolist(), at.tolist(), strict=True):
            last = runs[-1] if runs else None
            if last and last[0] == i and last[6] == s and last[4] == kept_blk[k] and last[5] == kept_doc[k] and x <= last[2]:
                last[2] = max(last[2], y)
            else:
                runs.append([i, x, y, int(kept_id[k]), int(kept_blk[k]), int(kept_doc[k]), s])
        if not runs:
            return _rows([], [])
        r = np.array(runs, np.int64)
        size = {i: len(block.words(i).hash) for i in np.unique(r[:, 0]).tolist()}
        inner = np.array([unit == "sentence" and (x[1] > 0 or x[2] < size[x[0]]) for x in runs])
        # One question for all runs of this block with the same kept words.
        asked = np.column_stack([r[:, 4], r[:, 5], r[:, 1] - r[:, 6], r[:, 2] - r[:, 6]])
        asked[~inner] = -1
        unique, which = np.unique(asked, axis=0, return_inverse=True)
        keys, values = [me], [blobs.pack(np.array([-1], np.int32), *[r[:, k] for k in range(4)], which.reshape(-1).astype(np.uint32))]
        for b in np.unique(unique[:, 0]).tolist():
            if b >= 0:
                k = np.flatnonzero(unique[:, 0] == b)
                keys.append(b)
                values.append(blobs.pack(np.array([me], np.int32), k.astype(np.uint32), *[unique[k, c] for c in (1, 2, 3)]))
        return _rows(keys, values)

    return run


def _tell(unit: str, least: int):
    """(4) Words around kept occurrences, to the blocks that asked; a block's own runs go on to itself."""

    def run(t: pa.Table, questions: pa.Table) -> pa.Table:
        if not len(t) or not len(questions):
            return _rows([], [])
        me, block = t[_BLK][0].as_py(), Block(t, unit)
        keys, values, wanted = [], [], []
        for v in questions["blob"].to_pylist():
            q = blobs.unpack(v)
            if q[0][0] < 0:
                keys.append(me)
                values.append(v)
            else:
                wanted.append(q)
        by_doc: dict[int, list[tuple[int, int]]] = {}
        for n, q in enumerate(wanted):
            for k, i in enumerate(q[2].tolist()):
                by_doc.setdefault(i, []).append((n, k))
        said: list[list] = [[None] * len(q[1]) for q in wanted]
        for i, places in by_doc.items():
            w = block.words(i)
            for n, k in places:
                said[n][k] = w.around(int(wanted[n][3][k]), int(wanted[n][4][k]), least)
        for q, s in zip(wanted, said, strict=True):
            flat = [x for pair in s for x in pair]
            keys.append(int(q[0][0]))
            values.append(blobs.pack(np.array([me], np.int32), q[1], np.array([len(x) for x in flat], np.uint32), np.concatenate(flat)))
        return _rows(keys, values)

    return run


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _cut(unit: str, columns: list[str]):
    """(5) Rows with their texts cut and the removed spans."""

    def run(t: pa.Table, messages: pa.Table) -> pa.Table:
        block = Block(t, unit)
        runs, around = None, {}
        for v in messages["blob"].to_pylist():
            m = blobs.unpack(v)
            if m[0][0] < 0:
                runs = m[1:]
                continue
            ends = np.cumsum(m[2].astype(np.int64))
            for k, q in enumerate(m[1].tolist()):
                x, y, z = (int(ends[2 * k - 1]) if k else 0), int(ends[2 * k]), int(ends[2 * k + 1])
                around[q] = (m[3][x:y], m[3][y:z])
        gone: dict[int, list[tuple[int, int, int]]] = {}
        if runs is not None:
            for i, a, z, kept, q in zip(*[x.tolist() for x in runs], strict=True):
                gone.setdefault(i, []).append((a, z, kept, q))
        text, spans = {}, {}
        for i, found in gone.items():
            w = block.words(i)
            grown = []
            for a, z, kept, q in found:
                if q in around:
                    before, after = around[q]
                    a, z = a - _alike(w.hash[:a][::-1][: len(before)], before), z + _alike(w.hash[z : z + len(after)], after)
                grown.append((a, z, kept))
            merged: list[list[int]] = []
            for a, z, kept in sorted(grown):
                if merged and a <= merged[-1][1]:
                    merged[-1][1], merged[-1][2] = max(z, merged[-1][1]), min(kept, merged[-1][2])
                else:
                    merged.append([a, z, kept])
            raw = w.bytes.tobytes()
            char = np.cumsum(np.r_[0, (w.bytes & 0xC0) != 0x80])
            left, out, mine = 0, [], []
            for a, z, kept in merged:
                x, y = w.span(a, z)
                x = max(x, left)
                out.append(raw[left:x])
                left = y
                mine.append({"start": int(char[x]), "end": int(char[y]), "n_words": z - a, "kept_doc_id": None if kept == NO_ID else kept})
            out.append(raw[left:])
            text[i], spans[i] = b"".join(out).decode("utf-8", "surrogatepass"), mine
        old = t["text"].to_pylist()
        new = [text.get(i, o) for i, o in zip(block.of_row, old, strict=True)]
        cols = [pa.array(new, pa.string()) if c == "text" else t[c] for c in columns]
        return pa.Table.from_arrays([*cols, pa.array([spans.get(i, []) for i in block.of_row], _SPANS_PA)], [*columns, REMOVED])

    return run


def dedup(docs: DataFrame, unit: str = "sentence", min_words: int | None = None) -> DataFrame:
    """Every row with its text cut, and ``__pagemill_removed``: start, end, n_words and kept_doc_id of each removed span.

    ``min_words`` is 1 for lines and paragraphs, ``MIN_WORDS`` for sentences.
    """
    if unit not in ("line", "paragraph", "sentence"):
        raise ValueError(f"unknown unit {unit!r}")
    min_words = min_words or (MIN_WORDS if unit == "sentence" else 1)
    n = blobs.bucket_count(docs, BLOCK_BYTES, LEAST_BLOCKS)
    bits = max(LEAST_BLOCKS, n // 4).bit_length() - 1
    ids = F.col("doc_id").cast("long")
    dealt = docs.withColumn(_BLK, F.pmod(F.xxhash64(ids, F.col("text")), F.lit(n)).cast("int"))
    by = lambda df, key=_BLK: df.groupBy(key)
    entries = by(dealt).applyInArrow(_send(unit, min_words, bits), "bucket int, blob binary")
    answers = by(entries, "bucket").applyInArrow(_answer, _MESSAGE)
    questions = by(dealt).cogroup(by(answers)).applyInArrow(_ask(unit, min_words, bits), _MESSAGE)
    around = by(dealt).cogroup(by(questions)).applyInArrow(_tell(unit, min_words), _MESSAGE)
    schema = T.StructType([*docs.schema.fields, T.StructField(REMOVED, _SPANS)])
    return by(dealt).cogroup(by(around)).applyInArrow(_cut(unit, docs.columns), schema)


def repeats(docs: DataFrame, unit: str = "sentence", min_words: int | None = None) -> DataFrame:
    """One row per removed span: doc_id, start, end, n_words and kept_doc_id."""
    return dedup(docs.select("doc_id", "text"), unit, min_words).select("doc_id", F.inline(REMOVED))


def clean(docs: DataFrame, unit: str = "sentence", min_words: int | None = None) -> DataFrame:
    """Every document, its removed spans cut out; adds nothing to the columns, n_chars is counted anew."""
    out = dedup(docs, unit, min_words).drop(REMOVED)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


#: The same for op6's columns; texts as lists of words, growth by comparing lists.
ORACLE = r"""
with w as (select doc_id, text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') as ws, string_split_regex(coalesce(text, ''), '[^ \t-\r]+') as gaps from documents),
t as (select doc_id, text, len(ws) as n, list_transform(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as ws, gaps,
    list_transform(ws, lambda x: length(x)) as wl, list_transform(gaps, lambda x: length(x)) as gl,
    list_filter(range(1, len(ws) + 1), lambda i: i = len(ws) or contains(gaps[i + 1], chr(10)) or contains('.!?,;:。！？，、；：…', ws[i][-1:])) as cuts from w where len(ws) > 0),
o as (select *, list_transform(range(0, n), lambda i: list_sum(gl[1:i + 1]) + coalesce(list_sum(wl[1:i]), 0)) as ss from t),
p as (select doc_id, ws, cuts, unnest(list_concat([0], cuts[1:-2])) as a from t),
r as (select doc_id, a, z, array_to_string(ws[a + 1:z], ' ') as norm from (select *, case when len(ws) < 10 then case when a = 0 then len(ws) end else list_filter(cuts, lambda c: c >= a + 10)[1] end as z from p)),
f as (select *, first_value(doc_id) over v as kd, first_value(a) over v as ka from r where z is not null window v as (partition by norm order by doc_id, a)),
h as (select doc_id, kd, a - ka as s, a, z, max(z) over (partition by doc_id, kd, a - ka order by a rows between unbounded preceding and 1 preceding) as upto from f where doc_id <> kd or a <> ka),
i as (select *, sum((upto is null or a > upto)::int) over (partition by doc_id, kd, s order by a) as g from h),
u as (select doc_id, kd, s, min(a) as a, max(z) as z from i group by doc_id, kd, s, g),
e as (select u.doc_id, u.kd, u.a, u.z, d.n,
    least(u.a, u.a - u.s - coalesce(list_max(list_filter(k.cuts, lambda c: c < u.a - u.s)), 0)) as back,
    least(d.n - u.z, coalesce(list_filter(k.cuts, lambda c: c >= u.z - u.s + 10)[1], k.n) - u.z + u.s) as fore, u.s, d.ws as dw, k.ws as kw
  from u join t d on d.doc_id = u.doc_id join t k on k.doc_id = u.kd),
x as (select doc_id, a - coalesce(list_position(list_transform(range(1, back + 1), lambda j: dw[a - j + 1] = kw[a - s - j + 1]), false) - 1, back) as a,
    z + coalesce(list_position(list_transform(range(1, fore + 1), lambda j: dw[z + j] = kw[z - s + j]), false) - 1, fore) as z from e),
y as (select *, max(z) over (partition by doc_id order by a, z rows between unbounded preceding and 1 preceding) as upto from x),
m as (select doc_id, min(a) as a, max(z) as z from (select *, sum((upto is null or a > upto)::int) over (partition by doc_id order by a, z) as g from y) group by doc_id, g),
c as (select m.doc_id, z - a as words, case when (z = n or contains(gaps[z + 1], chr(10))) and a > 0 then ss[a] + wl[a] else ss[a + 1] end as x,
    case when (z = n or contains(gaps[z + 1], chr(10))) and a > 0 or z = n then ss[z] + wl[z] else ss[z + 1] end as y from m join o on o.doc_id = m.doc_id),
b as (select *, greatest(x, coalesce(lag(y) over (partition by doc_id order by x), 0)) as lo, coalesce(lag(y) over (partition by doc_id order by x), 0) as left_end from c),
g as (select doc_id, sum(words) as words, string_agg(lo || '-' || y, ' ' order by lo) as spans, max(y) as last, list((left_end, lo) order by lo) as kept from b group by doc_id)
select d.doc_id, case when g.doc_id is null then d.text else array_to_string(list_transform(kept, lambda q: substring(d.text, (q[1] + 1)::int, (q[2] - q[1])::int)), '') || substring(d.text, (last + 1)::int) end as text,
  coalesce(words, 0)::bigint as removed_words, coalesce(spans, '') as removed_spans from documents d left join g on g.doc_id = d.doc_id
"""
