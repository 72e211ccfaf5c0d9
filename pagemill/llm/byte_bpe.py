"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of the whole corpus are dealt over buckets by hash.  In a bucket
an inverted index maps each mergeable token pair (by its rank) to the positions in
the words' pieces where it stands; ranks are replayed in ascending order, each over
all its positions at once, and only the touched neighbours enter the index anew.
So a word is merged once, however many texts it is in.

Texts are packed in blocks of some MB: which words each has, by their place in the
block's own list of distinct words.  A block sends every bucket its words of that
bucket once, gets their identifiers back and puts its texts together by array
look-ups; decoding looks up the identifiers' bytes in the same way.  Blocks,
messages and buckets are bounded (``BLOCK_CHARS``, ``BUCKET_BYTES``); a word in a
third of all texts costs its bucket one entry per block.

Words are cut at blanks and line feeds where the pattern is ``SPACED`` and the text
has no other white space; any other text is cut by the pattern itself, and its
pieces are the words.

Blocks are told by task and number.  Should a lost executor's task run again on rows in
another order (input that comes out of a shuffle, not out of files), its answers no
longer fit and the job fails with that message; nothing wrong is returned.

Defined results: null and empty texts encode to no identifiers (the digests are
those of zero bytes); repeated rows and null doc_ids each get a row; very long texts
are encoded whole, in a block of their own size; an empty table gives none; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs

#: Fixed value: the public split pattern that never joins words over a single blank or line feed.
SPACED = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space other than the blank and the line feed.
OTHER_WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLOCK_CHARS, BUCKET_BYTES, LEAST_BUCKETS, SLICE_BYTES = 8_000_000, 32_000_000, 64, 4_000_000
#: Kinds of words: after a blank (or with its own line feed), as it stands, a piece of the pattern.
AFTER_BLANK, AS_IS, PIECE = 0, 1, 2


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merge_alone(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """One piece by its definition: merge the leftmost pair of lowest rank until none is left."""
    parts = [bytes([b]) for b in piece]
    while len(parts) > 1:
        best = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
        if best[0] == 1 << 60:
            break
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Replay:
    """Merges of one vocabulary, replayed over a corpus of distinct pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, r in ranks.items():
            self.bytes_of[r] = token
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """Rank of the token that a pair merges to, or -1."""
        r = self.pair_rank.get((a, b))
        if r is None:
            if len(self.pair_rank) > 1_000_000:
                self.pair_rank.clear()
            r = self.pair_rank[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Identifiers of every piece."""
        rank, single, whole = self.rank, self.single, self.ranks
        out: list[list[int] | None] = [[whole[p]] if p in whole else None for p in pieces]
        todo = [i for i, x in enumerate(out) if x is None]
        sym: list[int] = []
        starts: list[int] = []
        for i in todo:
            starts.append(len(sym))
            sym.extend(map(single.__getitem__, pieces[i]))
            sym.append(-1)  # a piece's end: no pair crosses it
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        for p in range(n - 1):
            a, b = sym[p], sym[p + 1]
            if a >= 0 and b >= 0 and (r := rank(a, b)) >= 0:
                index.setdefault(r, []).append(p)
        heap = list(index)
        heapq.heapify(heap)
        again: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            for p in sorted(index.pop(r, ())):
                a = sym[p]
                if a < 0:
                    continue
                q = after[p]
                b = sym[q]
                if b < 0 or rank(a, b) != r:
                    continue  # merged away, or its neighbour changed
                sym[p], sym[q] = r, -2
                k = after[p] = after[q]
                before[k] = p
                for left, right in ((before[p], p), (p, k)):
                    if left >= 0 and sym[left] >= 0 and sym[right] >= 0 and (s := rank(sym[left], sym[right])) >= 0:
                        if s < r:  # a lower rank than the one being replayed: this piece is done alone
                            again.add(p)
                        if s in index:
                            index[s].append(left)
                        else:
                            index[s] = [left]
                            heapq.heappush(heap, s)
        redo = set(np.searchsorted(starts, sorted(again), "right") - 1) if again else ()
        for j, i in enumerate(todo):
            if j in redo:
                out[i] = _merge_alone(pieces[i], whole)
                continue
            p, ids = starts[j], []
            while sym[p] != -1:
                ids.append(sym[p])
                p = after[p]
            out[i] = ids
        return out


class Vocabulary:
    """One rank file in a Python worker: replay, and the bytes of all tokens as one array."""

    def __init__(self, ranks: dict[bytes, int]):
        self.replay = Replay(ranks)
        table = self.replay.bytes_of
        self.size = np.array([len(x) for x in table], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all identifiers, and how many each has."""
        return gather(self.flat, self.at[ids], self.size[ids]), self.size[ids]


_known: dict[str, Vocabulary] = {}


def _vocabulary(path: str, ranks) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(ranks.value)
    return _known[path]


def gather(flat: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs [at, at + size) of ``flat``, one after another."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(at - (ends - size), size)]


def cut(text: str, find, spaced: bool) -> list:
    """A text's words as keys: str (``AFTER_BLANK``), (str,) (``AS_IS``) or (str, 1) (``PIECE``)."""
    if not text:
        return []
    if not spaced or text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER_WHITE):
        return [(p, 1) for p in find(text)]
    words = text.replace("\n", " \n").split(" ")
    words[0] = (words[0],)
    return words


def _mark(raw: list[bytes]) -> np.ndarray:
    """What a block's list of words is known by: a task that runs again on rows in another order makes another list."""
    return np.array([xxhash.xxh3_64_intdigest(b"\0".join(raw)) & (2**63 - 1)], np.int64)


def _pack_words(uid: int, keys: list, bits: int, raw: list[bytes], mark: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block's distinct words by bucket: who asks and its mark, places in the block's list, kinds, lengths and bytes."""
    kind = np.array([AFTER_BLANK if isinstance(k, str) else AS_IS if len(k) == 1 else PIECE for k in keys], np.uint8)
    bucket = (blobs.mix(blobs.hash_words(raw) + kind) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.r_[np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
    for x, y in zip(at, at[1:], strict=False):
        mine = order[x:y]
        values = [raw[i] for i in mine.tolist()]
        yield int(bucket[mine[0]]), blobs.pack(np.r_[np.int64(uid), mark], mine.astype(np.uint32), kind[mine], np.array([len(v) for v in values], np.uint32), np.frombuffer(b"".join(values), np.uint8), rising=(1,))


def _blocks(bits: int, pattern: str):
    """Blocks of texts: a row for the block itself (key below zero) and one for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, spaced = regex.compile(pattern).findall, pattern == SPACED
        uid = TaskContext.get().partitionId() << 32
        ids, sizes, places, held = [], [], [], 0
        words: defaultdict = defaultdict()
        words.default_factory = words.__len__

        def flush() -> pa.RecordBatch:
            known = np.array([0 if i is None else i for i in ids], np.int64)
            none = np.array([i is None for i in ids], np.uint8)
            keys = list(words)
            raw = [(k if isinstance(k, str) else k[0]).encode("utf-8", "surrogatepass") for k in keys]
            mark = _mark(raw)
            rows = [(-1 - uid, blobs.pack(np.r_[mark, np.int64(len(keys))], known, none, np.array(sizes, np.uint32), np.concatenate(places) if places else np.empty(0, np.uint32)))]
            rows += _pack_words(uid, keys, bits, raw, mark)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.binary())], ["key", "blob"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = cut(text, find, spaced)
                ids.append(i)
                sizes.append(len(found))
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                held += len(text or "") + 16
                if held > BLOCK_CHARS:
                    yield flush()
                    uid += 1
                    ids, sizes, places, held = [], [], [], 0
                    words.clear()
        if ids:
            yield flush()

    return run


def _replay(path: str, ranks, pattern: str):
    """A bucket's words replayed, the answers to the blocks that asked."""

    def run(t: pa.Table) -> pa.Table:
        import regex

        key = t["key"][0].as_py()
        if key < 0:  # a block
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary())], ["key", "blob"])
        vocabulary, find = _vocabulary(path, ranks), regex.compile(pattern).findall
        asked, words = [], {}
        for v in t["blob"].to_pylist():
            uid, place, kind, size, raw = blobs.unpack(v)
            ends, raw = np.cumsum(size.astype(np.int64)).tolist(), raw.tobytes()
            keys = [(k, raw[x:y]) for k, x, y in zip(kind.tolist(), [0, *ends], ends, strict=False)]
            asked.append((uid, place, keys))
            words.update(dict.fromkeys(keys))
        pieces: dict[bytes, bytes] = {}
        cuts = {}
        for k, raw in words:
            text = raw.decode("utf-8", "surrogatepass")
            if k == AFTER_BLANK and text[:1] != "\n":
                text = " " + text
            cuts[k, raw] = found = [p.encode("utf-8", "surrogatepass") for p in ([text] if k == PIECE else find(text))]
            pieces.update(dict.fromkeys(found, b""))
        part, held = [], 0
        todo = list(pieces)
        for n, p in enumerate(todo):
            part.append(p)
            held += len(p)
            if held > SLICE_BYTES or n == len(todo) - 1:
                for q, ids in zip(part, vocabulary.replay.encode(part), strict=True):
                    pieces[q] = np.array(ids, "<u4").tobytes()
                part, held = [], 0
        for k, found in cuts.items():
            words[k] = b"".join(pieces[p] for p in found)
        uids, values = [], []
        for uid, place, keys in asked:
            ids = [words[k] for k in keys]
            uids.append(-1 - int(uid[0]))
            values.append(blobs.pack(uid[1:], place, np.array([len(x) // 4 for x in ids], np.uint32), np.frombuffer(b"".join(ids), "<u4"), rising=(1,)))
        return pa.Table.from_arrays([pa.array(uids, pa.int64()), pa.array(values, pa.binary())], ["key", "blob"])

    return run


def _assemble(path: str, ranks, keep_ids: bool):
    """A block's texts from its words' identifiers."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        vocabulary = _vocabulary(path, ranks)
        none, doc_id, n_words, words = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.uint32)
        known = np.zeros(2, np.int64)
        if len(block) and block["key"][0].as_py() < 0:
            known, doc_id, none, n_words, words = blobs.unpack(block["blob"][0].as_py())
        place, size, flat = [np.empty(0, np.uint32)], [np.empty(0, np.uint32)], [np.empty(0, np.uint32)]
        for v in answers["blob"].to_pylist():
            mark, *cols = blobs.unpack(v)
            if mark[0] != known[0]:
                raise RuntimeError("a block was made anew from rows in another order; store the input before encoding it")
            for into, x in zip((place, size, flat), cols, strict=True):
                into.append(x)
        place, size, flat = np.concatenate(place), np.concatenate(size).astype(np.int64), np.concatenate(flat)
        if len(place) != known[1]:
            raise RuntimeError("words of a block were not answered; store the input before encoding it")
        start = np.cumsum(size) - size
        length, at = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        length[place], at[place] = size, start
        ends = np.r_[0, np.cumsum(n_words.astype(np.int64))]
        counts, encoded, decoded, kept = [], [], [], []
        i = 0
        while i < len(doc_id):
            # Texts of about a quarter million words at a time.
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + 250_000, "right")) - 1)
            w = words[ends[i] : ends[j]]
            ids = gather(flat, at[w], length[w])
            data, width = vocabulary.decode(ids)
            id_ends = np.r_[0, np.cumsum(length[w])][ends[i : j + 1] - ends[i]]
            byte_ends = np.r_[0, np.cumsum(width)][id_ends]
            raw, text = ids.astype("<u4").tobytes(), data.tobytes()
            for a, z, x, y in zip(id_ends.tolist(), id_ends[1:].tolist(), byte_ends.tolist(), byte_ends[1:].tolist(), strict=False):
                counts.append(z - a)
                encoded.append(hashlib.sha256(raw[4 * a : 4 * z]).hexdigest())
                decoded.append(hashlib.sha256(text[x:y]).hexdigest())
                if keep_ids:
                    kept.append(ids[a:z].astype(np.int32))
            i = j
        cols = {"doc_id": pa.array(doc_id, pa.int64(), mask=none == 1), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(encoded, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
        if keep_ids:
            cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
        return pa.table(cols)

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with ``keep_ids`` also ids (array<int>)."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    bits = blobs.bucket_count(docs, BUCKET_BYTES, LEAST_BUCKETS).bit_length() - 1
    # Blocks and questions are dealt by key once; both steps read the same exchange.
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_blocks(bits, pattern), "key long, blob binary").groupBy("key")
    answers = packed.applyInArrow(_replay(ranks_path, ranks, pattern), "key long, blob binary").groupBy("key")
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return packed.cogroup(answers).applyInArrow(_assemble(ranks_path, ranks, keep_ids), schema)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null: none); bytes that are not UTF-8 become U+FFFD."""
    ranks = encoded.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks_path, ranks)
        for b in batches:
            texts = [vocabulary.decode(np.array(x or [], np.int64))[0].tobytes().decode("utf-8", "replace") for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")
