"""Token counts of a word-ending BPE by heap-and-linked-list merging.

A piece starts as a doubly linked list of symbols; a heap holds its adjacent
pairs by (merge rank, position); the lowest is popped, merged and its two new
neighbours pushed, until no pair has a rank.  The count is the initial symbols
minus the merges; no identifier is made.

The vocabulary file is read by the driver and sent as one broadcast value of
fixed size.  Counts of white-space words are remembered per Python worker up to
``MEMO`` words, then forgotten, so memory stays bounded on any corpus.

Defined results: null and empty texts have 0 tokens and 0 bytes; texts are
counted whole, whatever their length; repeated rows each get a row, rows with a null
doc_id or equal ones too; of pairs of equal rank the leftmost merges first; an empty
table gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO = 400_000
#: Unicode White_Space; Python's str.split() also splits at U+001C..U+001F.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
ODD = "\x1c\x1d\x1e\x1f"
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


def load_spec(path: str) -> dict:
    """What counting needs of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    m = t["model"]
    pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
    return {
        "ranks": {p: i for i, p in enumerate(pairs)},
        "vocab": frozenset(m["vocab"]),
        "suffix": m["end_of_word_suffix"] or "",
        "special": [a["content"] for a in t["added_tokens"]],
    }


def merge_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Tokens left of ``symbols`` after all merges."""
    n = len(symbols)
    if n < 2:
        return n
    sym: list[str | None] = list(symbols)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i = heapq.heappop(heap)
        left, j = sym[i], after[i]
        if left is None or j < 0 or ranks.get((left, sym[j])) != rank:
            continue  # one side has been merged since the pair was pushed
        sym[i], sym[j] = left + sym[j], None
        merges += 1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (r := ranks.get((sym[i], sym[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (p := before[i]) >= 0 and (r := ranks.get((sym[p], sym[i]))) is not None:
            heapq.heappush(heap, (r, p))
    return n - merges


class Counter(dict):
    """White-space word -> tokens; misses are counted and kept."""

    def __init__(self, spec: dict):
        import regex

        self.ranks, self.vocab, self.suffix = spec["ranks"], spec["vocab"], spec["suffix"]
        self.find = regex.compile(PIECE).findall
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(spec["special"], key=len, reverse=True))) + ")") if spec["special"] else None
        self.chars = byte_chars()
        self.pieces: dict[str, int] = {}

    def piece(self, p: str) -> int:
        n = self.pieces.get(p)
        if n is None:
            s = [self.chars[b] for b in p.encode()]
            s[-1] += self.suffix
            n = self.pieces[p] = merge_count([x for x in s if x in self.vocab], self.ranks)
        return n

    def plain(self, word: str) -> int:
        # Character by character: no rule for a final sigma.
        low = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()
        return sum(map(self.piece, self.find(low)))

    def __missing__(self, word: str) -> int:
        if self.special is not None and self.special.search(word):
            n = sum(self.plain(x) if i % 2 == 0 else 1 for i, x in enumerate(self.special.split(word)))
        else:
            n = self.plain(word)
        self[word] = n
        return n

    def text(self, t: str) -> int:
        """Tokens of a whole text; no piece spans white space, so words count alone."""
        ws = re.split(f"[{WHITE}]+", t) if any(c in t for c in ODD) else t.split()
        n = sum(map(self.__getitem__, ws))
        if len(self) > MEMO:
            self.clear()
            self.pieces.clear()
        return n


_counters: dict[str, Counter] = {}


def count(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row."""
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(load_spec(vocabulary))
    out = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    schema = docs.select("doc_id").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(vocabulary)
        if counter is None:
            counter = _counters[vocabulary] = Counter(spec.value)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            cols = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([counter.text(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *out.names])

    fields = schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    done = docs.select("doc_id", "text").mapInArrow(run, f"{fields}, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
