"""Hierarchical Pitman-Yor language model, its seating sampled by Gibbs.

Three levels of Chinese restaurants share parents: the context of the last two words
sits under that of the last word, all of these under one unigram restaurant, that one
under the uniform law over the training words and one unseen word.  Contexts are the
real ones (64-bit hashes), so they grow with the corpus.

Tokens are dealt once by the last word before them, so a context, its children and
their seating are in one task (a shard of about ``SHARD_BYTES`` of text).  A last word
with more than half a shard's tokens is dealt by the word before it, a pair of words
with so many by document; restaurants that so lie over several shards are seated one
level up, by dish.  Every round

1. shards seat their restaurants given the parents' law and send each dish's tables
   to the dish's bucket, added up (a message per shard and bucket),
2. buckets seat the unigram restaurant and the split ones, whose customers are those
   tables, dish by dish, and send back what a dish has there,
3. totals of customers and tables over all buckets go to every shard.

In the first round the parents' law is the shard's own word frequencies.  After
``ROUNDS`` rounds shards seat anew under the law that came back and average the
predictive probabilities of ``SAMPLES`` states.  One round is enough: on 2,500 texts
held-out tokens have mean log10 probability -3.6893, -3.6890 and -3.6889 after one,
two and three rounds (8 shards; draws alone differ by 0.0004).  Words sent, buckets and
shards follow the corpus.  How many there are enters the first law and the scaling of a
bucket's own tables to all; its effect is within the draws' up to 64 shards.

Gibbs: given its parent's predictive law, the table count of each dish in each
restaurant is drawn from its conditional (generalised Stirling numbers); a dish of
more than ``EXACT`` customers is reseated in batches of 1/32 of those seated.  All
dishes of a level are drawn at once, given the others' tables before.  Discounts are
n1 / (n1 + 2 n2) of a level's customers, over all shards.  Seeds depend on round and
shard alone and types are sorted before, so reruns of lost tasks agree.

Documents are told by task and number.  Should a lost executor's task run again on rows
in another order (input that comes out of a shuffle, not out of files), a document's
token count or the 16-bit check sum of its tokens no longer fits and the job fails with
that message.

The ``COMMON`` most frequent words travel as 16-bit codes, all others as 48-bit hashes;
this table and the split contexts (at most a few per shard) are all that is broadcast.

Defined results: a null or empty text is its end token alone; a null doc_id trains
(its crc32 is null, so it isn't held out); repeated rows are each counted and each
get a row; very long texts are scored whole; an empty table gives none; extra columns
are ignored, whatever their names; without training documents all probabilities come
from the uniform law over one unseen word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blobs
from .common import stored

FLUSH, SHARD_BYTES, LEAST_SHARDS, SHARDS_PER_BUCKET = 1_000_000, 10_000_000, 32, 8
COMMON = 65_535
EXACT, THETA = 64, 1.0
ROUNDS, BURN, SAMPLES = 1, 2, 3
END, BEGIN = np.uint64(0x51ED270B9F3C), (np.uint64(0x2545F4914F6C), np.uint64(0x6C62272E07BB))
NO_ID = np.iinfo(np.int64).max
FIXED = 1 << 26


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """48-bit hashes of all tokens, of the last word before each and of the one before that; each text's number of tokens."""
    each = [blobs.words(t) for t in texts]
    sizes = np.array([len(w) + 1 for w in each], np.int64)
    w = np.full(int(sizes.sum()), END, np.uint64)
    inner = np.ones(len(w), bool)
    ends = np.cumsum(sizes) - 1
    inner[ends] = False
    w[inner] = blobs.hash_words([x for ws in each for x in ws]) >> np.uint64(16)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    u1, u2 = np.roll(w, 1), np.roll(w, 2)
    u1[starts], u2[starts] = BEGIN
    u2[starts[sizes > 1] + 1] = BEGIN[0]
    return w, u1, u2, sizes


def _checks(w: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """16 bits of every token and the two before it; their sum tells texts apart."""
    return (w * np.uint64(0x9E3779B97F4A7C15) + u1 * np.uint64(0xC2B2AE3D27D4EB4F) + u2 * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)


def _flushes(batches: Iterator[pa.RecordBatch]):
    """Runs of rows with about ``FLUSH`` tokens: ids and texts."""
    ids, texts, held = [], [], 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or "") + 6
            if held > 6 * FLUSH:
                yield ids, texts
                ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def _runs(sorted_: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, np.int64)


def pair_key(u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """64-bit hash of the two words before a token."""
    return blobs.mix(u1 * np.uint64(0x9E3779B97F4A7C15) + u2 * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))


def doc_bucket(uid: np.ndarray, bits: int) -> np.ndarray:
    return (blobs.mix(uid.astype(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def frequent(docs: DataFrame, shards: int) -> DataFrame:
    """(kind, key, parent, n): training and all tokens (0), words (1), last words (2) and pairs (3) that are frequent somewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in _flushes(batches):
            w, u1, u2, sizes = _tokens(texts)
            train = np.repeat([not held_out(i) for i in ids], sizes)
            kind, key, parent, count = [0, 0], [0, 1], [0, 0], [int(train.sum()), len(w)]
            least = max(2, len(w) / (4 * shards))

            def add(k, v, of, n, big):
                kind.extend([k] * int(big.sum()))
                key.extend(v[big].view(np.int64).tolist())
                parent.extend(of[big].view(np.int64).tolist())
                count.extend(n[big].tolist())

            v, n = np.unique(w, return_counts=True)
            add(1, v, np.zeros_like(v), n, n >= min(least, max(2, len(w) >> 17)))
            # A word stands before as many tokens as it is one; only pairs below a frequent one can be so.
            v, n = np.append(v, BEGIN[0]), np.append(n, len(ids))
            hot = (n >= least) & (v != END)
            add(2, v, np.zeros_like(v), n, hot)
            below = np.isin(u1, v[hot])
            v, first, n = np.unique(pair_key(u1[below], u2[below]), return_index=True, return_counts=True)
            add(3, v, u1[below][first], n, n >= least)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(parent, pa.int64()), pa.array(count, pa.int64())], ["kind", "key", "parent", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "kind int, key long, parent long, n long").groupBy("kind", "key", "parent").agg(F.sum("n").alias("n"))


class Plan:
    """What every task knows: shards, split contexts, codes of frequent words."""

    def __init__(self, rows: list, shards: int):
        """``rows``: kind, key, parent and n as ``frequent`` gives them, words in order of frequency."""
        total = {r[1]: r[3] for r in rows if r[0] == 0}
        self.n, tokens = total.get(0, 0), total.get(1, 0)
        self.shards = shards
        self.buckets = max(1, shards // SHARDS_PER_BUCKET)
        self.common = np.array([r[1] for r in rows if r[0] == 1][:COMMON], np.int64).view(np.uint64)
        self.slots: tuple[np.ndarray, np.ndarray] | None = None
        least = max(2, tokens / (2 * shards))
        split = lambda kind: sorted((r[1] & (2**64 - 1), r[2] & (2**64 - 1), r[3]) for r in rows if r[0] == kind and r[3] >= least)
        words, pairs = split(2), split(3)
        #: Split contexts are numbered from 1, last words first; 0 is the unigram restaurant.
        self.n_words = len(words)
        self.words, self.pairs = (np.array([x[0] for x in y], np.uint64) for y in (words, pairs))
        self.parent = np.r_[np.zeros(1 + len(words), np.int64), 1 + np.searchsorted(self.words, np.array([x[1] for x in pairs], np.uint64))]
        self.parts = np.array([max(2, -(-2 * x[2] * shards // max(1, tokens))) for x in words + pairs], np.int64)
        self.first = shards + np.cumsum(np.r_[0, self.parts])
        self.all_shards = int(self.first[-1])

    def context(self, shard: int) -> int:
        """The split context that a shard belongs to, or 0."""
        return int(np.searchsorted(self.first[:-1], shard, "right"))

    def route(self, u1: np.ndarray, u2: np.ndarray, uid: np.ndarray) -> np.ndarray:
        """The shard of every token."""
        g = (blobs.mix(u1) % np.uint64(self.shards)).astype(np.int64)
        for keys, of, by, base in ((self.words, u1, u2, 0), (self.pairs, None, uid, self.n_words)):
            if len(keys):
                of = pair_key(u1, u2) if of is None else of
                at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
                hot = np.flatnonzero(keys[at] == of)
                k = at[hot] + base
                g[hot] = self.first[k] + (blobs.mix(by[hot].astype(np.uint64) + np.uint64(99)) % self.parts[k].astype(np.uint64)).astype(np.int64)
        return g

    def bucket(self, w: np.ndarray) -> np.ndarray:
        return (blobs.mix(w + np.uint64(7)) % np.uint64(self.buckets)).astype(np.int64)

    def encode(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """16-bit codes (0: rare) and the hashes of the rare words; of frequent words with one slot the rarer travel as rare."""
        if self.slots is None:
            known, codes = np.zeros(1 << 20, np.uint64), np.zeros(1 << 20, np.uint16)
            slot = (self.common >> np.uint64(28)).astype(np.int64)[::-1]
            known[slot], codes[slot] = self.common[::-1], np.arange(1, len(self.common) + 1, dtype=np.uint16)[::-1]
            self.slots = known, codes
        slot = (w >> np.uint64(28)).astype(np.int64)
        code = np.where(self.slots[0][slot] == w, self.slots[1][slot], np.uint16(0))
        return code, w[code == 0]

    def decode(self, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
        w = np.empty(len(code), np.uint64)
        w[code == 0] = rare
        w[code > 0] = self.common[code[code > 0].astype(np.int64) - 1]
        return w


def _deal(plan, doc_bits: int):
    """All tokens, packed by shard: rows (shard, blob); documents themselves under -1 - their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        context = TaskContext.get()
        uid = (context.partitionId() if context else 0) << 40
        for ids, texts in _flushes(batches):
            w, u1, u2, sizes = _tokens(texts)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint32), sizes)
            check = np.add.reduceat(_checks(w, u1, u2), np.cumsum(sizes) - sizes).astype(np.uint16)
            shard = p.route(u1, u2, owner.astype(np.uint64) + np.uint64(uid))
            order = np.argsort(shard, kind="stable")
            shard, owner = shard[order], owner[order]
            known = np.array([NO_ID if i is None else i for i in ids], np.int64)
            out = np.array([held_out(i) for i in ids], np.uint8)
            cols = [x[order] for x in (w, u1, u2)]
            at = np.r_[_runs(shard), len(shard)]
            own = uid + np.arange(len(ids), dtype=np.int64)
            home = doc_bucket(own, doc_bits)
            keys, values = [], []
            for b in np.unique(home).tolist():
                k = np.flatnonzero(home == b)
                keys.append(-1 - b)
                values.append(blobs.pack(own[k], known[k], out[k], sizes[k].astype(np.uint32), check[k], rising=(0,)))
            for a, b in zip(at, at[1:], strict=False):
                here = np.unique(owner[a:b])
                coded = [x for c in cols for x in p.encode(c[a:b])]
                keys.append(int(shard[a]))
                values.append(blobs.pack(own[here], out[here], np.searchsorted(here, owner[a:b]).astype(np.uint32), *coded, rising=(0, 2)))
            uid += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["shard", "blob"])

    return run


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S_d(c, t), 0 <= t <= c <= most."""
    s = np.full((most + 1, most + 1), -np.inf)
    s[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        with np.errstate(divide="ignore"):
            s[c + 1, 1 : c + 2] = np.logaddexp(s[c, : c + 1], s[c, 1 : c + 2] + np.log(np.maximum(c - t * d, 1e-300)))
    return s


def draw_tables(c: np.ndarray, others: np.ndarray, theta: float, d: float, parent: np.ndarray, table: np.ndarray, rng) -> np.ndarray:
    """Table counts of dishes with ``c`` customers, in restaurants with ``others`` tables of other dishes.

    Exact draws of p(t) ~ prod_{i<t} (theta + d (others + i)) parent^t S_d(c, t).
    """
    t = np.minimum(c, 1)
    many = np.flatnonzero((c > 1) & (c <= EXACT))
    many = many[np.argsort(c[many], kind="stable")]
    at = np.r_[_runs(c[many]), len(many)]
    for a, b in zip(at, at[1:], strict=False):
        n = int(c[many[a]])
        i = np.arange(n)
        step = max(1, 500_000 // n)
        for s in range(a, b, step):
            k = many[s : min(b, s + step)]
            logp = np.cumsum(np.log(theta + d * (others[k, None] + i)), 1) + (i + 1) * np.log(parent[k, None]) + table[n, 1 : n + 1]
            t[k] = 1 + np.argmax(logp + rng.gumbel(size=logp.shape), 1)
    big = np.flatnonzero(c > EXACT)
    if len(big):
        n, seated, tables = c[big], np.ones(len(big), np.int64), np.ones(len(big), np.int64)
        while (open_ := seated < n).any():
            batch = np.where(open_, np.minimum(n - seated, np.maximum(1, seated >> 5)), 0)
            weight = (theta + d * (others[big] + tables)) * parent[big]
            tables += rng.binomial(batch, weight / (seated - d * tables + weight))
            seated += batch
        t[big] = tables
    return t


def discount(n1: float, n2: float) -> float:
    """Of a level with ``n1`` dishes of one customer and ``n2`` of two."""
    return min(0.95, max(0.1, (n1 + 1) / (n1 + 2 * n2 + 2)))


def ones_twos(c: np.ndarray) -> np.ndarray:
    return np.array([(c == 1).sum(), (c == 2).sum()], float)


class Tokens:
    """What a shard was dealt: documents and their tokens, in an order that no shuffle changes."""

    def __init__(self, p: Plan, values: list[bytes]):
        docs, owners, words, base = [], [], [[], [], []], 0
        for uid, held, owner, *coded in sorted((blobs.unpack(v) for v in values), key=lambda x: int(x[0][0])):
            docs.append((uid, held))
            owners.append(owner.astype(np.int64) + base)
            base += len(uid)
            for k in range(3):
                words[k].append(p.decode(coded[2 * k], coded[2 * k + 1]))
        self.uid, held = (np.concatenate(x) for x in zip(*docs, strict=True))
        self.held = held == 1
        self.owner = np.concatenate(owners)
        self.w, self.u1, self.u2 = (np.concatenate(x) for x in words)

    def take(self, name: str, use: np.ndarray | None = None) -> np.ndarray:
        """A column, no longer held here."""
        x = self.__dict__.pop(name)
        return x if use is None or use.all() else x[use]


class Leaf:
    """The types (context of two words, word) of tokens, with their training counts and parents."""

    def __init__(self, columns: list[np.ndarray], train: np.ndarray):
        """``columns``: tokens, the last word before each and the one before that; taken out of the list, for memory."""
        u2, u1 = columns.pop(), columns.pop()
        wi, words = pd.factorize(columns.pop())
        order = np.argsort(words)
        self.words, n = words[order], len(words)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        wi = place[wi]
        ci, contexts = pd.factorize(pair_key(u1, u2))
        first = np.empty(len(contexts), np.int64)
        first[ci[::-1]] = np.arange(len(ci))[::-1]
        u1 = u1[first]
        del u2
        ci *= n
        ci += wi
        del wi
        self.of_token, types = pd.factorize(ci)
        del ci
        self.count = np.bincount(self.of_token, train, len(types)).astype(np.int64)
        self.word, self.context = types % n, types // n
        of_context, parents = pd.factorize(u1)
        self.up, up = pd.factorize(of_context[self.context] * n + self.word)
        self.up_word, self.up_context = up % n, up // n
        self.n_contexts, self.n_parents = len(contexts), len(parents)
        self.trained = np.bincount(self.word, self.count, n).astype(np.int64)

    def seat(self, levels: int, law: np.ndarray, d2: float | None, d1: float | None, burn: int, samples: int, rng) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Customers sent up by word, mean predictive probability of each type, and dishes with one and two customers by level.

        ``law``: per word, the unigram law (``levels`` 2), the law of the only last
        word (1) or of the only pair (0).
        """
        stats = np.zeros(4)
        if levels == 0:
            return self.trained.astype(float), law[self.word], stats
        c2, n2 = self.count, self.n_contexts
        stats[:2] = ones_twos(c2)
        d2 = discount(*stats[:2]) if d2 is None else d2
        s2, total2 = stirling(d2), np.bincount(self.context, c2, n2)
        t2 = np.minimum(c2, 1)
        k1 = len(self.up_word)
        p1 = law[self.up_word]
        if levels == 2:
            c1 = np.bincount(self.up, t2, k1).astype(np.int64)
            t1 = np.minimum(c1, 1)
            d1 = discount(*ones_twos(c1)) if d1 is None else d1
            s1 = stirling(d1)
        mean = np.zeros(len(c2))
        for sweep in range(burn + samples):
            if levels == 2:
                if sweep:
                    c1 = np.bincount(self.up, t2, k1).astype(np.int64)
                    t1 = np.minimum(t1, c1)
                    tables = np.bincount(self.up_context, t1, self.n_parents)
                    t1 = draw_tables(c1, tables[self.up_context] - t1, THETA, d1, law[self.up_word], s1, rng)
                u, k = np.bincount(self.up_context, t1, self.n_parents), np.bincount(self.up_context, c1, self.n_parents)
                p1 = (c1 - d1 * t1 + (THETA + d1 * u[self.up_context]) * law[self.up_word]) / (THETA + k[self.up_context])
            tables = np.bincount(self.context, t2, n2)
            t2 = draw_tables(c2, tables[self.context] - t2, THETA, d2, p1[self.up], s2, rng)
            if sweep >= burn:
                tables = np.bincount(self.context, t2, n2)
                mean += (c2 - d2 * t2 + (THETA + d2 * tables[self.context]) * p1[self.up]) / (THETA + total2[self.context])
        if levels == 2:
            # The customers of the last seating, seated in turn.
            c1 = np.bincount(self.up, t2, k1).astype(np.int64)
            t1 = np.minimum(t1, c1)
            t1 = draw_tables(c1, np.bincount(self.up_context, t1, self.n_parents)[self.up_context] - t1, THETA, d1, law[self.up_word], s1, rng)
            stats[2:] = ones_twos(c1)
            return np.bincount(self.up_word, t1, len(self.words)), mean / max(1, samples), stats
        return np.bincount(self.word, t2, len(self.words)), mean / max(1, samples), stats


#: What totals tell a shard: words, unigram customers and tables, discounts of three levels, customers and tables of its split contexts.
TOTALS = ["v", "c0", "t0", "d0", "d1", "d2", "c1", "t1", "c2", "t2"]


def _rows(keys: list[int], values: list[bytes], name: str) -> pa.Table:
    return pa.Table.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], [name, "blob"])


def chain(p: Plan, context: int) -> list[int]:
    """A split context and those above it but the unigram restaurant, the upper one first."""
    return [] if not context else [context] if context <= p.n_words else [int(p.parent[context]), context]


def above(totals: dict, replies: np.ndarray, n_above: int) -> np.ndarray:
    """The law per word that ``n_above`` split contexts and the unigram restaurant give; ``replies``: customers and tables by level."""
    law = np.full(replies.shape[1], 1 / (totals["v"] + 1))
    for k in range(n_above + 1):
        c, t = replies[2 * k], replies[2 * k + 1]
        d = totals[f"d{k}"]
        law = (c - d * t + (THETA + d * totals[f"t{k}"]) * law) / (THETA + totals[f"c{k}"])
    return law


def listen(p: Plan, words: np.ndarray, asked: np.ndarray, values: list[bytes]) -> tuple[dict, np.ndarray, np.ndarray]:
    """Totals, training counts and (customers, tables) by level of a shard's sorted words, from what the buckets sent."""
    totals, counts, replies = {}, np.zeros(len(words), np.int64), np.zeros((6, len(words)))
    bucket = np.where(asked, p.bucket(words), -1)
    for v in values:
        head, *cols = blobs.unpack(v)
        if head[0] < 0:
            totals = dict(zip(TOTALS, cols[0].tolist(), strict=True))
            continue
        at = np.flatnonzero(bucket == head[0])
        counts[at] = cols[0]
        for k, x in enumerate(cols[1:]):
            replies[k, at] = x
    return totals, counts, replies


def _shard_round(plan, number: int, last: bool):
    """A shard's seating in one round, and its message to every bucket with words of it."""

    def run(dealt: pa.Table, heard: pa.Table | None) -> pa.Table:
        if not len(dealt) or dealt["shard"][0].as_py() < 0:
            return _rows([], [], "bucket")
        p, shard = plan.value, dealt["shard"][0].as_py()
        t = Tokens(p, dealt["blob"].to_pylist())
        train = ~t.held[t.owner]
        use = np.ones(len(train), bool) if last else train
        context = p.context(shard)
        above_ = chain(p, context)
        totals = {}
        if use.any():
            leaf = Leaf([t.take(x, use) for x in ("w", "u1", "u2")], train[use])
            rng = np.random.default_rng([7, number, shard])
            if heard is None:
                law = (leaf.trained + 0.5) / (leaf.trained.sum() + 0.5 * len(leaf.words) + 0.5)
            else:
                totals, _, replies = listen(p, leaf.words, leaf.trained > 0, heard["blob"].to_pylist())
                law = above(totals, replies, len(above_))
            sent, _, stats = leaf.seat(2 - len(above_), law, totals.get("d2"), totals.get("d1"), BURN, 0, rng)
            words, trained = leaf.words, leaf.trained
        else:
            words, trained, sent, stats = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0), np.zeros(4)
        bucket = p.bucket(words)
        keys, values = [], []
        told = np.array([totals.get(k, np.nan) for k in TOTALS])
        for b in np.union1d(np.unique(bucket), [shard % p.buckets]).tolist():
            at = np.flatnonzero(bucket == b)
            head = np.array([shard, context], np.int64)
            keys.append(b)
            # Counts of dishes go to one bucket only, to be added once.
            values.append(blobs.pack(head, np.r_[stats * (b == shard % p.buckets), told], words[at], trained[at].astype(np.uint32), sent[at].astype(np.uint32), rising=(2,)))
        return _rows(keys, values, "bucket")

    def first(dealt: pa.Table) -> pa.Table:
        return run(dealt, None)

    return run if number else first


class Upper:
    """The unigram restaurant and the split contexts over one bucket's dishes."""

    def __init__(self, p: Plan, messages: list[list[np.ndarray]]):
        self.words, at = np.unique(np.concatenate([m[2] for m in messages]), return_inverse=True)
        n = len(self.words)
        ends = np.cumsum([len(m[2]) for m in messages])
        self.at = np.split(at, ends[:-1])
        of = np.repeat([int(m[0][1]) for m in messages], [len(m[2]) for m in messages])
        sent = np.concatenate([m[4] for m in messages]).astype(np.int64)
        self.trained = np.bincount(at, np.concatenate([m[3] for m in messages]), n).astype(np.int64)
        pair, word = of > p.n_words, (of > 0) & (of <= p.n_words)
        self.key2, to = np.unique(of[pair] * n + at[pair], return_inverse=True)
        self.c2 = np.bincount(to, sent[pair], len(self.key2)).astype(np.int64)
        above2 = p.parent[self.key2 // n] * n + self.key2 % n
        self.key1 = np.unique(np.r_[of[word] * n + at[word], above2])
        self.base1 = np.bincount(np.searchsorted(self.key1, of[word] * n + at[word]), sent[word], len(self.key1)).astype(np.int64)
        self.to1 = np.searchsorted(self.key1, above2)
        self.base0 = np.bincount(at[of == 0], sent[of == 0], n).astype(np.int64)
        self.n = n

    def seat(self, p: Plan, told: dict[int, dict], stats: np.ndarray, rng) -> None:
        """Seats all dishes; leaves mean customers and tables in c0, t0, c1, t1, c2 and t2.

        ``told``: by context, what its shards know of the totals of the round before; in
        the first round a bucket's own tables, times the buckets, stand for them.
        """
        n, scale = self.n, p.buckets
        x1, x2 = self.key1 // n, self.key2 // n
        w1 = self.key1 % n
        any_ = next(iter(told.values()), {})
        t2 = np.minimum(self.c2, 1)
        c1 = self.base1 + np.bincount(self.to1, t2, len(x1)).astype(np.int64)
        t1 = np.minimum(c1, 1)
        c0 = self.base0 + np.bincount(w1, t1, n).astype(np.int64)
        t0 = np.minimum(c0, 1)
        d = [any_.get(f"d{k}") or discount(*ones_twos(c)) for k, c in enumerate((c0, c1, self.c2))]
        s = [stirling(x) for x in d]
        uniform = 1 / ((any_.get("v") or scale * int((self.trained > 0).sum())) + 1)
        size = len(p.parent)
        known = {k: np.array([told.get(x, {}).get(k, np.nan) for x in range(size)]) for k in TOTALS}

        def total(x, values, *keys):
            """Of each context: as told, else from this bucket; a word's totals are known where one of its pairs' is."""
            here = np.bincount(x, values, size) * scale
            for k in keys:
                here = np.where(np.isnan(known[k]), here, known[k])
            return here

        kept = np.zeros((2, n)), np.zeros((2, len(x1))), np.zeros((2, len(x2)))
        for sweep in range(BURN + SAMPLES):
            all_t0 = any_.get("t0") or t0.sum() * scale
            all_c0 = any_.get("c0") or c0.sum() * scale
            p0 = (c0 - d[0] * t0 + (THETA + d[0] * all_t0) * uniform) / (THETA + all_c0)
            u1, k1 = total(x1, t1, "t1"), total(x1, c1, "c1")
            p1 = (c1 - d[1] * t1 + (THETA + d[1] * u1[x1]) * p0[w1]) / (THETA + np.maximum(k1[x1], c1))
            u2 = total(x2, t2, "t2")
            t2 = draw_tables(self.c2, np.maximum(u2[x2] - t2, 0), THETA, d[2], p1[self.to1], s[2], rng)
            c1 = self.base1 + np.bincount(self.to1, t2, len(x1)).astype(np.int64)
            t1 = np.minimum(t1, c1)
            t1 = draw_tables(c1, np.maximum(u1[x1] - t1, 0), THETA, d[1], p0[w1], s[1], rng)
            c0 = self.base0 + np.bincount(w1, t1, n).astype(np.int64)
            t0 = np.minimum(t0, c0)
            t0 = draw_tables(c0, np.maximum(all_t0 - t0, 0), THETA, d[0], np.full(n, uniform), s[0], rng)
            if sweep >= BURN:
                for into, values in zip(kept, ((c0, t0), (c1, t1), (self.c2, t2)), strict=True):
                    into[0] += values[0]
                    into[1] += values[1]
        (self.m0, self.m1, self.m2) = (k / SAMPLES for k in kept)
        stats = stats.copy()
        stats[:2] += ones_twos(self.c2)
        stats[2:] += ones_twos(c1)
        x = np.r_[x1, x2]
        split = np.unique(x)
        sums = [np.bincount(x, np.r_[self.m1[k], self.m2[k]], size)[split] for k in (0, 1)]
        self.subtotals = np.r_[float((self.trained > 0).sum()), self.m0.sum(1), ones_twos(c0), stats], split, *sums

    def reply(self, p: Plan, context: int, at: np.ndarray) -> list[np.ndarray]:
        """Training counts and mean (customers, tables) of a shard's words, level by level from the unigram restaurant down."""
        out = [self.trained[at].astype(np.uint32), *[x[at].astype(np.float32) for x in self.m0]]
        for x in chain(p, context):
            keys, m = (self.key1, self.m1) if x <= p.n_words else (self.key2, self.m2)
            i = np.minimum(np.searchsorted(keys, x * self.n + at), max(0, len(keys) - 1))
            there = keys[i] == x * self.n + at if len(keys) else np.zeros(len(at), bool)
            out += [np.where(there, v[i], 0).astype(np.float32) for v in m]
        return out


def _bucket_round(plan, number: int):
    """A bucket's seating; replies by shard, and subtotals under shard -1."""

    def run(t: pa.Table) -> pa.Table:
        p, bucket = plan.value, t["bucket"][0].as_py()
        messages = sorted((blobs.unpack(v) for v in t["blob"].to_pylist()), key=lambda m: int(m[0][0]))
        upper = Upper(p, messages)
        told = {}
        for m in messages:
            known = dict(zip(TOTALS, m[1][4:].tolist(), strict=True))
            if not np.isnan(known["v"]):
                told[int(m[0][1])] = known
                for x in chain(p, int(m[0][1]))[:-1]:
                    told.setdefault(x, known)
        upper.seat(p, told, sum(m[1][:4] for m in messages), np.random.default_rng([11, number, bucket]))
        keys, values = [-1], [blobs.pack(*upper.subtotals)]
        for m, at in zip(messages, upper.at, strict=True):
            keys.append(int(m[0][0]))
            values.append(blobs.pack(np.array([bucket], np.int64), *upper.reply(p, int(m[0][1]), at)))
        return _rows(keys, values, "shard")

    return run


def _totals(plan):
    """Subtotals of all buckets added up, for every shard with those of its split contexts."""

    def run(t: pa.Table) -> pa.Table:
        p = plan.value
        sums, c, u = np.zeros(9), np.zeros(len(p.parent)), np.zeros(len(p.parent))
        for v in sorted(t["blob"].to_pylist()):
            head, split, cs, us = blobs.unpack(v)
            sums += head
            c[split] += cs
            u[split] += us
        d0, d2, d1 = discount(*sums[3:5]), discount(*sums[5:7]), discount(*sums[7:9])
        values = []
        for shard in range(p.all_shards):
            levels = [x for k in chain(p, p.context(shard)) for x in (c[k], u[k])]
            values.append(blobs.pack(np.array([-1], np.int64), np.array([*sums[:3], d0, d1, d2, *levels, *[0.0] * (4 - len(levels))])))
        return _rows(list(range(p.all_shards)), values, "shard")

    return run


def predictive(p: Plan, shard: int, leaf: Leaf, heard: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict]:
    """The averaged probability of every type of a shard, training counts of its words, and the totals."""
    totals, counts, replies = listen(p, leaf.words, np.ones(len(leaf.words), bool), heard)
    above_ = chain(p, p.context(shard))
    law = above(totals, replies, len(above_))
    _, mean, _ = leaf.seat(2 - len(above_), law, totals["d2"], totals["d1"], BURN, SAMPLES, np.random.default_rng([13, shard]))
    return mean, counts, totals


_PART = "bucket int, blob binary"


def _score_shard(plan, doc_bits: int):
    """A shard's share of the scores of its documents, packed by document bucket."""

    def run(dealt: pa.Table, heard: pa.Table) -> pa.Table:
        if not len(dealt):
            return _rows([], [], "bucket")
        p, shard = plan.value, dealt["shard"][0].as_py()
        if shard < 0:
            return _rows([-1 - shard] * len(dealt), dealt["blob"].to_pylist(), "bucket")
        t = Tokens(p, dealt["blob"].to_pylist())
        k = len(t.uid)
        check = np.bincount(t.owner, _checks(t.w, t.u1, t.u2), k).astype(np.int64).astype(np.uint16)
        leaf = Leaf([t.take(x) for x in ("w", "u1", "u2")], ~t.held[t.owner])
        mean, counts, totals = predictive(p, shard, leaf, heard["blob"].to_pylist())
        score = np.log10(mean)
        base = np.log10((counts + 0.5) / (p.n + 0.5 * (totals["v"] + 1)))[leaf.word]
        known = (counts > 0)[leaf.word]
        of = leaf.of_token
        sums = [np.bincount(t.owner, x, k) for x in (None, known[of], base[of], score[of])]
        bucket = doc_bucket(t.uid, doc_bits)
        order = np.lexsort((t.uid, bucket))
        # Logarithms travel as fixed-point numbers, whose high bytes are all zero.
        fixed = np.round(-sums[2] * FIXED).astype(np.int64)
        cuts = np.searchsorted(bucket[order], np.arange((1 << doc_bits) + 1))
        keys, values = [], []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            o = order[cuts[b] : cuts[b + 1]]
            keys.append(b)
            values.append(blobs.pack(t.uid[o], sums[0][o].astype(np.uint32), sums[1][o].astype(np.uint32), fixed[o], sums[3][o].astype(np.float32), check[o], rising=(0,)))
        return _rows(keys, values, "bucket")

    return run


def _sum_docs(total: int):
    """Documents of one bucket with the sums of their shares."""

    def run(t: pa.Table) -> pa.Table:
        parts = [blobs.unpack(v) for v in t["blob"].to_pylist()]
        uid, doc, held, size, check = (np.concatenate(x) for x in zip(*[p for p in parts if len(p) == 5], strict=True))
        share = [np.concatenate(x) for x in zip(*[p for p in parts if len(p) == 6], strict=True)]
        order = np.argsort(uid)
        uid, doc, held, size, check = (x[order] for x in (uid, doc, held, size, check))
        at = np.searchsorted(uid, share[0])
        n, known, base, score, told = (np.bincount(at, x, len(uid)) for x in share[1:])
        if (n != size).any() or (told.astype(np.int64).astype(np.uint16) != check).any():
            raise RuntimeError("tokens were dealt anew from rows in another order; store the input before scoring it")
        cols = {
            "doc_id": pa.array(doc, pa.int64(), mask=doc == NO_ID), "held_out": pa.array(held == 1), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)),
            "train_tokens": pa.array(np.full(len(uid), total, np.int64)), "base_score": pa.array(-base / FIXED), "score": pa.array(score),
        }
        return pa.table(cols)

    return run


def make_plan(docs: DataFrame) -> Plan:
    """Shards by the corpus' bytes; the driver gets ``COMMON`` words and the contexts that may be split."""
    shards = blobs.bucket_count(docs, SHARD_BYTES, LEAST_SHARDS)
    found = stored(frequent(docs, shards), "frequent")
    rows = found.where("kind = 0").collect() + found.where("kind = 1").orderBy(F.desc("n"), "key").limit(COMMON).collect()
    total = {r["key"]: r["n"] for r in rows if r["kind"] == 0}
    # At most 2 * shards words and as many pairs have so large a share of all tokens.
    rows += found.where((F.col("kind") > 1) & (F.col("n") >= total.get(1, 0) / (2 * shards))).collect()
    return Plan([(r["kind"], r["key"], r["parent"], r["n"]) for r in rows], shards)


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Perplexity of a set of rows is 10 ** (-sum(score) / sum(n_tokens)).
    """
    made = make_plan(docs)
    plan = docs.sparkSession.sparkContext.broadcast(made)
    message = "shard int, blob binary"
    doc_bits = max(4, made.shards.bit_length() - 2)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_deal(plan, doc_bits), message).groupBy("shard")
    heard = None
    for k in range(rounds):
        seat = _shard_round(plan, k, k == rounds - 1)
        sent = dealt.applyInArrow(seat, _PART) if heard is None else dealt.cogroup(heard).applyInArrow(seat, _PART)
        back = sent.groupBy("bucket").applyInArrow(_bucket_round(plan, k), message)
        totals = back.where("shard = -1").groupBy("shard").applyInArrow(_totals(plan), message)
        heard = back.where("shard >= 0").unionByName(totals).groupBy("shard")
    scored = dealt.cogroup(heard).applyInArrow(_score_shard(plan, doc_bits), _PART)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return scored.groupBy("bucket").applyInArrow(_sum_docs(made.n), schema)
