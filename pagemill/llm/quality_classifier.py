"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, each chosen pair of features one
over both their bins.  Training goes round and round the features: a shallow tree
(three splits at most) is fitted to the residuals along one feature's bins and
its leaves, shrunk, are added to that feature's table.  Pairs are then ranked by
what one split on either axis gains on the residuals that are left, and boosted in
the same cyclic way by trees of four leaves.  A score is the sigmoid of a sum of
table entries, looked up for whole columns at once.

Texts are read once: features of every row are written to the shared folder, the
driver trains on at most ``SAMPLE`` labelled rows (those with the smallest hashes
of doc_id; a documented bound, a few MB), and the tables, some KB, score all rows.

Features are rates of the text alone: lengths, shares of kinds of characters, how
varied words, pairs of words and lines are, how well the text compresses.

Defined results: null and empty texts have all features 0 and are scored like any
row; very long texts are read whole; an empty table gives none; rows with a null or
repeated doc_id are scored each; null labels are not used; a document without label is scored; a label
repeated for a document counts each time; without labels of both kinds every
score is the labels' mean (0.5 without labels); extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAST_LEAF = 120, 60, 0.15, 10

FEATURES = [
    "log_chars", "log_words", "word_len", "symbols", "bars", "upper", "bangs", "digits", "stops", "non_ascii",
    "distinct_words", "short_words", "line_words", "dup_lines", "packed", "marked_words", "at_signs", "top_line",
    "punctuation", "byte_kinds", "top_word", "repeated_pairs", "long_words", "sentence_words",
]
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_HIGH = bytes(range(128, 256))
_PUNCT = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_ENDS = (b".", b"!", b"?", "。".encode())


def features(text: str | None) -> list[float]:
    """Rates of a whole text, every one 0 for an empty text."""
    b = (text or "").encode("utf-8", "surrogatepass")
    ws = b.split()
    if not ws:
        return [0.0] * len(FEATURES)
    n, k = len(b), len(ws)
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    lines = [x for x in b.split(b"\n") if x.strip()]
    marked = sum(1 for w in ws if w[-1] in b"#*$%&|<>!")
    kinds = Counter(ws)
    most = max(kinds.values())
    pairs = list(zip(ws, ws[1:], strict=False))
    return [
        np.log1p(n), np.log1p(k), (n - b.count(b" ")) / k, share(b"#*$%&<>"), share(b"|"), share(_UPPER), share(b"!"), share(_DIGIT), b.count(b".") / k, share(_HIGH),
        len(kinds) / k, sum(map((4).__gt__, map(len, ws))) / k, k / len(lines), 1 - len(set(lines)) / len(lines), len(zlib.compress(b, 1)) / n, marked / k, share(b"@"), max(map(len, lines)) / n,
        share(_PUNCT), len(set(b)) / 256, most / k, 1 - len(set(pairs)) / len(pairs) if pairs else 0.0, sum(map((12).__lt__, map(len, ws))) / k, k / (1 + sum(b.count(e) for e in _ENDS)),
    ]


@dataclass
class Gam:
    """Bin edges, tables and the base rate's log odds."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, f], "right")]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a run of bins by gradient and curvature sums."""
    cg, ch, cn = g.cumsum()[:-1], h.cumsum()[:-1], n.cumsum()[:-1]
    gain = cg**2 / (ch + 1) + (g.sum() - cg) ** 2 / (h.sum() - ch + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain[(cn < LEAST_LEAF) | (n.sum() - cn < LEAST_LEAF)] = 0
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, splits: int = 3) -> np.ndarray:
    """Newton steps per bin from a tree of at most ``splits`` cuts, the best gain first."""
    leaves = [(0, len(g))]
    for _ in range(splits):
        found = [(*_best_cut(g[a:b], h[a:b], n[a:b]), i) for i, (a, b) in enumerate(leaves)]
        gain, cut, i = max(found)
        if gain <= 0:
            break
        a, b = leaves[i]
        leaves[i : i + 1] = [(a, a + cut), (a + cut, b)]
    out = np.empty(len(g))
    for a, b in leaves:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def quad_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best four leaves: one cut on the first axis, then one on the second in each half."""
    best, steps = 0.0, np.zeros_like(g)
    whole = g.sum() ** 2 / (h.sum() + 1)
    for cut in range(1, len(g)):
        gain, trial = -whole, np.zeros_like(g)
        for rows in (slice(0, cut), slice(cut, None)):
            gg, hh, nn = g[rows].sum(0), h[rows].sum(0), n[rows].sum(0)
            _, c = _best_cut(gg, hh, nn)
            for cols in (slice(0, c), slice(c, None)) if c else (slice(0, None),):
                a, b = gg[cols].sum(), hh[cols].sum()
                gain += a * a / (b + 1)
                trial[rows, cols] = a / (b + 1)
        if gain > best:
            best, steps = gain, trial
    return best, steps


def train(x: np.ndarray, y: np.ndarray) -> Gam:
    m = Gam()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    m.intercept = float(np.log(rate / (1 - rate)))
    m.edges = [_edges(c, BINS) if len(c) else np.empty(0) for c in x.T]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    m.pair_edges = [_edges(c, PAIR_BINS) if len(c) else np.empty(0) for c in x.T]
    if not 0 < y.sum() < len(y):
        return m
    at = [np.searchsorted(e, c, "right") for e, c in zip(m.edges, x.T, strict=True)]
    sizes = [np.bincount(a, minlength=len(t)) for a, t in zip(at, m.tables, strict=True)]
    raw = np.full(len(y), m.intercept)

    def pull() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for a, t, n in zip(at, m.tables, sizes, strict=True):
            g, h = pull()
            step = RATE * shallow_tree(np.bincount(a, g, len(t)), np.bincount(a, h, len(t)), n)
            t += step
            raw += step[a]
    pat = [np.searchsorted(e, c, "right") for e, c in zip(m.pair_edges, x.T, strict=True)]
    wide = [len(e) + 1 for e in m.pair_edges]

    def grids(i: int, j: int) -> list[np.ndarray]:
        key = pat[i] * wide[j] + pat[j]
        return [np.bincount(key, w, wide[i] * wide[j]).reshape(wide[i], wide[j]) for w in (*pull(), None)]

    gains = sorted(((quad_tree(*grids(i, j))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    m.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    m.pair_tables = [np.zeros((wide[i], wide[j])) for i, j in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in zip(m.pairs, m.pair_tables, strict=True):
            step = RATE * quad_tree(*grids(i, j))[1]
            t += step
            raw += step[pat[i], pat[j]]
    return m


def extract(docs: DataFrame) -> DataFrame:
    """doc_id and features (array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def third(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Gam:
    """A model from labelled rows; ``labels``: doc_id and label (0 or 1)."""
    lab = labels.where(F.col("label").isNotNull()).select(F.col("doc_id").alias("__doc"), F.col("label").cast("double").alias("y"))
    rows = feats.join(lab, feats["doc_id"] == lab["__doc"]).select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)).alias("h"), "doc_id", "x", "y")
    # Cut near the bound by the same hash first, so that no task sends rows that the limit drops.
    n = rows.count()
    if n > sample:
        rows = rows.where(F.col("h") <= int((1 << 31) * min(1.0, 1.2 * sample / n + 1e-6)))
    rows = rows.orderBy("h", "doc_id", "y").limit(sample).toPandas()
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return train(x, rows["y"].to_numpy(float))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; rows of remainder 1 teach nothing.

    ``labels``: doc_id and label.
    """
    feats = stored(extract(docs), "features")
    model = docs.sparkSession.sparkContext.broadcast(fit(feats, labels.where(~third(F.col("doc_id"))), sample))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.value.score(np.array(x.tolist(), float).reshape(len(x), len(FEATURES))))

    out = feats.select("doc_id", F.coalesce(third(F.col("doc_id")), F.lit(False)).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
