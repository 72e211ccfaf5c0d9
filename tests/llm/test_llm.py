"""Training-data operators: brute force, held-out accuracy, exact round trips and odd inputs."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import byte_bpe, decontaminate, hpylm, jaccard_join, line_dedup, quality_classifier, quality_rules, queries, token_counts, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and in to alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def make(spark, texts, source="s", first=0):
    return spark.createDataFrame([(first + i, t, "en", source, None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def prose(rnd, n, k=None):
    return " ".join(rnd.choice(WORDS) + (str(rnd.randint(0, 400)) if rnd.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, clashing extra columns."""
    rnd = random.Random(3)
    long = "\n".join(prose(rnd, 40) for _ in range(400))
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (None, "another one\nwithout an id", "en", None, 3), (None, "the third without", "en", "s", 3), (9, "one id", "en", "s", 6), (9, "two texts", "en", "s", 9), (3, " \n\t ", "en", "s", 4), (4, long, "en", None, len(long)), (5, long + "\nend", "en", "s", None),
        (6, "One two", "en", "s", 7), (7, "one TWO", "en", "s", 7), (8, "Été çà 漢字 🙂 é \x1c\x85x", "fr", "s", 1), (8, "Été çà 漢字 🙂 é \x1c\x85x", "fr", "s", 1), (None, "no id at all here", "en", "s", 3),
    ]
    d = spark.createDataFrame(rows, SCHEMA)
    for c in ("hash", "n", "digest", "bucket", "n_words", "kept", "comp", "score", "start", "doc", "fp", "x", "__salt"):
        d = d.withColumn(c, F.lit("clash"))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


BENCH = "item_id long, text string"


def every_operator(spark, docs):
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as label")
    bench = spark.createDataFrame([(1, "one two"), (2, None), (3, "")], BENCH)
    return {
        "hpylm": hpylm.score(docs),
        "decontaminate": decontaminate.clean(docs, bench),
        "jaccard": jaccard_join.join(docs),
        "jaccard clean": jaccard_join.clean(docs),
        "counts": token_counts.count(docs, queries.tokenizer("word_bpe_49k.json")),
        "lines": line_dedup.clean(docs),
        "paragraphs": line_dedup.clean(docs, "paragraph"),
        "classifier": quality_classifier.classify(docs, labels),
        "rules": quality_rules.judge(docs),
        "rules clean": quality_rules.clean(docs),
        "bpe": byte_bpe.encode(docs, queries.tokenizer("byte_bpe_50k.tiktoken"), PATTERN, keep_ids=True),
    }


import public_tokenizers  # noqa: E402

PATTERN = public_tokenizers.PATTERN


def test_odd_rows(spark, odd):
    got = {k: df.collect() for k, df in every_operator(spark, odd).items()}
    n = odd.count()
    for k in ("hpylm", "jaccard", "counts", "lines", "paragraphs", "classifier", "rules", "bpe"):
        assert len(got[k]) == n, k
    assert sorted(r["doc_id"] for r in odd.collect() if r["doc_id"]) == sorted(r["doc_id"] for r in got["counts"] if r["doc_id"])
    comp = {r["doc_id"]: r["component_id"] for r in got["jaccard"]}
    assert comp[7] == 6 and comp[5] == 4 and comp[1] == 1 and comp[2] == 2 and comp[3] == 3 and comp[8] == 8
    hp = {r["doc_id"]: r for r in got["hpylm"]}
    assert all(hp[i]["n_tokens"] == 1 for i in (1, 2, 3))
    assert {r["doc_id"] for r in got["decontaminate"]} == {1, 2, 3, 4, 5, 8, 9, None}
    assert {r["doc_id"]: r["base_failed"] for r in got["rules"]}[1] is True
    digests = lambda rows: sorted((str(i), d) for i, d in rows)
    assert digests((r["doc_id"], r["decoded_sha256"]) for r in got["bpe"]) == digests((x["doc_id"], hashlib.sha256((x["text"] or "").encode()).hexdigest()) for x in odd.collect())
    texts = collections.Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert collections.Counter((r["doc_id"], r["text"]) for r in got["decontaminate"]) == collections.Counter({k: v for k, v in texts.items() if k[0] not in (6, 7)})
    assert set(got["lines"][0].asDict()) == set(odd.columns)


def test_empty_tables(spark, empty):
    for k, df in every_operator(spark, empty).items():
        assert df.count() == 0, k


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(name, spark, sf, same_as_oracle):
    same_as_oracle(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


# 1 ------------------------------------------------------------------------------------


def test_hpylm_base_and_perplexity(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = hpylm.score(docs).toPandas()
    tokens = {r["doc_id"]: re.findall(rb"[^\x20\x09-\x0d]+", r["text"].encode().lower()) + [None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    c = collections.Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for r in out.itertuples():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), abs_tol=1e-6)
    h = out[out.held_out]
    ppl = lambda s: 10 ** (-s.sum() / h.n_tokens.sum())
    assert ppl(h.score) < 0.7 * ppl(h.base_score)


class Here:
    """A broadcast value without a cluster."""

    def __init__(self, value):
        self.value = value


def rounds_here(texts, shards, rounds=hpylm.ROUNDS):
    """The model's rounds in this process: plan, dealt rows by shard, and the last round's bucket seatings and totals."""
    ids = list(range(len(texts)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts)})
    w, u1, u2, sizes = hpylm._tokens(texts)
    train = np.repeat([not hpylm.held_out(i) for i in ids], sizes)
    rows = [(0, 0, 0, int(train.sum())), (0, 1, 0, len(w))]
    of = lambda x: [(int(k), int(n)) for k, n in zip(*np.unique(x.view(np.int64), return_counts=True), strict=True)]
    rows += [(1, k, 0, n) for k, n in sorted(of(w), key=lambda x: -x[1])[:5]] + [(2, k, 0, n) for k, n in of(u1)]
    pairs = hpylm.pair_key(u1, u2)
    parent = dict(zip(pairs.view(np.int64).tolist(), u1.view(np.int64).tolist(), strict=True))
    rows += [(3, k, parent[k], n) for k, n in of(pairs)]
    p = hpylm.Plan(rows, shards)
    plan = Here(p)

    def grouped(tables, key):
        t = pa.concat_tables([pa.Table.from_batches([x]) if isinstance(x, pa.RecordBatch) else x for x in tables])
        return {k: t.filter(pa.compute.equal(t[key], k)) for k in sorted(set(t[key].to_pylist()))}

    dealt = {s: t for s, t in grouped(list(hpylm._deal(plan, 4)(iter([batch]))), "shard").items() if s >= 0}
    heard = None
    for k in range(rounds):
        run = hpylm._shard_round(plan, k, k == rounds - 1)
        sent = grouped([run(t) if heard is None else run(t, heard[s]) for s, t in dealt.items()], "bucket")
        back = grouped([hpylm._bucket_round(plan, k)(t) for t in sent.values()], "shard")
        totals = grouped([hpylm._totals(plan)(back.pop(-1))], "shard")
        heard = {s: pa.concat_tables([back[s], totals[s]]) for s in back}
    messages = {b: sorted((hpylm.blobs.unpack(v) for v in t["blob"].to_pylist()), key=lambda m: int(m[0][0])) for b, t in sent.items()}
    return p, dealt, heard, messages


def mixed_texts(rnd, n, size=40):
    """Words of a skewed law that depends on the word before; one pair is very common."""
    out = []
    for _ in range(n):
        t = []
        while len(t) < size:
            k = (sum(map(ord, t[-1])) if t else 0) % 5
            t += ["hot", "pair"] if rnd.random() < 0.35 else [f"w{min(int(rnd.paretovariate(0.8)) + k, 30)}"]
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize(("shards", "rounds"), [(1, 1), (8, 1), (16, 2)])
def test_hpylm_law_sums_to_one(shards, rounds):
    """Over all training words and one unseen word, in every context of every shard, whole or split; seen contexts and new ones."""
    texts = mixed_texts(random.Random(5), 150)
    p, dealt, heard, messages = rounds_here(texts, shards, rounds)
    assert shards == 1 or (p.n_words >= 2 and len(p.pairs) >= 1 and p.all_shards > shards)
    assert p.buckets == max(1, shards // 8)
    uppers = []
    told = {}
    for m in (x for ms in messages.values() for x in ms):
        known = dict(zip(hpylm.TOTALS, m[1][4:].tolist(), strict=True))
        if rounds > 1:
            told[int(m[0][1])] = known
            for x in hpylm.chain(p, int(m[0][1]))[:-1]:
                told.setdefault(x, known)
    for b, ms in messages.items():
        u = hpylm.Upper(p, ms)
        u.seat(p, told, sum(m[1][:4] for m in ms), np.random.default_rng([11, rounds - 1, b]))
        uppers.append(u)
    words = np.concatenate([u.words[u.trained > 0] for u in uppers])
    unseen = np.uint64(12345)
    for shard, t in dealt.items():
        tok = hpylm.Tokens(p, t["blob"].to_pylist())
        train = ~tok.held[tok.owner]
        cu1, cu2 = np.unique(np.column_stack([tok.u1, tok.u2]), axis=0)[:6].T
        if p.context(shard) <= p.n_words:  # a context never seen below the same last word
            cu1, cu2 = np.r_[cu1, cu1[:1]], np.r_[cu2, np.uint64(777)]
        every = np.r_[words, unseen]
        xs = [np.repeat(cu1, len(every)), np.repeat(cu2, len(every)), np.tile(every, len(cu1))]
        leaf = hpylm.Leaf([np.r_[tok.w, xs[2]], np.r_[tok.u1, xs[0]], np.r_[tok.u2, xs[1]]], np.r_[train, np.zeros(len(xs[0]), bool)])
        totals = hpylm.listen(p, leaf.words, np.zeros(len(leaf.words), bool), [v for v in heard[shard]["blob"].to_pylist() if hpylm.blobs.unpack(v)[0][0] < 0])[0]
        replies = np.zeros((6, len(leaf.words)))
        for u in uppers:
            at = np.flatnonzero(np.isin(leaf.words, u.words))
            for k, x in enumerate(u.reply(p, p.context(shard), np.searchsorted(u.words, leaf.words[at]))[1:]):
                replies[k, at] = x
        n_above = len(hpylm.chain(p, p.context(shard)))
        law = hpylm.above(totals, replies, n_above)
        _, mean, _ = leaf.seat(2 - n_above, law, totals["d2"], totals["d1"], 2, 3, np.random.default_rng(1))
        per = mean[leaf.of_token[len(tok.w) :]].reshape(len(cu1), len(every)).sum(1)
        assert np.allclose(per, 1, atol=1e-5), (shard, p.context(shard), per)


def plain_sampler(train, test, sweeps=40):
    """One-process Gibbs over explicit tables, customer by customer; mean log10 probability of the test tokens."""
    rnd = random.Random(1)
    theta = hpylm.THETA
    tables = collections.defaultdict(lambda: collections.defaultdict(list))  # context -> dish -> customers of each table
    vocab = {w for t in train for w in t} | {None}
    d = [0.5, 0.5, 0.5]

    def p(w, ctx):
        if ctx is None:
            return 1 / (len(vocab) + 1)
        own = tables[ctx]
        c, t = sum(own[w]) if w in own else 0, len(own[w]) if w in own else 0
        size, n = sum(sum(x) for x in own.values()), sum(map(len, own.values()))
        return (c - d[len(ctx)] * t + (theta + d[len(ctx)] * n) * p(w, ctx[1:] if ctx else None)) / (theta + size)

    def add(w, ctx):
        if ctx is None:
            return
        own, k = tables[ctx], d[len(ctx)]
        n = sum(map(len, own.values()))
        weights = [x - k for x in own[w]] + [(theta + k * n) * p(w, ctx[1:] if ctx else None)]
        i = rnd.choices(range(len(weights)), weights)[0]
        if i == len(own[w]):
            own[w].append(1)
            add(w, ctx[1:] if ctx else None)
        else:
            own[w][i] += 1

    def remove(w, ctx):
        if ctx is None:
            return
        own = tables[ctx][w]
        i = rnd.choices(range(len(own)), own)[0]
        own[i] -= 1
        if not own[i]:
            own.pop(i)
            if not own:
                del tables[ctx][w]
            remove(w, ctx[1:] if ctx else None)

    def places(t):
        t = ["<1>", "<0>", *t, None]
        return [(t[i], (t[i - 2], t[i - 1])) for i in range(2, len(t))]

    seats = [x for t in train for x in places(t)]
    total = collections.Counter()
    for sweep in range(sweeps):
        for w, ctx in seats:
            if sweep:
                remove(w, ctx)
            add(w, ctx)
        for level in range(3):
            sizes = collections.Counter(sum(x) for c, own in tables.items() if len(c) == level for x in own.values() if x)
            d[level] = hpylm.discount(sizes[1], sizes[2])
        if sweep >= sweeps // 2:
            for k, (w, ctx) in enumerate(x for t in test for x in places(t)):
                total[k] += p(w, ctx) / (sweeps - sweeps // 2)
    return sum(map(math.log10, total.values())) / len(total)


def test_hpylm_notices_another_order():
    """Shares of documents of equal length, dealt again in another order, do not pass for each other's."""
    texts = ["a b c d", "e f g h", "a b c d"]

    def parts(order):
        p, dealt, heard, _ = rounds_here([texts[i] for i in order], 4)
        batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(order, pa.int64()), "text": pa.array([texts[i] for i in order])})
        docs = [v for k, v in zip(*pa.Table.from_batches(list(hpylm._deal(Here(p), 0)(iter([batch])))).to_pydict().values(), strict=True) if k < 0]
        shares = [v for s, t in dealt.items() for v in hpylm._score_shard(Here(p), 0)(t, heard[s])["blob"].to_pylist()]
        return docs, shares

    def put(docs, shares):
        blobs = docs + shares
        return hpylm._sum_docs(1)(pa.table({"bucket": [0] * len(blobs), "blob": pa.array(blobs, pa.binary())})).to_pydict()

    docs, shares = parts([0, 1, 2])
    assert put(docs, shares)["n_tokens"] == [5, 5, 5]
    with pytest.raises(RuntimeError, match="another order"):
        put(docs, parts([1, 0, 2])[1])


def test_hpylm_against_a_plain_sampler(spark, monkeypatch):
    """The same held-out perplexity, whole or dealt over many shards with split contexts."""
    texts = mixed_texts(random.Random(6), 120, 20)
    held = [hpylm.held_out(i) for i in range(len(texts))]
    want = plain_sampler([t.split() for t, h in zip(texts, held, strict=True) if not h], [t.split() for t, h in zip(texts, held, strict=True) if h])
    for least in (1, 16):
        monkeypatch.setattr(hpylm, "LEAST_SHARDS", least)
        for rounds in (1, 2):
            out = hpylm.score(make(spark, texts).repartition(3), rounds).toPandas()
            h = out[out.held_out]
            assert abs(h.score.sum() / h.n_tokens.sum() - want) < 0.015, (least, rounds, h.score.sum() / h.n_tokens.sum(), want)


def test_table_draws_follow_their_law():
    d, theta, others, parent, c = 0.5, 1.0, 3, 0.2, 6
    s = hpylm.stirling(d)
    w = np.array([np.prod([theta + d * (others + i) for i in range(t)]) * parent**t * np.exp(s[c, t]) for t in range(1, c + 1)])
    k = 40_000
    t = hpylm.draw_tables(np.full(k, c), np.full(k, others), theta, d, np.full(k, parent), s, np.random.default_rng(0))
    assert np.allclose(np.bincount(t, minlength=c + 1)[1:] / k, w / w.sum(), atol=0.01)


def test_split_contexts_are_dealt(spark, monkeypatch):
    """A last word and a pair with a third of all tokens lie over several shards; every text is scored."""
    texts = mixed_texts(random.Random(1), 200)
    p = rounds_here(texts, 8)[0]
    assert p.n_words and len(p.pairs) and all(x >= 2 for x in p.parts)
    w, u1, u2, _ = hpylm._tokens(texts)
    got = np.bincount(p.route(u1, u2, np.arange(len(w), dtype=np.uint64)), minlength=p.all_shards)
    assert got.max() < len(w) / 8
    out = hpylm.score(make(spark, texts)).toPandas()
    assert len(out) == 200 and (out.n_tokens >= 41).all() and (out.score < 0).all()


def test_codes_round_trip():
    """Frequent words by code, others and the rarer of two in one slot as they are."""
    big = 1 << 40
    p = hpylm.Plan([(1, k, 0, 1) for k in (9 * big, 3 * big, 5 * big, 5 * big + 1)], 8)
    w = np.array([3 * big, 4, 9 * big, 9 * big, 5 * big, 2**47, 5 * big + 1], np.uint64)
    code, rare = p.encode(w)
    assert rare.tolist() == [4, 2**47, 5 * big + 1] and p.decode(code, rare).tolist() == w.tolist()


# 2 ------------------------------------------------------------------------------------


def test_decontaminate(spark):
    rnd = random.Random(2)
    item = prose(rnd, 40)
    ws = item.split()
    edited = ws[:20] + ["changed"] + ws[21:]
    docs = make(spark, [
        prose(rnd, 100) + " " + item + " " + prose(rnd, 100), prose(rnd, 30) + " " + " ".join(edited).upper() + "! " + prose(rnd, 9), prose(rnd, 200), " ".join(ws[:20]), " ".join(ws[::-1]), item, None, "short item here",
    ])
    bench = spark.createDataFrame([(1, item), (2, item), (3, "SHORT item."), (4, None), (5, "...")], BENCH)
    got = decontaminate.matches(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]): (r["start_word"], round(r["similarity"], 3)) for r in got}
    assert found == {(0, 1): (100, 1.0), (0, 2): (100, 1.0), (1, 1): (30, 0.756), (1, 2): (30, 0.756), (5, 1): (0, 1.0), (5, 2): (0, 1.0), (7, 3): (0, 1.0)}
    monkey = decontaminate.BROADCAST_SHINGLES
    try:  # the join for large benchmarks gives the same
        decontaminate.BROADCAST_SHINGLES = 0
        again = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()}
    finally:
        decontaminate.BROADCAST_SHINGLES = monkey
    assert again == set(found)


def test_decontaminate_texts_shorter_than_the_item(spark):
    rnd = random.Random(12)
    item, longer = prose(rnd, 40), prose(rnd, 60)
    ws = item.split()
    docs = make(spark, [" ".join(x) for x in (ws[:38], ws[4:], ws[1:-1], ws[:30], ws[:4], longer.split()[3:], ["x"] + ws[:36])])
    bench = spark.createDataFrame([(1, item), (2, longer)], BENCH)
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.matches(docs, bench).collect()}
    bag = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    want = {}
    for d, t in ((r["doc_id"], r["text"].split()) for r in docs.collect()):
        for i, x in ((1, ws), (2, longer.split())):
            a, b = bag(t), bag(x)
            if len(a & b) / len(a | b) >= 0.75:
                want[d, i] = (0, len(t), round(len(a & b) / len(a | b), 6))
    assert got == want and {d for d, _ in want} == {0, 1, 2, 5, 6}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == {3, 4}


def every_window(docs, bench):
    """(doc, item) -> (start, n_words, similarity) of the first best window over every start of every text."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    shingles = lambda ws: [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    out = {}
    for d, t in docs:
        h = shingles(cut(t))
        have = collections.Counter(h)
        for i, x in bench:
            item = shingles(cut(x))
            b, m, best = collections.Counter(item), len(item), (0, 0)
            if not m or sum((have & b).values()) < 0.4 * m:  # no window can hold enough
                continue
            for s in range(max(1, len(h) - m + 1)):
                a = collections.Counter(h[s : s + m])
                both = sum((a & b).values())
                best = max(best, (both / (m + sum(a.values()) - both), -s))
            if best[0] >= 0.75:
                out[d, i] = (-best[1], min(len(h), m) + 4, round(best[0], 6))
    return out


def test_decontaminate_every_start(spark):
    """Windows that no shingle's place aligns: halves swapped, clauses permuted, words inserted, left out and repeated."""
    rnd = random.Random(31)
    items = [prose(rnd, n) for n in (12, 40, 40, 80, 120)] + ["la la la la la la la la la la la la", " ".join(prose(rnd, 8).split() * 5)]
    bench, texts = list(enumerate(items)), []
    for x in items:
        ws = x.split()
        half = len(ws) // 2
        swapped = ws[half:] + ws[:half]
        thirds = [ws[i * len(ws) // 3 : (i + 1) * len(ws) // 3] for i in range(3)]
        edits = [swapped, thirds[2] + thirds[0] + thirds[1], ws[:half] + ["new"] + ws[half:], ws[: half // 2] + ws[half // 2 + 1 :], ws[:half] + ws[half - 5 :], ws + ws, ws[3:] + ws[:3], swapped[:-2]]
        texts += [" ".join(prose(rnd, rnd.choice([0, 3, 60])).split() + e + prose(rnd, rnd.choice([0, 2, 60])).split()) for e in edits]
    texts += [" ".join(["la"] * 400), "la " * 9, prose(rnd, 300)]
    docs = list(enumerate(texts))
    want = every_window(docs, bench)
    found = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], r["similarity"]) for r in decontaminate.matches(make(spark, texts), spark.createDataFrame(bench, BENCH), radius=63).collect()}
    assert found == want and len(want) > 30
    assert (3 * 8, 3) in want and want[3 * 8, 3][2] >= 0.89  # 80 words, halves swapped
    # Pairs further apart than the radius are the only ones that may be missing.
    near = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(make(spark, texts), spark.createDataFrame(bench, BENCH)).collect()}
    assert near <= set(want) and len(near) >= 0.97 * len(want)


def test_hamming_blocks_cover(spark):
    """Fingerprints within the radius share a block."""
    rnd = random.Random(4)
    rows = []
    for _ in range(200):
        a, b = rnd.getrandbits(64), 0
        b = a
        for k in rnd.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << k
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    d = spark.createDataFrame(rows, "a long, b long")
    r = decontaminate.RADIUS
    assert d.where(F.size(F.array_intersect(decontaminate.blocks(F.col("a"), r), decontaminate.blocks(F.col("b"), r))) == 0).count() == 0


# 3 ------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    inverted = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, k in collections.Counter(j for x in s for j in inverted[x] if j > i).items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_join(spark):
    """Chains of edits (ends far apart), shared passages, copies, thresholds hit exactly."""
    rnd = random.Random(6)
    texts = [None, "", "a", "A", "a b c d", "a b c d e"]
    passage = prose(rnd, 60)
    for _ in range(12):
        w = prose(rnd, rnd.randint(20, 120)).split()
        for _ in range(rnd.randint(1, 12)):
            texts.append(" ".join(w))
            w = list(w)
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = f"edit{rnd.randint(0, 9)}"
    texts += [passage + " " + prose(rnd, rnd.randint(1, 40)) for _ in range(40)]
    for n in (8, 11, 14, 18, 25):  # a last word added: intersection over union n-4 over n-3 and the like
        w = prose(rnd, n).split()
        texts += [" ".join(w), " ".join(w + ["x"]), " ".join(w + ["x", "y"]), " ".join(w + ["x", "y", "z"])]
    rnd.shuffle(texts)
    want = brute_components(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(make(spark, texts).repartition(3)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in jaccard_join.clean(make(spark, texts)).select("doc_id").collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_null_and_equal_ids(spark):
    """Null and equal doc_ids with other texts are sets of their own; one text of each component stays."""
    rnd = random.Random(15)
    a, b, c = (prose(rnd, 60) for _ in range(3))
    near = a.rsplit(" ", 1)[0]
    rows = [(5, a), (5, b), (5, b), (None, near), (None, c), (None, c + " x"), (None, None), (None, ""), (2, b + " y"), (9, a.upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("rep", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jaccard_join.join(docs.repartition(3)).collect())
    assert got == sorted([("5", 56, 5), ("5", 56, 2), ("5", 56, 2), ("None", 55, 5), ("None", 56, None), ("None", 57, None), ("None", 0, None), ("None", 0, None), ("2", 57, 2), ("9", 56, 5)])
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.clean(docs).collect()]
    assert len(kept) == 5 and {(5, a), (2, b + " y"), (None, None), (None, "")} < set(kept) and {t for i, t in kept if i is None and t} < {c, c + " x"}


def test_jaccard_shingle_in_every_text(spark):
    """One passage in all texts, and one group of copies with a third of them: components by brute force."""
    rnd = random.Random(16)
    licence, page = prose(rnd, 12), prose(rnd, 80)
    texts = [f"{licence} {prose(rnd, rnd.randint(30, 60))}" for _ in range(300)] + [page] * 150
    texts += [" ".join(w if k != j else "edit" for k, w in enumerate(page.split())) for j in range(0, 80, 2)]
    rnd.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(make(spark, texts).repartition(4)).collect()}
    assert got == brute_components(list(enumerate(texts)))


def test_rest_without_stars(spark, monkeypatch):
    """Every link found by block skipping and pivots when star rounds see only the first leader."""
    rnd = random.Random(8)
    w = prose(rnd, 60).split()
    texts = []
    for k in range(25):
        texts.append(" ".join(w))
        w = list(w)
        w[(7 * k) % 60] = f"e{k}"
    want = brute_components(list(enumerate(texts)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.join(make(spark, texts), rounds=1).collect()}
    assert got == want


# 4 and 10 -----------------------------------------------------------------------------

ODD = "aAbBeEtThHéÉßñΣσςİ  \n\t\x1c\x85\xa0 .,!'’s'll'd019①Ⅷ<|endoftext|>漢字🙂ȩ́"


def odd_texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 80))) for _ in range(400)]
    return made + ["", " ", "x <|endoftext|>a<|startoftext|> the<|endoftext|>THE", "a" * 3000, "ab" * 2000, " lead", "trail ", "two  blanks", "line\n\nbreaks \n x"]


def test_token_counts(spark, sf):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r for r in token_counts.count(make(spark, texts), path).collect()}
    assert [got[i]["n_tokens"] for i in range(len(texts))] == want
    assert all(got[i]["n_bytes"] == len(t.encode()) and got[i]["over_limit"] == (w > 2048) for i, (t, w) in enumerate(zip(texts, want, strict=True)))


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_byte_bpe(spark, sf, name):
    import tiktoken

    path = queries.tokenizer(name)
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    texts = odd_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = byte_bpe.encode(make(spark, texts), path, PATTERN, keep_ids=True)
    got = {r["doc_id"]: r for r in out.collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t)
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert {r["doc_id"]: r["text"] for r in byte_bpe.decode(out, path).collect()} == dict(enumerate(texts))


def test_decode_before_encode(spark):
    """Decoding first, in the same workers, changes nothing."""
    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    ids = spark.createDataFrame([(1, [262, 995]), (None, None)], "doc_id long, ids array<int>")
    assert byte_bpe.decode(ids, path).count() == 2
    assert byte_bpe.encode(make(spark, ["the words of a text"] * 20).repartition(4), path, PATTERN).where("n_tokens = 5").count() == 20


def test_byte_bpe_blocks(spark, monkeypatch):
    """Many small blocks, buckets and slices give what one gives; another pattern is cut by itself."""
    import tiktoken

    path = queries.tokenizer("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(byte_bpe, "BLOCK_CHARS", 200)
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 50)
    texts = odd_texts()
    for pattern in (PATTERN, r"\p{N}|[^\p{N}]+"):
        enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
        got = {r["doc_id"]: r["ids"] for r in byte_bpe.encode(make(spark, texts).repartition(3), path, pattern, keep_ids=True).collect()}
        assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_replay_with_ranks_that_fall():
    """A merge may make a pair of lower rank than its own; the piece is then merged by definition."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 256, b"bc": 400, b"abab": 257}
    pieces = [b"abcab", b"ababab", b"xabcbc", b"bcabc", b"abab"]
    assert byte_bpe.Replay(ranks).encode(pieces) == [byte_bpe._merge_alone(p, ranks) if p not in ranks else [ranks[p]] for p in pieces]


# 5 ------------------------------------------------------------------------------------


def test_url_rules_joined_or_inline(spark):
    urls = [
        "http://Example.COM/en/x?y", "https://www.example.com/en/", "http://a.www.example.com/en/1#f", "http://badexample.com/en/", "ftp://x.net/es/q", "http://net/fr/", "http://a.com", "no scheme", None, "://", "http://h.org/en/\nz",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(0, 1), (4, 0), (10, None)], "page_id long, good int")
    a = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert a[0][:3] == ("example.com", "/en/x", "example.com/en/") and a[1][2] == a[2][2] == "www.example.com/en/" and a[3][2] == "com/" and a[4][2] == "net/es/"
    assert a[5][2] == "net/fr/" and a[6] == ("a.com", "", None, a[6][3]) and a[7][:3] == a[8][:3] == a[9][:3] == ("", "", None) and a[10][1] == "/en/\nz"
    table = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    assert a == {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels, table).collect()}


def test_url_rules_without_a_path(spark):
    """Such a rule is about its whole host, inline and joined."""
    pages = spark.createDataFrame([(0, "a.com", "/x"), (1, "b.a.com", "/"), (2, "a.com", ""), (3, "ba.com", "/x"), (4, "a.com", "/en/1")], "page_id long, host string, path string")
    rules = [("a.com", "block"), ("a.com/en/", "allow")]
    for r in (rules, spark.createDataFrame(rules, "rule string, verdict string")):
        got = {x["page_id"]: (x["rule"], x["rule_verdict"]) for x in url_filter.match_rules(pages, r).collect()}
        assert got == {0: ("a.com", "block"), 1: ("a.com", "block"), 2: (None, None), 3: (None, None), 4: ("a.com/en/", "allow")}


def test_url_rule_ties(spark):
    """Equal lengths: the longer host wins, then block; the same inline and joined."""
    pages = spark.createDataFrame([(1, "http://b.net/e/x"), (2, "http://c.net/e/x"), (3, "http://b.net/"), (None, "http://b.net/e/")], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("host", F.lit(1))
    labels = spark.createDataFrame([], "page_id long, good int")
    rules = [("net/e/", "block"), ("b.net/", "allow"), ("c.net/e/", "allow"), ("c.net/e/", "block")]
    want = {(1, "b.net/", "allow"), (2, "c.net/e/", "block"), (3, "b.net/", "allow"), (None, "b.net/", "allow")}
    for r in (rules, rules[::-1], spark.createDataFrame(rules, "rule string, verdict string")):
        assert {(x["page_id"], x["rule"], x["verdict"]) for x in url_filter.judge(pages, labels, r).collect()} == want
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_reputation_shrinks(spark):
    """One bad label blocks less than many; a new host takes its domain's mean."""
    rows, lab, i = [], [], 0
    for host, good, bad in [("good.a.net", 30, 0), ("bad.b.net", 0, 30), ("one.c.net", 0, 1), ("new.b.net", 0, 0), ("new.a.net", 0, 0), ("m.d.org", 20, 2)]:
        for k in range(max(1, good + bad)):
            rows.append((i, f"http://{host}/{k}"))
            if good + bad:
                lab.append((i, int(k < good)))
            i += 1
    r = {x["host"]: x for x in url_filter.reputation(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(lab, "page_id long, good int")).collect()}
    assert r["bad.b.net"]["bound"] < 0.1 < r["one.c.net"]["reputation"] and r["good.a.net"]["bound"] > 0.8
    assert r["new.b.net"]["reputation"] < 0.3 < r["new.a.net"]["reputation"]


# 6 ------------------------------------------------------------------------------------


def brute_dedup(docs, unit="sentence", least=None):
    """Removed words of (doc_id, text) by the definition: equal runs of whole units, those of sentences grown word by word."""
    least = least or (line_dedup.MIN_WORDS if unit == "sentence" else 1)
    docs = sorted(set(docs))
    words, cuts = [], []
    for _, t in docs:
        ws = list(re.finditer("[^ \t-\r]+", t))
        gap = [t[a.end() : b.start()] for a, b in zip(ws, ws[1:])]
        end = [g.count("\n") > (unit == "paragraph") or (unit == "sentence" and w[0][-1] in line_dedup.MARKS) for w, g in zip(ws, gap)]
        words.append([re.sub("[A-Z]", lambda m: m[0].lower(), w[0]) for w in ws])
        cuts.append([i + 1 for i, e in enumerate(end) if e] + [len(ws)] * bool(ws))
    seen, hits = {}, []
    for d, (ws, cs) in enumerate(zip(words, cuts)):
        for a in [0, *cs[:-1]] if cs else []:
            z = next((c for c in cs if c >= a + least), None) if len(ws) >= least else len(ws) if a == 0 else None
            if z is not None and (first := seen.setdefault(tuple(ws[a:z]), (d, a))) != (d, a):
                hits.append((d, a, z, *first))
    # Hits of one run first: growing starts from the run's ends.
    runs = {}
    for d, a, z, kd, ka in sorted(hits):
        mine = runs.setdefault((d, kd, a - ka), [])
        if mine and a <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], z)
        else:
            mine.append([a, z])
    gone = collections.defaultdict(set)
    for (d, kd, s), mine in runs.items():
        for a, z in mine:
            if unit != "sentence":
                gone[docs[d]] |= set(range(a, z))
                continue
            low = max([c for c in cuts[kd] if c < a - s], default=0)
            high = next((c for c in cuts[kd] if c >= z - s + least), len(words[kd]))
            while a - s > low and a > 0 and words[d][a - 1] == words[kd][a - s - 1]:
                a -= 1
            while z - s < high and z < len(words[d]) and words[d][z] == words[kd][z - s]:
                z += 1
            gone[docs[d]] |= set(range(a, z))
    return gone


def check_dedup(rows, out, unit="sentence"):
    """``out``: (doc_id, old text, new text, spans) of every row, held against brute force."""
    want = brute_dedup([(-(2**63) if i is None else i, t) for i, t in rows if t], unit)
    assert len(out) == len(rows)
    for i, old, new, spans in out:
        if not old:
            assert new == old and not spans
            continue
        starts = [m.start() for m in re.finditer("[^ \t-\r]+", old)]
        gone = {k for k, p in enumerate(starts) if any(x["start"] <= p < x["end"] for x in spans)}
        assert gone == want.get((-(2**63) if i is None else i, old), set()), (i, old)
        left, at = "", 0
        for x in spans:
            left, at = left + old[at : x["start"]], x["end"]
        assert left + old[at:] == new
        assert new.split() == [w for k, w in enumerate(re.findall("[^ \t-\r]+", old)) if k not in gone]
    return want


def dedup_rows(spark, rows, unit="sentence"):
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, old string").repartition(3)
    return [(r["doc_id"], r["old"], r["text"], r[line_dedup.REMOVED]) for r in line_dedup.dedup(docs, unit).collect()]


@pytest.mark.parametrize("unit", ["sentence", "line", "paragraph"])
def test_line_dedup(spark, unit):
    rnd = random.Random(9)
    a, b, short = prose(rnd, 60), prose(rnd, 12), "of the in"
    rows = [(0, f"{b}\n{a}"), (1, f"x\n\n{a.upper()}\n\ny"), (2, f"{short}\n\n{a}  "), (3, f"{a}\n\n{a}"), (4, short), (5, None), (6, ""), (7, "go on. " * 40), (8, "go on. " * 15)]
    out = {i: new for i, _, new, _ in check_and_rows(spark, rows, unit)}
    if unit == "line":
        assert out == {0: f"{b}\n{a}", 1: "x\n\ny", 2: f"{short}  ", 3: "", 4: "", 5: None, 6: "", 7: "go on. " * 40, 8: "go on. " * 15}


def test_short_units(spark):
    """Lines, paragraphs and whole texts of a few words go, all but the first; single short sentences stay unless asked for."""
    rnd = random.Random(22)
    nine = prose(rnd, 9)
    rows = [(i, f"{prose(rnd, 12)}\n{nine}\n{prose(rnd, 12)}") for i in range(50)] + [(100 + i, nine) for i in range(50)]
    for unit in ("line", "paragraph", "sentence"):
        out = {i: new for i, _, new, _ in check_and_rows(spark, rows, unit)}
        assert sum(nine in new for i, new in out.items() if i < 50) == (1 if unit == "line" else 50)
        assert [i for i in range(100, 150) if out[i]] == ([] if unit == "line" else [100])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs, "sentence", 1).collect()}
    assert [i for i, t in sorted(exact.items()) if nine in t] == [0]


def check_and_rows(spark, rows, unit):
    out = dedup_rows(spark, rows, unit)
    check_dedup(rows, out, unit)
    return out


def test_passages_in_the_middle_of_lines(spark):
    """Passages over 50 words, pasted anywhere, go whole; texts that share nothing stay."""
    rnd = random.Random(10)

    def text(n):
        ws = prose(rnd, n).split()
        return " ".join(w + rnd.choice(["", "", "", "", ".", ",", ".\n", "。"]) for w in ws)

    passages = [text(rnd.randint(51, 90)) for _ in range(12)]
    rows, planted = [], collections.Counter()
    for i in range(60):
        ws = text(rnd.randint(20, 200)).split(" ")
        for p in rnd.sample(range(12), rnd.choice([0, 1, 1, 2])):
            k = rnd.randrange(len(ws) + 1)
            ws[k:k] = [passages[p]]
            planted[i] += len(passages[p].split())
        rows.append((i, " ".join(ws)))
    out = check_and_rows(spark, rows, "sentence")
    lost = {i: len(old.split()) - len(new.split()) for i, old, new, _ in out}
    assert all(lost[i] == 0 for i in range(60) if not planted[i])
    assert all(lost[i] >= 0.95 * planted[i] for i in range(40, 60))


def test_line_dedup_null_and_equal_ids(spark):
    """Null ids with other texts are other documents, the smallest; equal ids too; equal rows are one document."""
    rnd = random.Random(12)
    a, b = prose(rnd, 30), prose(rnd, 30)
    rows = [(None, f"{a}\nx"), (None, f"y\n{a}"), (None, b), (1, a), (1, b), (1, b), (2, f"{b}\nend")]
    out = check_and_rows(spark, rows, "sentence")
    assert sorted((i is not None, i or 0, new) for i, _, new, _ in out) == sorted([(False, 0, f"{a}\nx"), (False, 0, "y"), (False, 0, b), (True, 1, ""), (True, 1, ""), (True, 1, ""), (True, 2, "end")])


def test_line_dedup_on_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_and_rows(spark, rows, "sentence")


# 7 ------------------------------------------------------------------------------------


def test_warc_with_magic_in_payloads(spark, tmp_path):
    evil = "<html>WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n tail WARC/1.0\r\n"
    rows = [(1, "http://a/", evil), (2, None, None), (3, "x\r\ny", "é" * 700), (4, "u", "é" * 700), (5, "u", "short"), (6, "u", "short"), (None, "n", "z"), (7, "q", "WARC/1.0\r\n"), (8, "q", evil * 30), (9, "q", evil * 30)]
    rows += [(100 + i, "u", evil + str(i)) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"), records_per_file=40)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # many splits a file
    try:
        got = {r["page_id"]: r for r in warc.records(spark, str(tmp_path / "w"), keep_payload=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i]["digest"], got[i]["payload_bytes"]) == (hashlib.sha1(data).hexdigest(), len(data))
        assert got[i]["payload"] == ((html or "") if got[i]["type"] == "response" else None)
    assert (got[3]["type"], got[3]["refers_to"]) == ("revisit", 4) and (got[8]["type"], got[8]["refers_to"]) == ("revisit", 9) and got[5]["type"] == got[6]["type"] == "response"


def test_warc_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    assert warc.records(spark, str(tmp_path / "w")).count() == 0


def test_reach():
    off, nxt = np.array([0, 10, 25, 30, 50]), np.array([25, 20, 50, 50, 60])
    assert warc.reach(off, nxt).tolist() == [True, False, True, False, True]
    assert warc.reach(np.array([5]), np.array([9])).tolist() == [False]


# 8 ------------------------------------------------------------------------------------


def test_classifier_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").selectExpr("doc_id", "quality as label")
    got = quality_classifier.classify(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.predicted == held.label).mean() > 0.95 and got.score.between(0, 1).all()


def test_trees_find_an_interaction():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality_classifier.FEATURES)))
    x[:, :2] = rng.random((4000, 2))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_classifier.train(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.93


def naive_additive(x, y, rounds):
    """Cyclic boosting by its definition, every leaf summed from rows; scores of the rows."""
    q = quality_classifier
    rate = (sum(y) + 0.5) / (len(y) + 1)
    raw = [math.log(rate / (1 - rate))] * len(y)
    cut = lambda c, bins: sorted(set(np.quantile(c, np.arange(1, bins) / bins).tolist()))
    place = lambda edges, v: sum(e <= v for e in edges)
    cols = list(range(len(x[0])))
    edges = [cut([r[f] for r in x], q.BINS) for f in cols]
    at = [[place(edges[f], r[f]) for r in x] for f in cols]
    prob = lambda: [1 / (1 + np.exp(-v)) for v in raw]

    def gain(rows, p):
        g, h = sum(y[i] - p[i] for i in rows), sum(p[i] * (1 - p[i]) for i in rows)
        return g * g / (h + 1), g / (h + 1)

    def best(rows, where, p):
        """The best cut of some rows by their bins: gain over the whole, first bin of the right side."""
        whole, found = gain(rows, p)[0], (0.0, None)
        low, high = min(where), max(where)
        for c in range(low + 1, high + 1):
            left, right = [i for i in rows if where[i] < c], [i for i in rows if where[i] >= c]
            if min(len(left), len(right)) >= q.LEAST_LEAF:
                d = gain(left, p)[0] + gain(right, p)[0] - whole
                if d > found[0] + 1e-9:
                    found = (d, c)
        return found

    for _ in range(rounds):
        for f in cols:
            p, leaves = prob(), [list(range(len(y)))]
            for _ in range(3):
                d, c, k = max(((*best(rows, at[f], p), k) for k, rows in enumerate(leaves)), key=lambda t: (t[0], t[2]))
                if not c:
                    break
                rows = leaves[k]
                leaves[k : k + 1] = [[i for i in rows if at[f][i] < c], [i for i in rows if at[f][i] >= c]]
            for rows in leaves:
                step = gain(rows, p)[1] if rows else 0
                for i in rows:
                    raw[i] += q.RATE * step
    return raw


def test_tables_against_naive_boosting(monkeypatch):
    """Per-feature tables of a small fit equal boosting that sums every leaf from its rows."""
    monkeypatch.setattr(quality_classifier, "ROUNDS", 4)
    monkeypatch.setattr(quality_classifier, "PAIRS", 0)
    monkeypatch.setattr(quality_classifier, "BINS", 8)
    rng = np.random.default_rng(4)
    x = rng.random((120, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.random(120) > 0.8).astype(float)
    m = quality_classifier.train(x, y)
    assert not m.pairs and np.allclose(m.raw(x), naive_additive(x.tolist(), y.tolist(), 4), atol=1e-9)


def test_classifier_with_one_kind_of_label(spark):
    docs = make(spark, ["a b", "", None, "c"])
    assert quality_classifier.classify(docs, spark.createDataFrame([(0, 1), (3, None)], "doc_id long, label int")).where("score > 0.5").count() == 4


# 9 ------------------------------------------------------------------------------------


def test_line_rules(spark):
    rnd = random.Random(11)
    footer = prose(rnd, 20)
    texts = [f"{prose(rnd, 60)}\n{footer}" for _ in range(35)] + [f"{prose(rnd, 12)}\n{footer}" for _ in range(5)] + [f"{footer}\nsame"] * 50
    got = {r["doc_id"]: r for r in quality_rules.judge(make(spark, texts)).collect()}
    assert got[0]["removed_words"] == 0 and all(got[i]["kept"] and got[i]["removed_words"] == 20 for i in range(1, 35))
    assert not any(got[i]["kept"] for i in range(35, 40))
    clean = {r["doc_id"]: r["text"] for r in quality_rules.clean(make(spark, texts)).collect()}
    assert clean[0] == texts[0] and clean[1] == texts[1].split("\n")[0] and 35 not in clean
    copies = quality_rules.judge(make(spark, [prose(rnd, 50)] * 100)).where("kept").count()
    assert copies == 100  # copies of one text are one text


def test_rules_tell_rows_apart(spark):
    """Null and equal doc_ids: no row loses another row's lines or is rejected for them."""
    rnd = random.Random(13)
    footer = prose(rnd, 11)
    own = [prose(rnd, 15), prose(rnd, 40)]
    rows = [(i, f"{prose(rnd, 60)}\n{footer}", "en", "s", 1) for i in range(40)]
    rows += [(None, own[0], "en", "s", 1), (None, f"{own[1]}\n{footer}", "en", "s", 1), (50, own[0], "en", "s", 1), (50, f"{own[1]}\n{footer}", "en", "s", 1), (50, f"{own[1]}\n{footer}", "en", "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [(r["doc_id"], r["n_words"], r["removed_words"], r["kept"]) for r in quality_rules.judge(docs).collect() if r["doc_id"] in (None, 50, 0)]
    # The null doc_id is the smallest, so its rows keep the line; doc 0 loses it.
    assert collections.Counter(got) == collections.Counter([(0, 71, 11, True), (None, 15, 0, True), (None, 51, 0, True), (50, 15, 0, True), (50, 51, 11, True), (50, 51, 0, True)])
    text = collections.Counter((r["doc_id"], r["source"], r["text"]) for r in quality_rules.clean(docs).collect() if r["doc_id"] in (None, 50))
    assert text == collections.Counter([(None, "s", own[0]), (None, "s", f"{own[1]}\n{footer}"), (50, "s", own[0]), (50, "s", own[1]), (50, "t", f"{own[1]}\n{footer}")])


def test_decontaminate_tells_rows_apart(spark):
    """Null and equal doc_ids with other texts: each is found, the others stay."""
    rnd = random.Random(14)
    item = prose(rnd, 30)
    clean = [prose(rnd, 40) for _ in range(4)]
    rows = [(None, clean[0]), (None, f"{clean[1]} {item}"), (None, clean[2]), (7, item), (7, clean[3]), (7, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, item)], BENCH)
    assert sorted((str(r["doc_id"]), r["start_word"]) for r in decontaminate.matches(docs, bench).collect()) == [("7", 0), ("None", 40)]
    assert collections.Counter(r["text"] for r in decontaminate.clean(docs, bench).collect()) == collections.Counter([clean[0], clean[2], clean[3]])


# pipeline -----------------------------------------------------------------------------


def brute_quality(rows, max_docs=30):
    """doc_id -> text of what the rules keep: base rules on one text, then lines in more than ``max_docs`` texts of a host."""
    words = lambda t: [w for w in re.split("[ \t-\r]+", t or "") if w]
    norm = lambda line: " ".join(words(re.sub("[A-Z]", lambda m: m[0].lower(), line)))
    texts, first = collections.defaultdict(set), {}
    for i, host, t in rows:
        for line in (t or "").split("\n"):
            if n := norm(line):
                texts[host, n].add(t)
                first[host, n] = min(i, first.get((host, n), i))
    out = {}
    for i, host, t in rows:
        ws = words(t)
        at = collections.defaultdict(list)
        for k in range(len(ws) - 4):
            at[tuple(ws[k : k + 5])].append(k)
        repeated = {k + j for ks in at.values() if len(ks) > 1 for k in ks for j in range(5)}
        if len(ws) < 10 or 100 * len(repeated) > 20 * len(ws):
            continue
        lines = t.split("\n")
        cut = [bool(norm(x)) and len(texts[host, norm(x)]) > max_docs and first[host, norm(x)] != i for x in lines]
        if 100 * sum(len(words(x)) for x, c in zip(lines, cut) if c) <= 50 * len(ws):
            out[i] = "\n".join(x for x, c in zip(lines, cut) if not c)
    return out


def test_quality_against_brute_force(spark):
    """Lines above the limit, depleted texts, repeats and short texts of a hot host."""
    rnd = random.Random(41)
    lines = [prose(rnd, rnd.randint(3, 12)) for _ in range(40)]
    rows = []
    for i in range(360):
        own = [prose(rnd, rnd.randint(2, 30)) for _ in range(rnd.choice([0, 1, 2]))]
        rows.append((i, rnd.choice(["hot", "hot", "hot", "b"]), "\n".join(own + rnd.sample(lines[: rnd.choice([3, 40])], rnd.choice([0, 1, 3])) + [prose(rnd, 6)] * rnd.choice([0, 0, 3]))))
    docs = spark.createDataFrame([(i, t, "en", h, len(t)) for i, h, t in rows], SCHEMA)
    want = brute_quality(rows)
    assert {r["doc_id"]: r["text"] for r in quality_rules.clean(docs).collect()} == want
    assert 0 < len(want) < len(rows) and any(want[i] != t for i, _, t in rows if i in want)


def test_pipeline(spark, sf):
    """run() against the stages' meaning, computed without Spark where that is short."""
    import tiktoken

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    d0 = spark.read.parquet(f"{sf}/documents.parquet")
    d1 = stages["quality rules"](spark, d0, sf).collect()
    assert {r["doc_id"]: r["text"] for r in d1} == brute_quality([(r["doc_id"], r["source"], r["text"]) for r in docs.values()])
    want = brute_components([(r["doc_id"], r["text"]) for r in d1])
    keep = {i for i, (_, c) in want.items() if i == c}
    old = {r["doc_id"]: r["text"] for r in d1 if r["doc_id"] in keep}
    gone, text = brute_dedup(list(old.items())), {}
    for i, t in old.items():
        text[i] = [w for k, w in enumerate(re.findall("[^ \t-\r]+", t)) if k not in gone.get((i, t), ())]
    d3 = stages["substring dedup"](spark, d0.where(F.col("doc_id").isin([-1])).union(spark.createDataFrame([(i, t, "", "", 0) for i, t in old.items()], SCHEMA)), sf).collect()
    assert {r["doc_id"]: re.findall("[^ \t-\r]+", r["text"]) for r in d3} == text
    text = {r["doc_id"]: r["text"] for r in d3}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = {d for d, _ in every_window([(i, t) for i, t in text.items() if t], bench)}
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(queries.tokenizer("byte_bpe_50k.tiktoken")), special_tokens={})
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert out == {i: len(enc.encode_ordinary(t)) for i, t in text.items() if i not in bad}
    assert 0.5 * len(docs) < len(out) < len(docs)


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, equal ids, clashing columns: one row per kept document."""
    rnd = random.Random(17)
    good = [prose(rnd, 60) for _ in range(6)]
    long, item = "\n".join(prose(rnd, 40) for _ in range(300)), prose(rnd, 30)
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, good[0]), (5, good[0].upper()), (None, good[1]), (None, good[2]), (None, None), (6, good[3]), (6, good[4]), (7, long), (8, f"{good[5]}\n{item}"), (9, "too short"), (10, good[5]), (10, good[5]),
    ]
    docs = spark.createDataFrame([(i, t, "en", None if t is None else "s", None) for i, t in rows], SCHEMA)
    for c in ("key", "row", "label", "kept", "blob", "cut", "__r_doc_id"):
        docs = docs.withColumn(c, F.lit("clash"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.load_ranks(queries.tokenizer("byte_bpe_50k.tiktoken")), special_tokens={})
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # Document 8 holds the passage first, so 10 and its copy lose theirs; then 8 goes for its benchmark item.
    want = [(4, good[0]), (None, good[1]), (None, good[2]), (6, good[3]), (6, good[4]), (7, long), (10, ""), (10, "")]
    assert got == sorted((str(i), len(enc.encode_ordinary(t))) for i, t in want)


def test_pipeline_on_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], BENCH).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
