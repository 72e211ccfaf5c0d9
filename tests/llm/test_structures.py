"""Conversation trie, Merkle manifest and sharding against brute force, the oracle and odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import conversation_trie as C
from pagemill.llm import merkle, queries, sharding
from pagemill.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string, key int, `__n` string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash int, path string"


def plain_trie(rows):
    """All nodes by dictionaries over whole sequences."""
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t is not None, t or 0, r or "", x or ""))
    conv = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, v in conv.items():
        h = zlib.crc32(str(c).encode()) % 4
        v = conv.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
            if d:
                kids[tuple(v[: d - 1])].add(tuple(v[:d]))
        ends[tuple(v)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        words = len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members[k]) - 1) * words
            leaves[k[:d]] += k not in kids
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k] if k in ends else []))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids[k]) if k in kids else 0, leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie_of(turns):
    return sorted(tuple(r) for r in C.trie(C.rebuilt(stored(C.sequences(turns), "c"))).collect())


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_conversation_trie(spark, sf)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(tuple(r) for r in out.collect()) == plain_trie(rows)


@pytest.mark.parametrize("kind", ["mixed", "long", "copies"])
def test_trie_over_many_blocks(spark, monkeypatch, kind):
    """Nodes, chains and groups of copies over several tiny blocks."""
    for name, value in (("BLOCK_BYTES", 250), ("LEAST_BLOCKS", 2), ("PIECE", 7)):
        monkeypatch.setattr(C, name, value)
    r, rows = random.Random(kind), []
    for c in range(-20, 120):
        if r.random() < 0.1:
            continue
        for t in range({"mixed": r.choice([1, 1, 2, 3, 5, 9]), "long": r.choice([1, 2, 30]), "copies": 1}[kind]):
            odd = kind != "copies" and r.random() < 0.3
            rows.append((c, t if t or r.random() > 0.02 else None, r.choice(["u", None, ""]) if odd else "u", r.choice(["a b", " c ", None, "d　e f"]) if odd else "same x", 1, "x"))
    got = trie_of(spark.createDataFrame(rows, TURNS))
    assert got == plain_trie([x[:4] for x in rows])


def test_trie_odd_rows(spark):
    rows = [(None, 0, "u", "lost", 0, "")]
    assert trie_of(spark.createDataFrame(rows, TURNS)) == []
    assert trie_of(spark.createDataFrame([], TURNS)) == []
    # A conversation of fewer turns than its head, without a base: turnless, and the root's only member.
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4 == 3)
    rows = [(c, 0, "u", "gone", 0, ""), (c, 0, "u", "gone", 0, "")]
    assert trie_of(spark.createDataFrame(rows, TURNS)) == plain_trie([x[:4] for x in rows]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # Repeated turns and equal numbers; a very long text.
    rows = [(20, 0, "u", "a", 0, ""), (20, 0, "u", "a", 0, ""), (20, 1, None, "w " * 300_000, 0, ""), (40, 0, "u", "a", 0, "")]
    assert trie_of(spark.createDataFrame(rows, TURNS)) == plain_trie([x[:4] for x in rows])


def test_minima():
    """Searches over blocks against a plain loop."""
    r = random.Random(3)
    for n in (1, 2, 3, 8, 37):
        rows = [{"least": r.choice([-1, 0, 1, 2, 5]), "low": r.randrange(100), "starts": r.random() < 0.5, **dict.fromkeys(C.SUMS, 1)} for _ in range(n)]
        m = C.Minima(rows)
        for b in range(n):
            for v in range(7):
                assert m.nearest(b, v, 1) == next((i for i in range(b + 1, n) if rows[i]["least"] < v), n)
                left = next((i for i in range(b - 1, -1, -1) if rows[i]["least"] < v), None)
                assert left is None or m.nearest(b, v, -1) == left
            for z in range(b, n + 1):
                assert m.between(b, z) == {**dict.fromkeys(C.SUMS, z - b), "low": min([C.NO_ID, *(x["low"] for x in rows[b:z])])}


def H(*xs):
    return hashlib.sha256("".join(xs).encode()).hexdigest()


def plain_manifest(rows, fanout=16):
    """Leaves, roots, proofs and folds by lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t: H(*map(field, (d[0], d[3], d[2], d[4], t)))
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def tree(hashes):
        at, paths = [[i] for i in range(len(hashes))], [[] for _ in hashes]
        while len(hashes) > 1:
            up, members = [], []
            for k in range(0, len(hashes), fanout):
                run = hashes[k : k + fanout]
                for j in range(len(run)):
                    for i in at[k + j]:
                        paths[i].append((run[:j], run[j + 1 :]))
                up.append(H(*run))
                members.append([i for m in at[k : k + fanout] for i in m])
            hashes, at = up, members
        return hashes[0], paths

    by = defaultdict(list)
    for d in rows:
        by[d[3]].append((d[0] is not None, d[0] or 0, leaf(d, d[1]), d))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    root, over = tree([t[0] for t in trees]) if trees else ("", [])
    out = []
    for s, (sub, paths), top in zip(sources, trees, over, strict=True):
        for (_, _, h, d), path in zip(sorted(by[s], key=lambda x: x[:3]), paths, strict=True):
            path = path + top
            claimed = leaf(d, lower(d[1])) if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 else h
            for b, a in path:
                claimed = H(*b, claimed, *a)
            out.append((d[0], h, sub, root, H(*[x for b, a in path for x in (*b, *a)]), claimed, claimed == root))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def manifest_of(docs, fanout=16):
    return sorted((tuple(r) for r in merkle.verify(merkle.prove(docs, merkle.lowered(), fanout)).select(*MANIFEST).collect()), key=str)


def test_manifest_query(spark, sf, same_as_oracle):
    same_as_oracle(queries.op12_merkle_manifest(spark, sf), queries.ORACLES["op12_merkle_manifest"])
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, sf).collect()), key=str)
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_odd_rows(spark):
    """Hot, lone, null and many sources of uneven depth, repeated rows, nulls, very long texts."""
    rows = [(i, f"Text {i}", "en", "hot", i, 1, "p") for i in range(90)] + [(i, "A", None, f"s{i}", None, 1, "p") for i in range(40)]
    rows += [(None, None, None, None, None, 1, "p"), (None, "", None, None, None, 1, "p"), (5, "B", "x", None, 1, 1, "p"), (5, "B", "x", None, 1, 1, "p"), (7, "Ä" * 200_000, "é", "Ω", 3, None, None)]
    for fanout in (16, 3):
        assert manifest_of(spark.createDataFrame(rows, DOCS), fanout) == plain_manifest([x[:5] for x in rows], fanout)


def test_manifest_small(spark):
    assert manifest_of(spark.createDataFrame([], DOCS)) == []
    one = [(1, "T", "en", "s", 1, 1, "p")]
    assert manifest_of(spark.createDataFrame(one, DOCS)) == plain_manifest([x[:5] for x in one])
    lone = [(k, "T", "en", f"s{k}", 1, 1, "p") for k in range(3)]
    assert manifest_of(spark.createDataFrame(lone, DOCS)) == plain_manifest([x[:5] for x in lone])


def test_shards_query(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = queries.op13_sharding(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int", "virtual_slot": "int", "map_version": "int"}
    rows = out.collect()
    assert len(rows) == len(docs)
    load, places, shard_of = defaultdict(int), defaultdict(list), {}
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    assert set(load) <= set(range(40))
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    # No single slot can move to even two shards out.
    weight = defaultdict(int)
    for r in rows:
        weight[r["virtual_slot"]] += r["size"]
    for s in load:
        assert load[s] - min(load.values()) <= min(w for k, w in weight.items() if shard_of[k] == s)


def test_shards_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None, 1, "x"), (None, "", None, None, None, 1, "x"), (1, "same", None, None, None, 1, "x"), (1, "same", None, None, None, 1, "x"), (2, "L" * 1_000_000, None, None, None, 1, "x")]
    path = str(tmp_path / "maps")
    got = sharding.shard(spark.createDataFrame(rows, DOCS), 4, path).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 16), (0, 16), (1, 20), (1, 20), (2, 1_000_016)]
    assert len({(r["shard"], r["slot"]) for r in got}) == 5
    assert sorted(os.listdir(path)) == ["version=000000", "version=000001"]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sharding.save_map(spark, path, 1, [0])
    assert sharding.shard(spark.createDataFrame([], DOCS), 4).count() == 0


def test_maps():
    """Edits move few slots, and those of growth only to the new shard."""
    r = random.Random(1)
    weight = {k: r.randrange(1, 1000) for k in range(2_000)}
    first = sharding.even(10, 2_000)
    new = sharding.rebalance(first, weight, 10)
    load = [sum(w for k, w in weight.items() if new[k] == s) for s in range(10)]
    assert all(load[s] - min(load) <= min(w for k, w in weight.items() if new[k] == s) for s in range(10))
    assert max(load) - min(load) < 0.001 * max(load)
    assert sum(a != b for a, b in zip(first, new, strict=True)) < 200
    assert sharding.rebalance(new, weight, 10) == new
    grown = sharding.grow(new, weight, 10)
    assert {b for a, b in zip(new, grown, strict=True) if a != b} == {10}
    load = [sum(w for k, w in weight.items() if grown[k] == s) for s in range(11)]
    assert max(load) - min(load) < 0.1 * max(load)


def test_numbering_is_dealt(spark):
    """A hot key is numbered over several ranges."""
    from pagemill.llm.common import Workspace, numbered

    space = Workspace(spark)
    df = space.store(spark.range(5_000).select((F.col("id") % 7 == 0).alias("k"), (-F.col("id")).alias("v")), "in")
    rows = numbered(space, df, ["k"], ["v"], "out").collect()
    for k in (True, False):
        mine = sorted(r["v"] for r in rows if r["k"] == k)
        assert sorted((r["idx"], r["v"]) for r in rows if r["k"] == k) == list(enumerate(mine))
        assert {r["n"] for r in rows if r["k"] == k} == {len(mine)}
