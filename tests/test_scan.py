"""Scans of long logs, sweeps of ranges, matching in runs and blocks of figures against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pagemill.operators import events as E
from pagemill.operators import scoring as S
from pagemill.operators.scan import scan
from pagemill.sources import detection_log as G


def plain_scan(rows):
    """(section, seq, value) -> last, last_before, next, count, count_before by loops."""
    out = {}
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for i, (_, n, _) in enumerate(mine):
            before, upto, on = ([x[2] for x in part if x[2] is not None] for part in (mine[:i], mine[: i + 1], mine[i:]))
            out[s, n] = (upto[-1] if upto else None, before[-1] if before else None, on[0] if on else None, len(upto), len(before))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_scan_against_loops(spark, parts):
    """One log over many parts, with long stretches without a value, and short ones beside it; no section is null."""
    rnd = random.Random(parts)
    rows = [("hot", i, rnd.randrange(100) if rnd.random() < 0.004 else None) for i in range(3_000)]
    rows += [(f"s{k}", i, rnd.choice([None, None, i])) for k in range(20) for i in range(rnd.randint(1, 9))] + [(None, 1, 5), (None, 2, None)]
    rnd.shuffle(rows)
    v = F.col("v")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        d = scan(spark.createDataFrame(rows, "s string, n int, v int"), ["s"], ["n"], a=("last", v), b=("last_before", v), c=("next", v), d=("count", v), e=("count_before", v))
        got = {(r["s"], r["n"]): (r["a"], r["b"], r["c"], r["d"], r["e"]) for r in d.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert got == plain_scan(rows)


def test_scan_keeps_other_columns(spark):
    d = spark.createDataFrame([("a", 1, 4, "x")], "s string, n int, v int, w string")
    out = scan(d, ["s"], ["n"], v=("count", F.col("v")), m=("last", F.col("w")))
    assert out.columns == ["s", "n", "w", "v", "m"] and out.first()[:] == ("a", 1, "x", 1, "x")
    assert scan(d.where("n > 1"), ["s"], ["n"], m=("next", F.col("w"))).count() == 0
    with pytest.raises(ValueError, match="unknown kinds"):
        scan(d, ["s"], ["n"], m=("first", F.col("w")))


def test_masks_by_sweep(spark):
    """Overlapping, nested, equal, touching, empty and one-page ranges; pages and files without any."""
    rnd = random.Random(4)
    pages = [(f, p, rnd.random() < 0.5) for f in ("a", "b", "c") for p in range(1, 60) for _ in range(rnd.choice([1, 1, 2]))] + [("a", None, True), (None, 3, True)]
    masks = [("a", 3, 9), ("a", 5, 6), ("a", 9, 12), ("a", 5, 6), ("a", 20, 20), ("a", 40, 30), ("b", 1, 60), ("b", 10, 12), ("d", 1, 9), ("c", 58, 99), ("a", None, 50)]
    for _ in range(8):
        lo = rnd.randint(1, 60)
        masks.append(("c", lo, lo + rnd.randint(-2, 5)))
    m = spark.createDataFrame(masks, "file string, lo int, hi int")
    got = S.drop_masked(spark.createDataFrame(pages, "file string, page int, x boolean"), m).collect()
    free = lambda f, p: not any(g == f and p is not None and lo is not None and lo <= p <= hi for g, lo, hi in masks)
    assert sorted((r[:] for r in got), key=str) == sorted((r for r in pages if free(r[0], r[1])), key=str)
    assert got[0].__fields__ == ["file", "page", "x"]


def plain_tolerance(truth, pred, tol):
    out = {}
    for f in {x[0] for x in truth + pred}:
        t, free = sorted({p for g, p in truth if g == f}), {p for g, p in pred if g == f}
        n, tp = len(free), 0
        for p in t:
            near = [x for x in free if abs(x - p) <= tol]
            if near:
                free.remove(min(near, key=lambda x: (abs(x - p), x)))
                tp += 1
        out[f] = (tp, n - tp, len(t) - tp)
    return out


def test_tolerance_in_runs(spark):
    """Dense and sparse files, ties, chains of truths that take each other's pages."""
    rnd = random.Random(6)
    truth, pred = [], []
    for f in range(60):
        share = rnd.choice([0.05, 0.3, 0.9])
        truth += [(f, p) for p in range(1, 80) if rnd.random() < share]
        pred += [(f, p) for p in range(1, 80) if rnd.random() < share]
    truth += [(100, 5), (100, 5)]
    pred += [(101, 5)]
    t, p = (spark.createDataFrame(x, "file int, page int") for x in (truth, pred))
    for tol in (0, 1, 3):
        got = {r["file"]: (r["tp"], r["fp"], r["fn"]) for r in S.tolerance_match(t, p, tol).collect()}
        assert got == plain_tolerance(truth, pred, tol)


def test_rotation_blocks(spark):
    """Figures by their section: equal lines elsewhere, blocks without figures, figures out of turn, a later block."""
    logs = {
        "same text": ["BOUNDARY DETECTION", "Precision : 37.0%", "Recall : 50.0%", "F1 score : 9.5%", "PAGE ROTATION", "TP=1", "Precision : 37.0%", "Recall : 29.8%", "F1 score : 33.0%"],
        "rotation first": ["PAGE ROTATION", "Precision : 1.5%", "Recall : 2%", "F1 score : 3%", "BOUNDARY DETECTION", "Precision : 8%", "Recall : 9%", "F1 score : 10%"],
        "last block": ["PAGE ROTATION", "Precision : 1%", "Recall : 2%", "F1 score : 3%", "PAGE ROTATION", "Precision : 4%", "PAGE ROTATION", "note"],
        "out of turn": ["PAGE ROTATION", "Recall : 2%", "Precision : 1%", "Recall : 5%", "F1 score : 3%"],
        "none": ["Precision : 1%", "BOUNDARY DETECTION", "Precision : 1%", "see PAGE ROTATION", "Precision : 2%"],
    }
    rows = [(s, i, f"12:00:0{i} {' ' * 3}{x}") for s, lines in logs.items() for i, x in enumerate(lines)]
    got = {r["source"]: r[1:] for r in E.rotation_blocks(G.parse_overall(spark.createDataFrame(rows, "source string, line_no int, line string"))).collect()}
    assert got == {"same text": (37.0, 29.8, 33.0), "rotation first": (1.5, 2.0, 3.0), "last block": (4.0, None, None), "out of turn": (1.0, None, None)}
