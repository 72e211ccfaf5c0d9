"""Demand-driven rounds: the questions of a page-by-page fold and no others, the same decision."""

import random

from pyspark.sql import functions as F

from pagemill.functions import verdicts as V
from pagemill.plans import decision as D
from pagemill.plans import demand
from pagemill.sources.committed import Cache


def lazy_fold(rows, total):
    """What a fold asks as it goes: (n, kind) beyond each page's end and style."""
    starts, chain, asked = [1], False, set()
    for n in range(1, total):
        v = rows[n]

        def ask(kind, n=n, v=v):
            asked.add((n, kind))
            return v[demand.KINDS[kind][0]]

        end, conf, sig, sp = v["is_end"], v["conf"], v["signal"], v["signal_page"]
        e = n if not end else sp - 1 if sig in V.START_SIGNALS else sp
        if end and sig == "titled_id_header":
            name = {n - 1: "prev", n: "cur", n + 1: "next"}
            seen = ask(f"title_{name[sp]}") + v[f"id_{name[sp]}"]
            if seen == 1:
                conf = min(conf, 0.6)
            elif seen == 0:
                other = [p for p in (n - 1, n, n + 1) if p >= 1 and p != sp and ask(f"title_{name[p]}")]
                if len(other) == 1:
                    e, sp = other[0] - 1, other[0]
                    if not v[f"id_{name[other[0]]}"]:
                        conf = min(conf, 0.6)
                else:
                    end, e = False, n
        if end and sig in V.END_SIGNALS and sp == n + 1 and ask("self_contained_next"):
            e = n
        if sig in V.CAPPED_SIGNALS:
            conf = min(conf, 0.6)
        if end and "appendix" in sig:
            if not chain:
                end = ask("standalone")
                chain = not end
            else:
                end = n > 1 and ask("starts_new")
        elif end:
            chain = False
        if end and sig in V.SIGNOFF_SIGNALS and e == n:
            end = ask("next_starts")
            conf = (conf + v["next_conf"]) / 2 if end else conf
        if end and conf < 0.75 and sig not in V.UNCONFIRMED_OK:
            end = ask("confirmed")
        if end:
            new = e + 1
            if new > total:
                if ask("self_contained_next"):
                    new = n + 1
                else:
                    end = False
            if new <= total:
                starts.append(new)
        if n > 1 and n not in starts:
            p = rows[n - 1]
            if (end or p["letterhead_match"] is False or p["layout_prev"] != p["layout_curr"]) and ask("starts_new"):
                starts.append(n)
    return asked


def test_questions_are_the_folds(spark, tmp_path):
    rnd = random.Random(11)
    signals = V.START_SIGNALS + V.END_SIGNALS * 2 + ["titled_id_header"] * 2 + ["appendix_mid_doc"] * 5
    rows, totals, want = [], [], set()
    for f in range(250):
        total, pages = rnd.randint(1, 10), {}
        totals.append((str(f), total))
        for n in range(1, total):
            v = {"file": str(f), "n": n, "total_pages": total, "is_end": rnd.random() < 0.7, "signal": rnd.choice(signals), "signal_page": rnd.choice([p for p in (n - 1, n, n + 1) if p >= 1])}
            v |= {c: rnd.randint(0, 20) / 20 if c.endswith("conf") else rnd.random() < 0.5 for cols in demand.KINDS.values() for c in cols} | {"conf": rnd.randint(0, 20) / 20}
            v |= {"letterhead_match": rnd.choice([True, False, None]), "layout_prev": rnd.choice(["form", "table", None]), "layout_curr": rnd.choice(["form", "table", None])}
            if n == 1:
                v["title_prev"] = v["id_prev"] = False
            pages[n] = v
            rows.append(v)
        want |= {(str(f), *x) for x in lazy_fold(pages, total)}
    names = [x.split()[0] for x in D.VERDICTS.split(", ")]
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], D.VERDICTS).cache()
    told = {(r["file"], r["n"], k): (r[cols[0]], r[cols[1]] if cols[1:] and cols[1].startswith("id_") else None, r[cols[1]] if cols[1:] and cols[1].endswith("conf") else None) for r in rows for k, cols in demand.KINDS.items()}
    batches = []

    def provider(asked):
        batch = [tuple(r) for r in asked.select("file", "n", "kind").collect()]
        batches.append(batch)
        return spark.createDataFrame([(*q, *told[q]) for q in batch], "file string, n int, kind string, flag boolean, extra boolean, conf double")

    cache = Cache(spark, str(tmp_path / "c"), "flag boolean, extra boolean, conf double", buckets=4)
    t = spark.createDataFrame(totals, "file string, total_pages int")
    got = demand.decide(df, t, provider, cache)
    asked = [q for b in batches for q in b]
    assert len(asked) == len(set(asked)) and set(asked) == want  # each once, and only those
    flat = lambda d: sorted((r["file"], r["page"], round(r["confidence"], 9), r["signal"]) for r in d.collect())
    assert flat(got) == flat(D.boundaries(df, t))
    assert cache.rows.count() == len(want)
    # A second run has all it needs.
    _, rounds = demand.settle_all(df, provider, cache)
    assert rounds == 0 and sum(map(len, batches)) == len(want)
    df.unpersist()


def test_questions_of_one_file(spark):
    """Nothing to ask where no page ends or breaks the style; an empty table asks nothing."""
    v = dict.fromkeys([x.split()[0] for x in D.VERDICTS.split(", ")]) | {"file": "a", "total_pages": 3, "is_end": False, "conf": 0.9, "signal": "none", "layout_prev": "form", "layout_curr": "form"}
    d = spark.createDataFrame([tuple((v | {"n": n, "signal_page": n}).values()) for n in (1, 2)], D.VERDICTS)
    assert demand.questions(d).count() == 0 and demand.questions(d.where(F.lit(False))).count() == 0
