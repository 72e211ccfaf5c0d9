"""Operators on small inputs with known answers, and the decision pass against a page-by-page fold."""

import difflib
import random

from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import verdicts as V
from pagemill.operators import matching as M
from pagemill.operators import scoring as S
from pagemill.operators import truth as R
from pagemill.plans import decision as D
from pagemill.plans import queries as Q
from pagemill.sources import readers, sinks
from pagemill.streaming import ingest


def one(spark, expr, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


def test_json_answers(spark):
    raw = F.col("v")
    for text, want in [
        ('```json\n{"end": true, "confidence": "85"}\n```', (True, 0.85)),
        ('<think>{no}</think> {"end": "false", "confidence": 300}', (True, 1.0)),
        ('{"end": false, "confidence": -3}', (False, 0.0)),
        ('{"end": true, "confidence": 1', (False, 0.5)),
        ("nothing", (False, 0.5)),
        (None, (False, 0.5)),
    ]:
        got = one(spark, F.struct(V.truthy_field(raw, "end", False).alias("e"), V.confidence(V.json_field(raw, "confidence")).alias("c")), text)
        assert (got["e"], got["c"]) == want, text


def test_names(spark):
    v = F.col("v")
    assert one(spark, T.safe_filename(v), ' a/b:c "d" e ') == "a-b-c_-d-_e"
    assert len(one(spark, T.safe_filename(v), "x" * 80)) == 50
    assert one(spark, T.identifier(v), "PC-12/Б №7") == "рс12б7"
    assert one(spark, T.unquote(v), "'it''s'") == "it''s"
    assert one(spark, T.hms(v), 3723, "int") == "1h 2m 3s" and one(spark, T.hms(v), 59, "int") == "59s"
    assert one(spark, V.leading_int(v), " 1005 plan") == 1005 and one(spark, V.leading_int(v), "plan") == 19999
    assert one(spark, T.squash(T.title_tokens(v, strip_identifiers=True)), "Акт №5 за  Pазpез, (1)") == "актзаразрез"
    assert one(spark, T.squash(T.title_tokens(v, compose=True)), "й") == "й"


def test_token_set_ratio(spark):
    a, b = ["план", "покрив"], ["покрив", "план", "план"]
    d = spark.createDataFrame([(a, b), (["x"], []), (["abcd"], ["bcde"])], "a array<string>, b array<string>")
    got = [r[0] for r in d.select(T.token_set_ratio("a", "b")).collect()]
    assert got == [1.0, 0.0, difflib.SequenceMatcher(None, "abcd", "bcde").ratio()]


def test_rotation_vectors(spark):
    vectors = [([0, 90, 0, 90, 0], [0, 0, 0, 0, 0]), ([0, 90, 0, 90, 90], [0, 0, 0, 90, 90]), ([0, 0, 90, 0, 90], [0, 0, 0, 0, 90]), ([90], [90])]
    rows = [(i, p + 1, d) for i, (v, _) in enumerate(vectors) for p, d in enumerate(v)] + [(9, 1, 90), (9, 3, 0), (9, 4, 90)]
    got = {}
    for r in R.smooth(spark.createDataFrame(rows, "file int, page int, deg int")).orderBy("file", "page").collect():
        got.setdefault(r["file"], []).append(r["deg"])
    assert [got[i] for i in range(4)] == [w for _, w in vectors]
    assert got[9] == [90, 0, 90]  # pages 1 and 3 are no neighbours


def test_extend_runs(spark):
    rot = spark.createDataFrame([(1, p, d) for p, d in enumerate([0, 90, 90, 0, 0, 90, 0], 1)], "file int, page int, deg int")
    sure = spark.createDataFrame([(1, 1, 90), (1, 4, 90), (1, 5, 90), (1, 7, 90)], "file int, page int, deg int")
    assert [r["deg"] for r in R.extend_runs(rot, sure).orderBy("page").collect()] == [90, 90, 90, 90, 0, 90, 0]


def test_tolerance_match(spark):
    t = spark.createDataFrame([(1, 7), (1, 10), (2, 3)], "file int, page int")
    p = spark.createDataFrame([(1, 6), (1, 8), (1, 20), (3, 1)], "file int, page int")
    got = {r["file"]: (r["tp"], r["fp"], r["fn"]) for r in S.tolerance_match(t, p, 1).collect()}
    assert got == {1: (1, 2, 1), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_empty_title_has_first_entry(spark):
    n = spark.createDataFrame([(0, "!!"), (1, "план"), (2, "разрез")], "idx int, name string")
    got = {r["title"]: (r["name"], r["band"]) for r in M.top(spark.createDataFrame([("",), ("№ 12",), ("РАЗРЕ3",), ("Paзpeз",)], "title string"), n).collect()}
    assert got[""] == got["№ 12"] == ("план", "NONE")
    assert got["Paзpeз"] == ("разрез", "MATCH")


def test_titles_of_all_parts(spark, tmp_path):
    """Every part's title is matched, whatever its key; scores against plain Python."""
    names = [("ring", "steel"), ("bolt", "brass large"), ("gear", "tin small"), ("axle", "steel large")]
    parts = [(k, *names[i % 4]) for i, k in enumerate([1, 398, 399, 400, 401, 402, 403, 5000, 19999])]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    full = {k: f"{n} {t}" for k, n, t in parts}
    noisy = {(f, f[:3] + f[4:], f + " №12/3", f.split()[0])[k % 4] for k, f in full.items()}
    squash = lambda s: "".join(w for w in s.split() if not set("0123456789№#") & set(w)).translate(str.maketrans(T.TITLE_LATIN, T.TITLE_CYRILLIC))
    tri = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}

    def rank(title, idx, name):
        q, e = squash(title), squash(name)
        short, long = sorted((len(q), len(e)))
        return (q == e, short >= 5 and short >= 0.45 * long and (q in e or e in q), len(tri(q) & tri(e)) / len(tri(q) | tri(e)), -idx)

    kinds = list(enumerate(sorted(set(full.values())), 1))
    want = {t: [n for _, n in sorted(kinds, key=lambda x: rank(t, *x), reverse=True)[:3]] for t in noisy}
    got = {}
    for r in sorted(Q.title_topk(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["title"], []).append(r["name"])
    assert got == want
    assert {r["title"]: r["name"] for r in Q.title_best_match(spark, str(tmp_path)).collect()} == {t: n[0] for t, n in want.items()}

    def ratio(title, name):
        words = lambda x: " ".join(sorted({w.translate(str.maketrans(T.TITLE_LATIN, T.TITLE_CYRILLIC)) for w in x.split() if not set("0123456789№#") & set(w)}))
        return difflib.SequenceMatcher(None, words(title), words(name)).ratio()

    best = {t: max(kinds, key=lambda x: (*rank(t, *x)[:3], ratio(t, x[1]), -x[0]))[1] for t in noisy}
    full_rows = Q.title_best_match_full(spark, str(tmp_path)).collect()
    assert {r["title"]: r["name"] for r in full_rows} == best
    assert all(r["token_set"] == round(ratio(r["title"], r["name"]), 4) for r in full_rows)


def test_identifiers_of_whole_texts(spark, tmp_path):
    texts = ["PC-12/Б №7 " * 9, "x" * 40 + "Й 1", "", None]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["ident"] for r in Q.identifier_fold(spark, str(tmp_path)).collect()}
    assert got == {0: "рс12б7" * 9, 1: "х" * 40 + "й1", 2: "", 3: None}


def test_pairs_of_whole_titles(spark, tmp_path):
    """Words after the third count."""
    titles = ["ring steel large bolt", "ring steel large", "zink zink zink bolt steel"]
    spark.createDataFrame([(i, f"<title>{t}</title>") for i, t in enumerate(titles)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    parts = ["ring steel large bolt", "ring steel large bolt", "zink bolt steel"]
    spark.createDataFrame([(i, p.split()[0], " ".join(p.split()[1:])) for i, p in enumerate(parts)], "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    tri = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    pairs = [(tri(t.replace(" ", "")), tri(p.replace(" ", ""))) for t, p in zip(titles, parts, strict=True)]
    got = {r["page_id"]: r["score"] for r in Q.trigram_jaccard(spark, str(tmp_path)).collect()}
    assert got == {i: round(len(a & b) / len(a | b), 6) for i, (a, b) in enumerate(pairs)} and got[0] == 1
    # The title against the name, and against about half of itself (8 of 18, 7 of 14, 11 of 21 letters; 45 % are needed).
    assert {r["page_id"]: r["n_contained"] for r in Q.containment(spark, str(tmp_path)).collect()} == {0: 1, 1: 2, 2: 2}


def fold(rows, total):
    """Page by page, as a state machine: starts and the best (conf, signal) per end page."""
    starts, best, chain = [1], {}, False
    for n in range(1, total):
        v = rows[n]
        end, conf, sig, sp = v["is_end"], v["conf"], v["signal"], v["signal_page"]
        e = n if not end else sp - 1 if sig in V.START_SIGNALS else sp
        if end and sig == "titled_id_header":
            name = {n - 1: "prev", n: "cur", n + 1: "next"}
            seen = v[f"title_{name[sp]}"] + v[f"id_{name[sp]}"]
            if seen == 1:
                conf = min(conf, 0.6)
            elif seen == 0:
                other = [p for p in (n - 1, n, n + 1) if p >= 1 and p != sp and v[f"title_{name[p]}"]]
                if len(other) == 1:
                    e = other[0] - 1
                    if not v[f"id_{name[other[0]]}"]:
                        conf = min(conf, 0.6)
                    sp = other[0]
                else:
                    end, e = False, n
        if end and sig in V.END_SIGNALS and sp == n + 1 and v["self_contained_next"]:
            e = n
        if sig in V.CAPPED_SIGNALS:
            conf = min(conf, 0.6)
        if end and "appendix" in sig:
            if not chain:
                end, chain = v["standalone"], not v["standalone"]
            else:
                end = n > 1 and v["starts_new"]
        elif end:
            chain = False
        if end and sig in V.SIGNOFF_SIGNALS and e == n:
            end = v["next_starts"]
            conf = (conf + v["next_conf"]) / 2 if end else conf
        if end and conf < 0.75 and sig not in V.UNCONFIRMED_OK:
            end = v["confirmed"]
            conf = (conf + v["confirm_conf"]) / 2 if end else conf
        if end:
            new = e + 1
            if new > total:
                if v["self_contained_next"]:
                    e, new = n, n + 1
                else:
                    end, e = False, min(e, total)
            if new <= total and new not in starts:
                starts.append(new)
            if e not in best or conf > best[e][0]:
                best[e] = (conf, sig)
        if n > 1 and n not in starts:
            p = rows[n - 1]
            if (end or p["letterhead_match"] is False or p["layout_prev"] != p["layout_curr"]) and v["starts_new"]:
                starts.append(n)
                if n - 1 not in best or v["starts_conf"] > best[n - 1][0]:
                    best[n - 1] = (v["starts_conf"], "start_only_heading")
    out = {}
    for s in starts:
        conf, sig = best.get(s - 1, (1.0, "none"))
        out[s] = (round(min(1.0, conf + 0.1) if sig in V.SIGNOFF_SIGNALS else conf, 9), sig)
    return out


def test_decision_against_fold(spark):
    rnd = random.Random(5)
    signals = V.START_SIGNALS + V.END_SIGNALS * 2 + ["titled_id_header"] * 2 + ["appendix_mid_doc"] * 3 + ["stamp_and_date"]
    rows, totals, want = [], [], {}
    flags = ["title_prev", "title_cur", "title_next", "id_prev", "id_cur", "id_next", "self_contained_next", "standalone", "starts_new", "next_starts", "confirmed"]
    for f in range(1500):
        total = rnd.randint(1, 10)
        totals.append((str(f), total))
        pages = {}
        for n in range(1, total):
            v = {"file": str(f), "n": n, "total_pages": total, "is_end": rnd.random() < 0.6, "signal": rnd.choice(signals), "signal_page": rnd.choice([p for p in (n - 1, n, n + 1) if p >= 1])}
            v |= {k: rnd.random() < 0.5 for k in flags} | {k: rnd.randint(0, 20) / 20 for k in ("conf", "starts_conf", "next_conf", "confirm_conf")}
            v |= {"letterhead_match": rnd.choice([True, False, None]), "layout_prev": rnd.choice(["form", "table", None]), "layout_curr": rnd.choice(["form", "table", None])}
            if n == 1:
                v["title_prev"] = v["id_prev"] = False
            pages[n] = v
            rows.append(v)
        want[str(f)] = fold(pages, total)
    names = [x.split()[0] for x in D.VERDICTS.split(", ")]
    df = spark.createDataFrame([tuple(r[k] for k in names) for r in rows], D.VERDICTS)
    got = {}
    for r in D.boundaries(df, spark.createDataFrame(totals, "file string, total_pages int")).collect():
        got.setdefault(r["file"], {})[r["page"]] = (round(r["confidence"], 9), r["signal"])
    assert got == want


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "gt.json").write_text('{"a.pdf": [1, 4], "b.pdf": [1]}')
    (tmp_path / "masks.json").write_text('{"a.pdf": [[2, 3]]}')
    (tmp_path / "rot.json").write_text('{"a.pdf": {"2": 90}}')
    (tmp_path / "notes.txt").write_text("dir one/a.pdf  2  90 [nested]\nb.pdf 3 270\n\n")
    (tmp_path / "ranges.txt").write_text("a.pdf [2-4], 7, 9 # why\n\n# none\n")
    assert {(r[0], r[1]) for r in readers.page_map(spark, str(tmp_path / "gt.json")).collect()} == {("a.pdf", 1), ("a.pdf", 4), ("b.pdf", 1)}
    assert readers.masks(spark, str(tmp_path / "masks.json")).first()[1:] == (2, 3)
    assert readers.rotation_map(spark, str(tmp_path / "rot.json")).first()[:] == ("a.pdf", 2, 90)
    assert sorted(r[:] for r in readers.rotation_notes(spark, str(tmp_path / "notes.txt")).collect()) == [("b.pdf", 3, 270, False), ("dir one/a.pdf", 2, 90, True)]
    assert sorted(r["page"] for r in readers.page_ranges(spark, str(tmp_path / "ranges.txt")).collect()) == [2, 3, 4, 7, 9]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.PDF").write_text("%PDF")
    (tmp_path / "in" / "y.txt").write_text("y")
    assert readers.pdf_listing(spark, str(tmp_path / "in")).count() == 1
    docs = spark.createDataFrame([("f", 1, 3, 1, 1005, "Plan: a", True)], "file string, start int, end int, ordinal int, code int, name string, flagged boolean")
    row = sinks.manifest(docs).first()
    assert (row["out_name"], row["pages"]) == ("f_001_01005_Plan-_a_REVIEW.pdf", "pages 1–3")
    left = sinks.unfinished(spark.createDataFrame([("A",), ("A_1",), ("B",)], "stem string"), spark.createDataFrame([("A_1_001.pdf",)], "name string"))
    assert [r[0] for r in left.collect()] == ["B"]


def test_shard_of_equal_paths(spark):
    paths = "path string, rel_path string"
    inputs = spark.createDataFrame([("/r/a", "a"), ("/r/a", "a"), ("/r/b", "b"), ("b", "x"), ("/r/c", "c"), (None, "c"), (None, None)], paths)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    got = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert got(sinks.shard(inputs, names("/r/a", "a", "a", "b", None))) == [("/r/a", "a"), ("/r/a", "a"), ("/r/b", "b"), ("b", "x")]
    assert got(sinks.shard(inputs, names("/r/a", "c"), names("a", "b", "c", None))) == [("/r/a", "a"), ("/r/a", "a"), ("/r/b", "b"), ("/r/c", "c"), (None, "c")]


def test_shard_filter_keeps_every_row(spark, tmp_path):
    import duckdb

    urls = [
        (3, "http://a/x"), (4, "http://a/x"), (5, "http://b/x"), (7, "http://c/y"), (8, "http://d/y"), (10, "http://d/y"),  # equal urls
        (1, "/y"), (6, "/z"), (11, "http://e/z"),  # a url that is another's path
        (13, "http://f/n"), (28, "http://g/n\n"), (56, "http://g/e\r"), (16, "http://f/e"), (49, "http://g/l\u2028m"), (17, "http://f/l\u2028m"),  # line ends
        (9, None), (77, None), (2, None), (None, "http://a/x"), (None, "http://q/q"), (-21, "http://h/p"), (19, "http://i/p"),
    ]
    # with no url without a path listed, and with one (28), by which all such urls are
    for k, rows in enumerate(([u for u in urls if u[0] != 28], urls)):
        spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/{k}/pages.parquet")
        con = duckdb.connect()
        con.sql(f"create view pages as select * from read_parquet('{tmp_path}/{k}/pages.parquet/*.parquet')")
        got = sorted(r["path"] for r in Q.shard_filter(spark, f"{tmp_path}/{k}").collect())
        assert got == sorted(r[0] for r in con.sql(Q.ORACLES["shard_filter"]).fetchall())
        assert got.count("http://a/x") == 3 and got.count("http://d/y") == 2 and got.count("http://e/z") == 0


def test_streaming_takes_each_file_once(spark, tmp_path):
    v = dict.fromkeys([x.split()[0] for x in D.VERDICTS.split(", ")], False) | {
        "file": "a", "n": 1, "total_pages": 2, "is_end": True, "conf": 0.9, "signal": "fresh_letterhead", "signal_page": 2,
        "starts_conf": 0.0, "next_conf": 0.0, "confirm_conf": 0.0, "layout_prev": "form", "layout_curr": "form",
    }
    for k in range(2):
        spark.createDataFrame([tuple((v | {"file": str(k)}).values())], D.VERDICTS).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.available_now(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["file"], r["page"]) for r in got) == [("0", 1), ("0", 2), ("1", 1), ("1", 2)]
