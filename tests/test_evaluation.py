"""Log events, evaluation sets, rules, readers and sinks on small inputs with known answers."""

import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as T
from pagemill.functions import verdicts as V
from pagemill.operators import evaluation as E
from pagemill.operators import events as L
from pagemill.operators import matching as M
from pagemill.operators import scoring as S
from pagemill.operators import truth as R
from pagemill.sources import detection_log as G
from pagemill.sources import readers, sinks


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,end",
    [
        ('{"x": {"end": "no"}, "end": false}', False), ('{"end": true} and {x}', None), ('{"a": 1}', None), ('{"end": null}', False), ('{"end": 0}', False), ('{"end": 0.0}', False), ('{"end": 2}', True),
        ('{"end": ""}', False), ('{"end": "false"}', True), ('{"end": []}', False), ('{"end": [0]}', True), ('{"end": {}}', False), ('{"end": {"a": 1}}', True), ('x {"end": true} y', True),
    ],
)
def test_json_truth(spark, raw, end):
    for default in (True, False):
        assert one(spark, V.truthy_field(F.col("v"), "end", default), raw) == (default if end is None else end)


def test_json_field_is_top_level(spark):
    assert one(spark, V.json_field(F.col("v"), "conf"), '{"a": {"conf": 1}, "conf": "85%"}') == "85%"
    assert one(spark, V.json_field(F.col("v"), "conf"), '{"a": {"conf": 1}}') is None


def test_gap_runs(spark):
    """Runs before the first covered page and after the last, the margin, page 1, pages beyond the total."""
    covered = spark.createDataFrame([("a", 4), ("a", 5), ("a", 8), ("b", 1), ("b", 2), ("c", 9)], "file string, page int")
    totals = spark.createDataFrame([("a", 10), ("b", 2), ("c", 3), ("d", 1)], "file string, total_pages int")
    got = lambda m: {(r["file"], r["lo"], r["hi"]) for r in R.gap_runs(covered, totals, m).collect()}
    assert got(0) == {("a", 2, 3), ("a", 6, 7), ("a", 9, 10), ("c", 2, 3)}
    assert got(1) == {("a", 1, 4), ("a", 5, 8), ("a", 8, 11), ("c", 1, 4)}


def smooth_fold(rows):
    rows = sorted(rows)
    for i in range(1, len(rows) - 1):
        (p0, d0), (p, d), (p1, d1) = rows[i - 1 : i + 2]
        if p0 == p - 1 and p1 == p + 1:
            if d == 0 and d0 != 0 and d0 == d1:
                rows[i] = (p, d0)
            elif d != 0 and d0 == 0 and d1 == 0:
                rows[i] = (p, 0)
    return rows


def test_smoothing_against_a_fold(spark):
    import random

    rnd = random.Random(3)
    files = {f: [(p, rnd.choice([0, 0, 90, 90, 270])) for p in range(1, 30) if rnd.random() < 0.95] for f in range(200)}
    d = spark.createDataFrame([(f, p, x) for f, rows in files.items() for p, x in rows], "file int, page int, deg int")
    got = {}
    for r in R.smooth(d).collect():
        got.setdefault(r["file"], []).append((r["page"], r["deg"]))
    assert {f: sorted(x) for f, x in got.items()} == {f: smooth_fold(x) for f, x in files.items() if x}


def test_osd_vectors(spark):
    """Degrees that undo an applied rotation; weak detections abstain."""
    for applied, needed in [(0, 0), (90, 270), (180, 180), (270, 90)]:
        d = one(spark, F.struct(V.osd_degrees(F.pmod(360 - F.col("v"), F.lit(360)), F.lit(9.0)).alias("d"), V.osd_degrees(F.col("v"), F.lit(2.9)).alias("n")), applied, "int")
        assert d["d"] == needed and d["n"] is None


TABLE = ["Архитектура", "Скица", "Разрез", "Фасада", "Ситуация", "Обяснителна записка", "Становище", "План покрив", "Становище по проекта"]


def test_title_vectors(spark):
    """Corrupted titles still match, absent ones don't."""
    n = spark.createDataFrame(list(enumerate(TABLE)), "idx int, name string")
    match = ["Скица", "Обяснителна записка", "С К И Ц А", "Р А З Р Е З", "О б я с н и т е л н а   з а п и с к а", "Скца", "Обяснителна запска", "Скнца", "Ситуацоя", "Cкицa", "Pазрез", "сКиЦа", "РАЗРЕЗ", "Скица № 1234 / 12.03.2017", "Становище № 4279762"]
    none = ["ЧЕЛЕН ЛИСТ", "НОТАРИАЛЕН АКТ", "", "№ 12345 / 01.02.2003"]
    others = spark.createDataFrame([(100 + i, f"друго {i} xyz") for i in range(6_000)], "idx int, name string")
    for table in (n, n.union(others)):  # a short table, and a long one
        got = {r["title"]: r for r in M.top(spark.createDataFrame([(x,) for x in match + none + ["Становище по"]], "title string"), table).collect()}
        assert all(got[t]["band"] == "MATCH" for t in match), [t for t in match if got[t]["band"] != "MATCH"]
        assert all(got[t]["band"] == "NONE" for t in none) and got["Становище по"]["band"] in ("MATCH", "AMBIGUOUS")
        assert got["Скица № 1234 / 12.03.2017"]["name"] == "Скица" and got[""]["name"] == "Архитектура"


def test_titles_are_composed(spark):
    n = spark.createDataFrame([(0, "Чешмяй")], "idx int, name string")
    assert M.top(spark.createDataFrame([("Чешмяй",)], "title string"), n).first()["exact"] == 1


def test_confidence_signal(spark):
    d = spark.createDataFrame([("MATCH",), ("AMBIGUOUS",), ("NONE",)], "b string")
    assert [r[0] for r in d.select(T.is_confidence_signal(F.col("b"))).collect()] == [True, False, False]


def test_read_entries(spark, tmp_path):
    (tmp_path / "n.csv").write_text('1000,Архитектура\n1001.0,Разрез\nx,"План, покрив"\n2000, \n2001,План\n3000,Пътища\n3001,РАЗРЕЗ\n', encoding="utf-8")
    e = M.read_entries(readers.nomenclature_rows(spark, str(tmp_path / "n.csv")), ["Разрез"]).orderBy("idx").collect()
    assert [(r["idx"], r["code"], r["name"], r["category"], r["is_sheet_type"]) for r in e] == [
        (0, 1000, "Архитектура", "Архитектура", False), (1, 1001, "Разрез", "Архитектура", True), (2, None, "План, покрив", "Архитектура", False), (4, 2001, "План", "", False),
        (5, 3000, "Пътища", "Пътища", False), (6, 3001, "РАЗРЕЗ", "Пътища", True),
    ]


LOG = """Checking page 2
[TITLE-GATE] p3: title='ЧЕЛЕН ЛИСТ' identifier=None -> grounded=1/2
[TITLE-GATE] p3 one-of-two grounded
[TITLE-GATE] p9 one-of-two grounded
[TITLE-GATE] p4: title="Б" identifier='12' -> grounded=0/2
[TITLE-GATE] p5: title=x identifier=y -> grounded=2/2
[TITLE-GATE] titled_id_header at p4 SUPPRESSED
    End at page 3 → doc starts at page 4 (conf=80%, signal=titled_id_header)
Checking page 3
[TITLE-GATE-RELOC] grounded title on p4 (title='Z' id=None, grounded=2/2)
p3: end=True, signal=signature_block, signal_on_page=4, conf=90%
[WINDOW-REQUERY] p3
[START-DETECT] p6 heading
  Image_1.pdf
  pred=[1, 4, 6]
[TITLE-GATE] titled_id_header at p4 SUPPRESSED
[TITLE-GATE] p4: title=a identifier=b -> grounded=0/2
Image_2.pdf
    pred=[1]
    pred=[1, 3, ]
[TITLE-GATE] p7: title=left identifier=over -> grounded=2/2"""


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("logs") / "a.log"
    p.write_bytes(LOG.replace("\n", "\r\n").encode() + b"\r\n\xff broken\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        log = readers.log_lines(spark, str(p)).cache()
        assert [r["line"] for r in log.orderBy("line_no").collect()] == [*LOG.split("\n"), "� broken"]
        assert [r[0] for r in log.select("line_no").orderBy("line_no").collect()] == list(range(LOG.count("\n") + 2))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    return G.parse_detection(log)


def test_title_events(spark, lines):
    s = L.sections(lines)
    got = [(r["file"], r["page"], r["title"], r["identifier"], r["verdict"]) for r in L.title_events(s).orderBy("line_no").collect()]
    assert got == [
        ("Image_1.pdf", 3, "ЧЕЛЕН ЛИСТ", "None", "CAPPED"), ("Image_1.pdf", 4, "Б", "12", "SUPPRESSED"), ("Image_1.pdf", 5, "x", "y", "KEEP"),
        ("Image_1.pdf", 4, "Z", "None", "RELOC"), ("Image_2.pdf", 4, "a", "b", "PENDING"),
    ]
    truth = spark.createDataFrame([("Image_1.pdf", 4), ("Image_2.pdf", 4)], "file string, page int")
    labels = [r["label"] for r in L.label_events(L.title_events(s), truth).orderBy("line_no").collect()]
    assert labels == ["FP", "suppressed-was-true", "FP", "TP", "suppressed-was-true"]


def test_counters_and_predictions(spark, lines):
    s = L.sections(lines)
    strata = spark.createDataFrame([("Image_1.pdf", "dev")], "file string, stratum string")
    masks = spark.createDataFrame([("Image_1.pdf", 9, 9)], "file string, lo int, hi int")
    got = {r["stratum"]: tuple(r[m] for m in L.MEASURES) for r in L.counters(s, strata, masks, ["dev", "holdout"]).collect()}
    assert got == {"dev": (1, 1, 1, 1, 1, 1), "?": (1, 0, 0, 0, 0, 0), "holdout": (0,) * 6, "ALL": (2, 1, 1, 1, 1, 1)}
    assert sorted((r["file"], r["page"]) for r in L.predictions(lines).collect()) == [("Image_1.pdf", 1), ("Image_1.pdf", 4), ("Image_1.pdf", 6), ("Image_2.pdf", 1), ("Image_2.pdf", 3)]
    compared = spark.createDataFrame([("Image_1.pdf", 4, False, True), ("Image_1.pdf", 6, True, True), ("Image_1.pdf", 3, True, False), ("Image_1.pdf", 8, True, False)], "file string, page int, in_truth boolean, in_pred boolean")
    a = L.signal_attribution(compared, L.starts(s), strata, "titled_id_header", ["dev", "fresh"]).collect()
    assert {r["stratum"]: (r["tp"], r["alone"], r["with_others"], r["fp"]) for r in a} == {"dev": (0, 0, 0, 1), "fresh": (0, 0, 0, 0)}
    assert [(r["page"], r["titles"]) for r in L.missed_headings(compared, L.title_events(s)).collect()] == [(3, ["ЧЕЛЕН ЛИСТ"])]
    assert [(r["page"], r["signature"]) for r in L.signature_triage(compared, s).collect()] == [(4, True)]


def test_run_log(spark):
    log = """10:00:00 File  : /x/Image_7.pdf
10:00:01 end-of-document detection (5 pages)
10:01:00 Boundaries — TP=1 FP=0 FN=0 P=1 F1=90%
10:01:01 Boundaries — TP=1 FP=0 FN=0 P=1 F1=10%
Rotations  — TP=0 FP=0 FN=0 F1=0%
10:02:00 Boundaries — TP=1 FP=0 FN=0 P=1 F1=20%
23:59:30 File : /x/Image_8.pdf
File : /x/Image_unknown.pdf
00:00:30 Boundaries — TP=1 FP=0 FN=0 P=1 F1=50%
Rotations — TP=1 FP=0 FN=1 F1=67%"""
    d = spark.createDataFrame([("r", i, x) for i, x in enumerate(log.split("\n"))], "source string, line_no int, line string")
    label = F.when(F.contains("run_file", F.lit("_7")), "seven").when(F.contains("run_file", F.lit("_8")), "eight")
    runs = L.run_results(G.parse_run(d), label)
    assert {r["label"]: tuple(r)[2:] for r in runs.collect()} == {"seven": (60, 5, 90, None), "eight": (60, None, 50, 67)}
    assert tuple(L.timing(runs).first()) == (2, 120, 60.0, 5, 2.5, 24.0)
    assert tuple(L.timing(runs.where("label = 'eight'")).first()) == (1, 60, 60.0, 0, 0.0, 0.0)
    assert L.timing(runs.limit(0)).first()["s_per_page"] == 0.0


def test_cases_and_latest(spark):
    paths = ["/t/p1/IMAGE_1.PDF", "/t/p1/c/Image_2.pdf", "/t/p2/c1/image_3.pdf", "/t/p2/c1/x.pdf", "/t/p2/c2/d/Image_4.pdf", "/t/Image_5.pdf", "/u/p/Image_6.pdf"]
    got = {(r["case"], r["path"]) for r in E.cases(spark.createDataFrame([(p,) for p in paths], "path string"), "/t/").collect()}
    assert got == {("p1", "/t/p1/IMAGE_1.PDF"), ("p2/c1", "/t/p2/c1/image_3.pdf")}
    names = spark.createDataFrame([("test_run9.log",), ("test_run14.log",), ("test_run99.txt",)], "name string")
    assert tuple(E.latest_run(names).first()) == ("test_run9.log", "test_run14.log")


def test_evaluation_set(spark, tmp_path):
    pieces = spark.createDataFrame([("a", 1, 2), ("a", 5, 1), ("b", 1, 4)], "file string, start_page int, n_pages int")
    totals = spark.createDataFrame([("a", 7), ("b", 4)], "file string, total_pages int")
    none = spark.createDataFrame([], "file string, stratum string")
    t, s, m = E.evaluation_set(pieces, totals, none, spark.createDataFrame([], "file string"))
    sinks.write_evaluation_set(str(tmp_path / "e"), t, s, m)
    back = lambda n: {tuple(r) for r in spark.read.parquet(str(tmp_path / "e" / n)).collect()}
    assert back("truth") == {("a", 1), ("a", 3), ("a", 5), ("a", 6)} and back("strata") == {("a", "fresh")} and back("masks") == {("a", 2, 5), ("a", 5, 8)}


def test_prompts(spark):
    d = spark.createDataFrame([(x,) for x in ["consecutive scanned pages (3, 4,5) Does page 4 END a document", "Does page q END a document", "ends with a signature or approval block (page 3)", "Page 2 starts with an appendix heading", "zzz"]], "p string")
    pages, current = E.prompt_pages(F.col("p"))
    got = [tuple(r) for r in d.select(E.prompt_kind(F.col("p")), pages, current).collect()]
    assert got == [("end_of_doc", [3, 4, 5], 4), ("end_of_doc", [], None), ("next_page_starts_new", [None, None], None), ("appendix_standalone", [], 2), ("unknown", None, None)]


def test_closure_abstains(spark):
    starts = spark.createDataFrame([("a", 2), ("a", 4), ("a", 6), ("b", 2), ("b", 3)], "file string, page int")
    pages = spark.createDataFrame([(f, p, p == 2, f == "a" and p == 5) for f in "ab" for p in range(1, 8)], "file string, page int, typed boolean, marker boolean")
    assert {(r["file"], r["page"]): r["suppressed"] for r in E.close_at_marker(starts, pages).collect()} == {("a", 2): False, ("a", 4): True, ("a", 6): False, ("b", 2): False, ("b", 3): False}
    assert one(spark, E.soft_prior(F.col("v"), F.lit(True)), 0.97, "double") == 1.0


def test_state_and_cache(spark, tmp_path):
    todo = spark.createDataFrame([("k", "p")], "key string, prompt string")
    pred = spark.createDataFrame([("f", 1)], "file string, page int")
    assert sinks.write_state(str(tmp_path / "s"), todo, pred) == 3 and not (tmp_path / "s" / "predictions").exists()
    assert sinks.write_state(str(tmp_path / "s"), todo.limit(0), pred) == 0 and spark.read.json(str(tmp_path / "s" / "predictions")).count() == 1
    made = []

    def make(df):
        made.append(sorted(r["page"] for r in df.collect()))
        return df.withColumn("deg", F.col("page") * 90)

    pages = spark.createDataFrame([(1,), (2,)], "page int")
    sinks.cached(str(tmp_path / "c"), pages, ["page"], make)
    got = sinks.cached(str(tmp_path / "c"), spark.createDataFrame([(2,), (3,)], "page int"), ["page"], make).collect()
    assert made == [[1, 2], [3]] and sorted(tuple(r) for r in got) == [(2, 180), (3, 270)]
    sinks.write_json(pred, str(tmp_path / "j"), "append")
    sinks.write_json(pred, str(tmp_path / "j"), "append")
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_more_readers(spark, tmp_path):
    (tmp_path / "strata.json").write_text('{"a.pdf": "dev"}')
    (tmp_path / "waivers.json").write_text('[{"file": "a.pdf", "fp_page": 3, "class": "x", "rationale": "r", "attested_by": "p", "date": "2020-01-02"}]')
    (tmp_path / "results.json").write_text('{"docs_exact": 1, "docs_total": 2, "by_tolerance": {"0": {"TP": 1, "per_file": [{"file": "a.pdf", "pred": [2, 4], "true": [2], "fp": [4], "fn": []}]}}}')
    (tmp_path / "usage.tsv").write_text("k\tend\t120\t5\n")
    assert tuple(readers.strata(spark, str(tmp_path / "strata.json")).first()) == ("a.pdf", "dev")
    assert readers.waivers(spark, str(tmp_path / "waivers.json")).first()["fp_page"] == 3
    assert sorted(tuple(r) for r in readers.results(spark, str(tmp_path / "results.json")).collect()) == [(0, "a.pdf", 2), (0, "a.pdf", 4)]
    assert tuple(readers.usage(spark, str(tmp_path / "usage.tsv")).first()) == ("k", "end", 120, 5)
    pieces = spark.createDataFrame([("/x/12_PDFsam_Image_1.pdf",), ("/x/Image_1.pdf",)], "path string")
    assert [tuple(r) for r in readers.piece_starts(pieces).collect()] == [("/x/12_PDFsam_Image_1.pdf", "Image_1", 12)]
    for name in ("in/b.pdf", "in/a.PDF", "in/split/c.pdf", "in/d/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("%PDF")
    name = lambda df: [r["path"].rsplit("/", 1)[1] for r in df.collect()]
    assert name(readers.pdf_listing(spark, str(tmp_path / "in"))) == ["a.PDF", "b.pdf"]
    assert name(readers.pdf_listing(spark, str(tmp_path / "in"), recursive=True)) == ["b.pdf", "e.pdf"]


def test_manifest_is_written_by_file(spark, tmp_path):
    docs = spark.createDataFrame([("f", 1, 3, 1, 1005, "Plan", False), ("g", 1, 1, 1, 7, "a/b", True)], "file string, start int, end int, ordinal int, code int, name string, flagged boolean")
    sinks.write_manifest(docs, str(tmp_path / "m"))
    back = {r["file"]: (r["out_name"], r["pages"]) for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert back == {"f": ("f_001_01005_Plan.pdf", "pages 1–3"), "g": ("g_001_00007_a-b_REVIEW.pdf", "page 1")}


def test_review_and_stacks(spark):
    c = spark.createDataFrame([("a", 2, True, True), ("a", 3, False, True), ("a", 4, True, False), ("a", 5, True, False), ("a", 6, False, True)], "file string, page int, in_truth boolean, in_pred boolean")
    r = E.reviewed(c, spark.createDataFrame([("a", 3)], "file string, page int"), spark.createDataFrame([("a", 4)], "file string, page int")).first()
    assert (r["tp"], r["fp"], r["fn"]) == (2, 1, 1)
    fp = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y"), ("a", 7, "x")], "file string, page int, signal string")
    assert {r["signal"]: (r["n"], r["in_stack"]) for r in E.stacks(fp).collect()} == {"x": (2, 1), "y": (1, 1), "ALL": (3, 2)}
    assert S.prf(c.agg(*S.counts())).first()["tp"] == 1
