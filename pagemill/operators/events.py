"""Events of detection logs: sections closed by a file's marker, title-gate events, counters, attribution.

Input is what ``sources.detection_log`` makes of lines: (source, line_no, ...).  A
source is one log of any length: what runs through all of it is a ``scan``, windows
are over a file's section.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .logs import carried
from .scan import scan

KEPT = ["KEEP", "CAPPED", "RELOC"]


def sections(lines: DataFrame) -> DataFrame:
    """Adds ``file`` and ``section``: lines belong to the marker that closes them.

    Lines behind the last marker are dropped; of sections closed by one name the last counts.
    """
    marker = F.col("file_marker")
    d = scan(lines, ["source"], ["line_no"], file=("next", marker), section=("count_before", marker)).where("file is not null")
    last = d.groupBy("source", "file").agg(F.max("section").alias("section"))
    return d.join(last, ["source", "file", "section"], "left_semi")


def title_events(lines: DataFrame) -> DataFrame:
    """Title-gate and relocation events of ``sections``: source, file, line_no, page, title, identifier, grounded, verdict.

    A CAPPED or SUPPRESSED line changes the latest event of its page within the
    section; the last such line before the page's next event counts.
    """
    change = F.when(F.col("capped").isNotNull(), "CAPPED").when(F.col("suppressed").isNotNull(), "SUPPRESSED")
    d = lines.withColumn("page", F.coalesce("title_page", "capped", "suppressed")).where("page is not null").withColumn("change", F.when(F.col("title_event").isNull(), change))
    w = Window.partitionBy("source", "section", "page").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("epoch", F.count("title_event").over(w)).where("epoch > 0")
    first = F.struct("line_no", "title_event", "title", "identifier", "grounded")
    e = d.groupBy("source", "file", "section", "page", "epoch").agg(F.min(F.when(F.col("title_event").isNotNull(), first)).alias("e"), F.max(F.when(F.col("change").isNotNull(), F.struct("line_no", "change"))).alias("c"))
    start = F.when(F.col("e.title_event") == "reloc", "RELOC").when(F.col("e.grounded") == 2, "KEEP").otherwise("PENDING")
    return e.select("source", "file", "e.line_no", "page", "e.title", "e.identifier", "e.grounded", F.coalesce("c.change", start).alias("verdict"))


def label_events(events: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``label`` against truth (file, page): kept events are TP or FP, others (pending too) suppressed-was-true or -false."""
    t = truth.select("file", "page").distinct().withColumn("__true", F.lit(True))
    kept, true = F.col("verdict").isin(KEPT), F.coalesce("__true", F.lit(False))
    label = F.when(kept & true, "TP").when(kept, "FP").when(true, "suppressed-was-true").otherwise("suppressed-was-false")
    return events.join(t, ["file", "page"], "left").withColumn("label", label).drop("__true")


MEASURES = ["titled_suppressed", "titled_capped", "titled_reloc", "titled_reloc_dup", "window_requery", "onelite_would_fire"]


def counters(lines: DataFrame, strata: DataFrame, masks: DataFrame, known: list[str]) -> DataFrame:
    """Event counts per stratum (all of ``known``, also empty ones) and over all, of ``sections``.

    Pages in masked ranges don't count, but requeries always do.  A relocation is a
    duplicate if its target was first opened by the iteration just before.
    """
    where = ["source", "section"]
    d = lines.withColumn("__s", F.concat_ws("/", *where))
    d = d.withColumn("it", carried(F.col("checking"), "__s", ["line_no"]))
    target = F.coalesce("reloc", "doc_start")
    # A line may open a document and relocate at once: opening comes first.
    own = F.when(F.col("doc_start").isNotNull() & (F.col("doc_start") == F.col("reloc")), F.col("it"))
    d = d.withColumn("__t", target)
    earlier = Window.partitionBy("__s", "__t").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__first", F.coalesce(F.first(F.when(F.col("doc_start") == F.col("__t"), F.col("it")), ignorenulls=True).over(earlier), own))
    lite = F.when(F.col("end_signal_page") == F.col("end_page") + 1, F.col("end_page"))
    kinds = F.array(
        F.struct(F.lit("titled_suppressed").alias("k"), F.col("suppressed").alias("p")), F.struct(F.lit("titled_capped").alias("k"), F.col("capped").alias("p")), F.struct(F.lit("titled_reloc").alias("k"), F.col("reloc").alias("p")),
        F.struct(F.lit("titled_reloc_dup").alias("k"), F.when(F.col("__first") == F.col("it") - 1, F.col("reloc")).alias("p")), F.struct(F.lit("window_requery").alias("k"), F.when(F.col("requery"), F.lit(-1)).alias("p")),
        F.struct(F.lit("onelite_would_fire").alias("k"), lite.alias("p")),
    )
    e = d.select("file", F.explode(kinds).alias("x")).select("file", "x.k", F.col("x.p").alias("page")).where("page is not null")
    m = masks.select(F.col("file").alias("__f"), "lo", "hi")
    e = e.join(m, (F.col("file") == F.col("__f")) & F.col("page").between(F.col("lo"), F.col("hi")) & (F.col("k") != "window_requery"), "left_anti")
    s = e.join(strata, "file", "left").withColumn("stratum", F.coalesce("stratum", F.lit("?")))
    r = s.rollup("stratum").agg(*[F.count_if(F.col("k") == k).alias(k) for k in MEASURES], F.grouping_id().alias("g")).withColumn("stratum", F.when(F.col("g") == 1, "ALL").otherwise(F.col("stratum"))).drop("g")
    every = e.sparkSession.createDataFrame([(x,) for x in [*known, "ALL"]], "stratum string")
    return r.join(every, "stratum", "full").na.fill(0, MEASURES)


def predictions(lines: DataFrame) -> DataFrame:
    """(source, file, page) of the last ``pred`` line of each file: that of the file's name above it."""
    d = scan(lines, ["source"], ["line_no"], file=("last", F.col("any_pdf"))).where("file is not null and pred is not null and any_pdf is null")
    last = d.groupBy("source", "file").agg(F.max_by("pred", "line_no").alias("pred"))
    return last.select("source", "file", F.explode(F.array_distinct("pred")).alias("page"))


def starts(lines: DataFrame) -> DataFrame:
    """(source, file, line_no, page, signal) of document starts and start detections of ``sections``."""
    found = F.col("doc_start_signal").isNotNull()
    d = lines.where(found | F.col("start_detect").isNotNull())
    return d.select("source", "file", "line_no", F.when(found, F.col("doc_start")).otherwise(F.col("start_detect")).alias("page"), F.when(found, F.col("doc_start_signal")).otherwise("start_only_heading").alias("signal"))


def signal_attribution(compared: DataFrame, found: DataFrame, strata: DataFrame, signal: str, known: list[str]) -> DataFrame:
    """Per stratum, of boundaries with ``signal``: true ones, those with it alone, those with others too, false ones.

    ``compared``: file, page, in_truth, in_pred; ``found``: file, page, signal.
    """
    sets = found.groupBy("file", "page").agg(F.collect_set("signal").alias("signals"))
    c = compared.where("in_pred").join(sets, ["file", "page"]).where(F.array_contains("signals", signal)).join(strata, "file")
    alone = F.size("signals") == 1
    r = c.groupBy("stratum").agg(F.count_if("in_truth").alias("tp"), F.count_if(F.col("in_truth") & alone).alias("alone"), F.count_if(F.col("in_truth") & ~alone).alias("with_others"), F.count_if(~F.col("in_truth")).alias("fp"))
    every = c.sparkSession.createDataFrame([(x,) for x in known], "stratum string")
    return every.join(r, "stratum", "left").na.fill(0)


def missed_headings(compared: DataFrame, events: DataFrame) -> DataFrame:
    """Missed boundaries on whose page some title event stands, with its titles in log order."""
    missed = compared.where("in_truth and not in_pred").select("file", "page")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "title"))), lambda x: x["title"])
    e = events.groupBy("file", "page").agg(titles.alias("titles"))
    return e.join(missed, ["file", "page"], "left_semi")


def signature_triage(compared: DataFrame, lines: DataFrame) -> DataFrame:
    """False positives (file, page) and whether an end by signature on the page before is what made them."""
    fp = compared.where("in_pred and not in_truth").select("file", "page")
    sign = lines.where("end_signal = 'signature_block'").select("file", (F.col("end_page") + 1).alias("page")).distinct().withColumn("__s", F.lit(True))
    return fp.join(sign, ["file", "page"], "left").select("file", "page", F.coalesce("__s", F.lit(False)).alias("signature"))


def run_results(lines: DataFrame, label: Column) -> DataFrame:
    """Per (source, label) of a test run's log: seconds, pages, boundary F1 and rotation F1.

    ``label``: of ``run_file``, null where unknown; lines after an unknown file still
    belong to the one before.  A file's first boundary line counts, its pages are those
    stated before; rotations are kept only where there is data (tp + fp + fn > 0) and
    close the file.  Of a label's repeats the last wins.
    """
    d = lines.withColumn("label", F.when(F.col("run_file").isNotNull(), label))
    d = scan(d, ["source"], ["line_no"], __file=("count", F.col("label"))).where("__file > 0")
    f = Window.partitionBy("source", "__file").orderBy("line_no")
    back = f.rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("label", F.first("label").over(f.rowsBetween(Window.unboundedPreceding, 0))).withColumn("began", F.first("clock").over(f.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("closed", F.coalesce(F.count("rot_f1").over(back), F.lit(0)) > 0).where("not closed")
    d = d.withColumn("stated", F.last("pages", ignorenulls=True).over(back)).withColumn("nth", F.count("boundary_f1").over(f.rowsBetween(Window.unboundedPreceding, 0)))
    bound = d.where("boundary_f1 is not null and nth = 1")
    b = bound.groupBy("source", "label").agg(F.max_by("boundary_f1", "line_no").alias("boundary_f1"))
    timed = bound.where("began is not null and clock is not null").groupBy("source", "label").agg(F.max_by(F.struct(F.pmod(F.col("clock") - F.col("began"), F.lit(86400)).alias("seconds"), F.col("stated").alias("pages")), "line_no").alias("t"))
    r = d.where("rot_f1 is not null and rot_tp + rot_fp + rot_fn > 0").groupBy("source", "label").agg(F.max_by("rot_f1", "line_no").alias("rotation_f1"))
    return b.join(timed, ["source", "label"], "left").join(r, ["source", "label"], "full").select("source", "label", "t.seconds", "t.pages", "boundary_f1", "rotation_f1")


def timing(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Over files with a time (per ``by``): n, total_s, s_per_file, pages, pages_per_file, s_per_page; 0 where no pages are known.

    Files without pages count in the mean's denominator.
    """
    t = runs.where("seconds is not null").withColumn("pages", F.coalesce("pages", F.lit(0)))
    n, s, p = F.count(F.lit(1)), F.coalesce(F.sum("seconds"), F.lit(0)), F.coalesce(F.sum("pages"), F.lit(0))
    zero = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4)
    return t.groupBy(*by).agg(n.alias("n"), s.alias("total_s"), zero(F.try_divide(s, n)).alias("s_per_file"), p.alias("pages"), zero(F.try_divide(p, n)).alias("pages_per_file"), zero(F.try_divide(s, p)).alias("s_per_page"))


def rotation_blocks(lines: DataFrame) -> DataFrame:
    """(source, precision, recall, f1) of a log's last block of overall rotation figures.

    A block is what stands between its heading and the next heading of any kind.  Of each
    figure its first line there counts, recall only behind precision, f1 only behind
    recall, else it is null; a block without precision is none.  Equal lines elsewhere
    (the boundaries' figures have the same form) are other blocks' lines.
    """
    d = scan(lines, ["source"], ["line_no"], kind=("last", F.col("heading")), block=("count", F.col("heading"))).where("kind = 'rotation'")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("line_no", F.col(c).alias("v")))).alias(c)
    b = d.groupBy("source", "block").agg(first("precision"), first("recall"), first("f1")).where("precision is not null")
    b = b.withColumn("recall", F.when(F.col("recall.line_no") > F.col("precision.line_no"), F.col("recall")))
    b = b.withColumn("f1", F.when(F.col("f1.line_no") > F.col("recall.line_no"), F.col("f1")))
    last = F.max_by(F.struct(*[F.col(f"{c}.v").alias(c) for c in ("precision", "recall", "f1")]), "block")
    return b.groupBy("source").agg(last.alias("x")).select("source", "x.*")


def rotation_history(history: DataFrame, current: DataFrame) -> DataFrame:
    """(run, precision, recall, f1): the current run's row takes the place of a stored one, missing figures are 0."""
    now = current.select("run", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    return history.select("run", "precision", "recall", "f1").join(now.select("run"), "run", "left_anti").unionByName(now)
