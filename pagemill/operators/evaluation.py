"""Evaluation sets, review rules and reports over long tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scoring import counts, prf, runs
from .truth import coverage_starts, gap_runs

# Words of a prompt that tell its kind, the first that fits.
PROMPT_KINDS = [
    ("end_of_doc", r"END a document"),
    ("style_continuity", r"Compare these two scanned document pages visually"),
    ("self_contained", r"SELF-CONTAINED one-page document"),
    ("next_page_starts_new", r"ends with a signature or approval block"),
    ("starts_new_document", r"BEGIN a new, separate document distinct"),
    ("confirm_boundary", r"DIFFERENT documents that should be filed separately"),
    ("appendix_standalone", r"an appendix heading"),
    ("classify", r"FIRST page of a document"),
    ("doc_identifier", r"most prominent document"),
]
# Where prompts name their pages.
WINDOW_OF = {"end_of_doc": r"consecutive scanned pages \(([\d, ]+)\)", "appendix_standalone": r"examining pages ([\d, ]+) from"}
PAGE_OF = {"end_of_doc": r"Does page (\d+) END", "appendix_standalone": r"Page (\d+) starts with", "self_contained": r"Look at page (\d+)", "style_continuity": r"second page \(page (\d+)\)"}
PAIR_OF = {"starts_new_document": r"\(page (\d+) and page (\d+)\)", "confirm_boundary": r"Do page (\d+) and page (\d+)"}
NEXT_STARTS = (r"Page (\d+) ends with", r"page \(page (\d+)\)")


def originals(listing: DataFrame) -> DataFrame:
    """Files (path) named ``IMAGE_*.pdf`` in any case."""
    name = F.upper(F.substring_index("path", "/", -1))
    return listing.where(name.startswith("IMAGE_") & name.endswith(".PDF"))


def cases(listing: DataFrame, root: str) -> DataFrame:
    """(case, path) of originals one folder below ``root``, or two where the upper folder has none of its own."""
    rel = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    d = originals(listing.where(F.col("path").startswith(root.rstrip("/") + "/"))).withColumn("parts", F.split(rel, "/")).where(F.size("parts").isin(2, 3))
    d = d.withColumn("project", F.get("parts", F.lit(0)))
    flat = F.max((F.size("parts") == 2).cast("int")).over(Window.partitionBy("project")) == 1
    d = d.withColumn("flat", flat).where(~F.col("flat") | (F.size("parts") == 2))
    return d.select(F.array_join(F.slice("parts", 1, F.size("parts") - 1), "/").alias("case"), "path")


def evaluation_set(pieces: DataFrame, totals: DataFrame, strata: DataFrame, attested: DataFrame, default: str = "fresh") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Truth (file, page), strata (file, stratum) and masks (file, lo, hi) of files with two starts or more.

    A file without a stratum has the default one; uncovered runs of files that are not
    attested are masked, one page wider on both sides.
    """
    starts = coverage_starts(pieces, totals)
    used = starts.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("file")
    truth = starts.join(used, "file", "left_semi")
    known = used.join(strata, "file", "left").select("file", F.coalesce("stratum", F.lit(default)).alias("stratum"))
    covered = pieces.where("n_pages > 0").select("file", F.explode(F.expr("sequence(start_page, start_page + n_pages - 1)")).alias("page"))
    masks = gap_runs(covered, totals.join(used, "file", "left_semi"), margin=1).join(attested.select("file"), "file", "left_anti")
    return truth, known, masks


def stratum_sizes(strata: DataFrame, known: list[str]) -> DataFrame:
    """Files per stratum, empty ones too."""
    every = strata.sparkSession.createDataFrame([(x,) for x in known], "stratum string")
    return every.join(strata.groupBy("stratum").agg(F.count(F.lit(1)).alias("files")), "stratum", "left").na.fill(0)


def pages_covered(documents: DataFrame, totals: DataFrame) -> DataFrame:
    """Per file: pages of all documents (start, end), pages of the source, and whether they agree."""
    d = documents.groupBy("file").agg(F.sum(F.col("end") - F.col("start") + 1).alias("split_pages"))
    return totals.join(d, "file", "left").select("file", F.coalesce("split_pages", F.lit(0)).alias("split_pages"), "total_pages", F.coalesce("split_pages", F.lit(0)).eqNullSafe(F.col("total_pages")).alias("agree"))


def lowest(compared: DataFrame, n: int) -> DataFrame:
    """The ``n`` files with the lowest F1, worst first (name on ties): scores, extra and missed pages."""
    pages = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(c, F.col("page")))), ",")
    t, p = F.col("in_truth"), F.col("in_pred")
    s = prf(compared.groupBy("file").agg(*counts(), pages(~t & p).alias("extra"), pages(t & ~p).alias("missed")))
    return s.orderBy("f1", "file").limit(n).select("file", "precision", "recall", "f1", "extra", "missed")


def latest_run(names: DataFrame) -> DataFrame:
    """One row: the last log (name ``test_run<N>.log``) by text order, as local listings pick it, and by number, as version sort does."""
    n = F.regexp_extract("name", "^test_run(\\d+)\\.log$", 1).try_cast("int")
    runs_ = names.where(F.col("name").rlike("^test_run\\d+\\.log$"))
    return runs_.agg(F.max("name").alias("by_name"), F.max_by("name", n).alias("by_number"))


def prompt_kind(prompt: Column) -> Column:
    kind = F.lit("unknown")
    for k, pattern in reversed(PROMPT_KINDS):
        kind = F.when(prompt.rlike(pattern), k).otherwise(kind)
    return kind


def prompt_pages(prompt: Column) -> tuple[Column, Column]:
    """Pages that a prompt shows (a window, pair or single page, null where unreadable) and the one it asks about."""
    kind, number = prompt_kind(prompt), lambda p, k=1: F.regexp_extract(prompt, p, k).try_cast("int")
    shown, current = F.lit(None).cast("array<int>"), F.lit(None).cast("int")
    for k, p in WINDOW_OF.items():
        listed = F.transform(F.split(F.regexp_extract(prompt, p, 1), ","), lambda x: F.trim(x).try_cast("int"))
        shown = F.when(kind == k, F.when(prompt.rlike(p), listed).otherwise(F.array().cast("array<int>"))).otherwise(shown)
        current = F.when(kind == k, number(PAGE_OF[k])).otherwise(current)
    for k, p in PAIR_OF.items():
        shown = F.when(kind == k, F.when(prompt.rlike(p), F.array(number(p, 1), number(p, 2))).otherwise(F.array().cast("array<int>"))).otherwise(shown)
    for k, before in (("style_continuity", True), ("self_contained", False)):
        n = number(PAGE_OF[k])
        shown = F.when(kind == k, F.when(n.isNull(), F.array().cast("array<int>")).otherwise(F.array(n - 1, n) if before else F.array(n))).otherwise(shown)
    shown = F.when(kind == "next_page_starts_new", F.array(*[number(p) for p in NEXT_STARTS])).otherwise(shown)
    return shown, current


def infer(requests: DataFrame, provider: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """(key, raw) of requests (key, prompt): ``provider`` answers a batch of prompts; the seam for any model or stand-in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "raw": provider(b["prompt"].tolist())})

    return requests.select("key", "prompt").mapInPandas(run, "key string, raw string")


def corroborate(pages: DataFrame, provider: Callable[[pd.DataFrame], list[tuple[bool, int | None, float] | None]]) -> DataFrame:
    """Adds corr_rotated, corr_deg and corr_conf to pages: ``provider`` sees a batch of rows and says of each (rotated, degrees or None, confidence), or None.

    The seam for any second opinion on rotation; a page without one has nulls, as
    ``functions.verdicts.corroborated_rotation`` takes them.
    """
    kept = pages.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = [x or (None, None, None) for x in provider(b)]
            cols = (pd.array([x[k] for x in said], dtype=t) for k, t in ((0, "boolean"), (1, "Int32"), (2, "Float64")))
            yield b[kept].assign(**dict(zip(("corr_rotated", "corr_deg", "corr_conf"), cols, strict=True)))

    schema = T.StructType([*pages.schema.fields, T.StructField("corr_rotated", T.BooleanType()), T.StructField("corr_deg", T.IntegerType()), T.StructField("corr_conf", T.DoubleType())])
    return pages.mapInPandas(run, schema)


def close_at_marker(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``suppressed`` to candidates (file, page): between a typed start and its closing marker no document starts.

    ``pages``: file, page, typed (a document of a type that has a closing mark starts
    here), marker (the mark stands here).  A type whose marker is never read closes
    nothing.
    """
    w = Window.partitionBy("file").orderBy("page")
    opened = F.last(F.when(F.col("typed"), F.col("page")), ignorenulls=True)
    close = F.first(F.when(F.col("marker"), F.col("page")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    p = pages.join(starts.select("file", "page", F.lit(True).alias("__start")), ["file", "page"], "left").withColumn("typed", F.col("typed") & F.coalesce("__start", F.lit(False)))
    p = p.withColumn("close", close).withColumn("open", F.last(F.when(F.col("typed"), F.struct("page", "close")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.coalesce(F.col("page") <= F.col("open.close"), F.lit(False))
    return starts.join(p.select("file", "page", inside.alias("suppressed")), ["file", "page"], "left")


def soft_prior(conf: Column, expected: Column, nudge: float = 0.05) -> Column:
    """A small change of confidence that adds or removes no boundary."""
    return F.when(expected, F.least(F.lit(1.0), conf + nudge)).otherwise(F.greatest(F.lit(0.0), conf - nudge))


def rule_effects(fired: DataFrame, rules: list[str]) -> DataFrame:
    """Per rule (rule, action, in_truth): suppressed false boundaries (tp_fix), suppressed true ones (fp_harm), other firings (prior)."""
    s = F.col("action") == "suppress"
    r = fired.groupBy("rule").agg(F.count_if(s & ~F.col("in_truth")).alias("tp_fix"), F.count_if(s & F.col("in_truth")).alias("fp_harm"), F.count_if(~s).alias("prior"))
    every = fired.sparkSession.createDataFrame([(x,) for x in rules], "rule string")
    return every.join(r, "rule", "left").na.fill(0)


def reviewed(compared: DataFrame, accepted: DataFrame, two_sided: DataFrame) -> DataFrame:
    """Counts and scores after review: accepted false positives count as true, two-sided misses are dropped."""
    mark = lambda d, c: d.select("file", "page").distinct().withColumn(c, F.lit(True))
    c = compared.join(mark(accepted, "acc"), ["file", "page"], "left").join(mark(two_sided, "two"), ["file", "page"], "left")
    t, p = F.col("in_truth"), F.col("in_pred")
    c = c.where(~(t & ~p & F.coalesce("two", F.lit(False))))
    return prf(c.agg(*counts(t | (p & F.coalesce("acc", F.lit(False))), p)))


def stacks(false_positives: DataFrame) -> DataFrame:
    """Per signal (file, page, signal): false positives, and those in a run of two pages or more; ALL over all."""
    inside = runs(false_positives.select("file", "page").distinct()).where("len > 1").select("file", F.explode(F.sequence("lo", "hi")).alias("page")).withColumn("stack", F.lit(True))
    d = false_positives.join(inside, ["file", "page"], "left")
    r = d.rollup("signal").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("stack", F.lit(False))).alias("in_stack"), F.grouping_id().alias("g"))
    return r.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("signal")).alias("signal"), "n", "in_stack")
