"""Truth built from page coverage and from page rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def uncovered(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Pages (file, page) of no piece (file, start_page, n_pages)."""
    pages = totals.select("file", F.explode(F.sequence(F.lit(1), "total_pages")).alias("page"))
    covered = pieces.where("n_pages > 0").select("file", F.explode(F.expr("sequence(start_page, start_page + n_pages - 1)")).alias("page"))
    return pages.join(covered, ["file", "page"], "left_anti")


def gap_runs(covered: DataFrame, totals: DataFrame, margin: int = 0) -> DataFrame:
    """Uncovered runs (file, lo, hi) of pages 2 to total_pages, widened by ``margin``, without enumerating pages.

    Page 1 always starts a document, so it is never part of a run; pages beyond the
    total cover nothing.
    """
    t = totals.select("file", F.col("total_pages").cast("long").alias("total_pages"))
    inside = covered.select("file", F.col("page").cast("long").alias("page")).join(t, "file").where("page between 1 and total_pages").select("file", "page")
    ends = t.select("file", F.explode(F.array(F.lit(1).cast("long"), F.col("total_pages") + 1)).alias("page"))
    w = Window.partitionBy("file").orderBy("page")
    step = inside.union(ends).distinct().withColumn("nxt", F.lead("page").over(w))
    return step.where("nxt > page + 1").select("file", (F.col("page") + 1 - margin).alias("lo"), (F.col("nxt") - 1 + margin).alias("hi"))


def coverage_starts(pieces: DataFrame, totals: DataFrame) -> DataFrame:
    """Document starts: every piece's first page, the first page of every uncovered run, and page 1."""
    gaps = uncovered(pieces, totals)
    w = Window.partitionBy("file").orderBy("page")
    first = gaps.withColumn("prev", F.lag("page").over(w)).where("prev is null or prev < page - 1").select("file", "page")
    starts = pieces.select("file", F.col("start_page").alias("page")).union(first).union(totals.select("file", F.lit(1).alias("page")))
    return starts.distinct()


def smooth(rotation: DataFrame) -> DataFrame:
    """Page rotations (file, page, deg) smoothed in page order, changes seen by later pages.

    A lone upright page between equal rotations takes them, a lone rotated page
    between upright ones is righted; neighbours are by page number.  Only a page
    whose next one is upright where it is not, or the other way round, can change, so
    changes pass along alternating pages only: there the rotation goes on as long as
    it stays equal, and from the first page that breaks it all are upright.
    """
    w = Window.partitionBy("file").orderBy("page")
    at = lambda f, c: f(c).over(w)
    d = rotation.select("file", "page", "deg", at(F.lag, "deg").alias("prev"), at(F.lead, "deg").alias("next"), at(F.lag, "page").alias("pp"), at(F.lead, "page").alias("np"))
    both = F.coalesce((F.col("pp") == F.col("page") - 1) & (F.col("np") == F.col("page") + 1), F.lit(False))
    d = d.withColumn("open", both & ((F.col("deg") == 0) != (F.col("next") == 0)))
    d = d.withColumn("first", F.col("open") & ~F.coalesce(F.lag("open").over(w), F.lit(False))).withColumn("run", F.count_if(~F.col("open")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.when(F.col("deg") == 0, F.col("prev") == F.col("next")).otherwise(~F.col("first") | (F.col("prev") != 0))
    goes_on = F.min(F.when(F.col("open"), same.cast("int"))).over(Window.partitionBy("file", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)) == 1
    deg = F.when(~F.col("open"), F.col("deg")).when(~goes_on, 0).when(F.col("deg") == 0, F.col("next")).otherwise(F.col("deg"))
    return d.select("file", "page", deg.alias("deg"))


def extend_runs(smoothed: DataFrame, corroboration: DataFrame) -> DataFrame:
    """Rotated runs of two pages or more take in one corroborated upright page on either side."""
    w = Window.partitionBy("file").orderBy("page")
    rot = smoothed.where("deg <> 0").withColumn("i", F.col("page") - F.row_number().over(w))
    run = rot.groupBy("file", "i").agg(F.min("page").alias("lo"), F.max("page").alias("hi"), F.min_by("deg", "page").alias("run_deg"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    # The run on the left is extended first where two claim one page.
    edge = run.select("file", F.explode(F.array(F.struct((F.col("lo") - 1).alias("page"), F.col("lo").alias("o"), "run_deg"), F.struct((F.col("hi") + 1).alias("page"), F.col("lo").alias("o"), "run_deg"))).alias("e"))
    edge = edge.groupBy("file", F.col("e.page").alias("page")).agg(F.min_by("e.run_deg", "e.o").alias("run_deg"))
    c = corroboration.where("deg <> 0").select("file", "page", F.lit(True).alias("sure"))
    out = smoothed.join(edge, ["file", "page"], "left").join(c, ["file", "page"], "left")
    return out.select("file", "page", F.when((F.col("deg") == 0) & F.col("sure") & F.col("run_deg").isNotNull(), F.col("run_deg")).otherwise(F.col("deg")).alias("deg"))
