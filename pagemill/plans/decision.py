"""The boundary decision: from page verdicts to document starts, by windows and joins.

One row per (file, n), n from 1 to total_pages - 1, with the answers as columns
(see ``VERDICTS``).  A page's own steps need only its row; the appendix chain is
one running window; starts found by other pages are one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import verdicts as V
from ..operators.logs import active_before

VERDICTS = (
    "file string, n int, total_pages int, is_end boolean, conf double, signal string, signal_page int, "
    "title_prev boolean, title_cur boolean, title_next boolean, id_prev boolean, id_cur boolean, id_next boolean, "
    "self_contained_next boolean, standalone boolean, starts_new boolean, starts_conf double, next_starts boolean, next_conf double, "
    "confirmed boolean, confirm_conf double, letterhead_match boolean, layout_prev string, layout_curr string"
)


def _title_gate(d: DataFrame) -> DataFrame:
    """A titled header must be readable where it is claimed, or on exactly one other page of the window."""
    at = lambda p: F.when(F.col("signal_page") == F.col("n") - 1, F.col(f"{p}_prev")).when(F.col("signal_page") == F.col("n"), F.col(f"{p}_cur")).otherwise(F.col(f"{p}_next"))
    pages = F.array(*[F.struct((F.col("n") + k).alias("page"), F.col(f"title_{s}").alias("title"), F.col(f"id_{s}").alias("ident")) for k, s in ((-1, "prev"), (0, "cur"), (1, "next"))])
    d = d.withColumn("others", F.filter(pages, lambda x: (x["page"] != F.col("signal_page")) & (x["page"] >= 1) & x["title"]))
    gate = F.col("is_end") & (F.col("signal") == "titled_id_header")
    seen = at("title").cast("int") + at("id").cast("int")
    move = gate & (seen == 0) & (F.size("others") == 1)
    drop = gate & (seen == 0) & (F.size("others") != 1)
    there = F.get("others", F.lit(0))
    cap = (gate & (seen == 1)) | (move & ~there["ident"])
    return (
        d.withColumn("conf", F.when(cap, F.least("conf", F.lit(V.CAP))).otherwise(F.col("conf")))
        .withColumn("effective_end", F.when(move, there["page"] - 1).when(drop, F.col("n")).otherwise(F.col("effective_end")))
        .withColumn("signal_page", F.when(move, there["page"]).otherwise(F.col("signal_page")))
        .withColumn("is_end", F.col("is_end") & ~drop)
        .drop("others")
    )


def before_chain(verdicts: DataFrame) -> DataFrame:
    """What a page's own answers say of its end, before the appendix chain is looked at; ``chain``: 1 where it begins one, 0 where it ends one."""
    c, end = F.col, F.col("is_end")
    d = verdicts.withColumn("effective_end", F.when(end & c("signal").isin(V.START_SIGNALS), c("signal_page") - 1).when(end, c("signal_page")).otherwise(c("n")))
    d = _title_gate(d)
    own = end & c("signal").isin(V.END_SIGNALS) & (c("signal_page") == c("n") + 1) & c("self_contained_next")
    d = d.withColumn("effective_end", F.when(own, c("n")).otherwise(c("effective_end")))
    d = d.withColumn("conf", F.when(c("signal").isin(V.CAPPED_SIGNALS), F.least("conf", F.lit(V.CAP))).otherwise(c("conf")))
    appendix = F.contains(c("signal"), F.lit("appendix"))
    return d.withColumn("chain", F.when(end & appendix & ~c("standalone"), 1).when(end & ~appendix, 0))


def after_chain(d: DataFrame) -> DataFrame:
    """The rest of a page's steps, given whether a chain is ``active`` before it."""
    c, end = F.col, F.col("is_end")
    appendix = F.contains(c("signal"), F.lit("appendix"))
    d = d.withColumn("is_end", F.when(end & appendix, F.when(c("active"), (c("n") > 1) & c("starts_new")).otherwise(c("standalone"))).otherwise(end))
    sign = end & c("signal").isin(V.SIGNOFF_SIGNALS) & (c("effective_end") == c("n"))
    d = d.withColumn("__s", sign).withColumn("is_end", end & (~c("__s") | c("next_starts")))
    d = d.withColumn("conf", F.when(c("__s") & c("next_starts"), (c("conf") + c("next_conf")) / 2).otherwise(c("conf")))
    d = d.withColumn("__s", V.needs_confirmation(end, c("conf"), c("signal"))).withColumn("is_end", end & (~c("__s") | c("confirmed")))
    d = d.withColumn("conf", F.when(c("__s") & c("confirmed"), (c("conf") + c("confirm_conf")) / 2).otherwise(c("conf")))
    out = end & (c("effective_end") + 1 > c("total_pages"))
    d = d.withColumn("entered", end).withColumn("__s", out)
    d = d.withColumn("new_start", F.when(c("__s") & c("self_contained_next"), c("n") + 1).otherwise(c("effective_end") + 1))
    d = d.withColumn("effective_end", F.when(c("__s") & c("self_contained_next"), c("n")).when(c("__s"), F.least("effective_end", "total_pages")).otherwise(c("effective_end")))
    return d.withColumn("is_end", end & (~c("__s") | c("self_contained_next"))).drop("__s")


def decide(verdicts: DataFrame) -> DataFrame:
    """Per row: final is_end, entered (an end was recorded), effective_end, new_start, conf."""
    d = before_chain(verdicts)
    d = d.withColumn("active", active_before(F.col("chain") == 1, F.col("chain") == 0, "file", ["n"]))
    return after_chain(d).drop("active", "chain")


def emissions(verdicts: DataFrame) -> DataFrame:
    """Every recorded end and detected start: file, iter, src (0 end, 1 start), start (null: none), key, conf, signal."""
    d = decide(verdicts)
    ends = d.where("entered").select(
        "file", F.col("n").alias("iter"), F.lit(0).alias("src"), F.when(F.col("new_start") <= F.col("total_pages"), F.col("new_start")).alias("start"), F.col("effective_end").alias("key"), "conf", "signal"
    )
    opened = ends.where("start is not null").groupBy(F.col("file").alias("__f"), F.col("start").alias("__p")).agg(F.min("iter").alias("first_iter"))
    w = Window.partitionBy("file").orderBy("n")
    brk = V.style_break(F.lag("letterhead_match").over(w), F.lag("layout_prev").over(w), F.lag("layout_curr").over(w))
    s = d.withColumn("brk", brk).join(opened, (F.col("file") == F.col("__f")) & (F.col("n") == F.col("__p")), "left")
    starts = s.where("n > 1 and (first_iter is null or first_iter > n) and (is_end or brk) and starts_new").select(
        "file", F.col("n").alias("iter"), F.lit(1).alias("src"), F.col("n").alias("start"), (F.col("n") - 1).alias("key"), F.col("starts_conf").alias("conf"), F.lit("start_only_heading").alias("signal")
    )
    return ends.unionByName(starts)


def boundaries(verdicts: DataFrame, totals: DataFrame) -> DataFrame:
    """file, page, confidence and signal of every document start; ``totals``: file, total_pages."""
    e = emissions(verdicts)
    best = e.groupBy("file", F.col("key").alias("__k")).agg(F.max_by(F.struct("conf", "signal"), F.struct("conf", -F.col("iter"), -F.col("src"))).alias("b"))
    pages = e.where("start is not null").select("file", F.col("start").alias("page")).union(totals.select("file", F.lit(1).alias("page"))).distinct()
    j = pages.join(best.withColumnRenamed("file", "__f"), (F.col("file") == F.col("__f")) & (F.col("page") - 1 == F.col("__k")), "left")
    conf, signal = F.coalesce("b.conf", F.lit(1.0)), F.coalesce("b.signal", F.lit("none"))
    return j.select("file", "page", boosted(conf, signal).alias("confidence"), signal.alias("signal"))


def boosted(conf: Column, signal: Column) -> Column:
    """A sign-off adds to the confidence of the start behind it."""
    return F.when(signal.isin(V.SIGNOFF_SIGNALS), F.least(F.lit(1.0), conf + 0.10)).otherwise(conf)


def classify(starts: DataFrame, codes: DataFrame, totals: DataFrame, title_page: str) -> DataFrame:
    """Adds code, name and flagged from page codes (file, page, code, name, class_conf).

    A title page takes the code of its second page if that is in the same
    document and has one.
    """
    w = Window.partitionBy("file").orderBy("page")
    s = starts.join(totals, "file").withColumn("next_start", F.lead("page").over(w)).withColumn("next_start", F.coalesce("next_start", F.col("total_pages") + 1))
    own = codes.select("file", "page", "code", "name")
    peek = codes.select("file", (F.col("page") - 1).alias("page"), F.col("code").alias("code2"), F.col("name").alias("name2"))
    j = s.join(own, ["file", "page"], "left").join(peek, ["file", "page"], "left")
    take = (F.col("name") == title_page) & (F.col("page") + 1 < F.col("next_start")) & F.col("code2").isNotNull() & (F.col("code2") != 19999)
    return j.select(
        "file", "page", F.when(take, F.col("code2")).otherwise(F.col("code")).alias("code"), F.when(take, F.col("name2")).otherwise(F.col("name")).alias("name"),
        "confidence", V.review_flag(F.col("confidence"), F.col("page")).alias("flagged"),
    )
