"""Boundary and rotation scoring over long tables (file, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scan import scan


def compare(truth: DataFrame, pred: DataFrame, keys: tuple[str, ...] = ("file", "page")) -> DataFrame:
    """Full outer match on distinct keys with in_truth and in_pred; one shuffle by key."""
    k = list(keys)
    tagged = truth.select(*k, F.lit(1).alias("t"), F.lit(0).alias("p")).union(pred.select(*k, F.lit(0), F.lit(1)))
    return tagged.groupBy(*k).agg((F.max("t") == 1).alias("in_truth"), (F.max("p") == 1).alias("in_pred"))


def counts(in_truth: Column = None, in_pred: Column = None) -> list[Column]:
    t = F.col("in_truth") if in_truth is None else in_truth
    p = F.col("in_pred") if in_pred is None else in_pred
    return [F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn")]


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf(df: DataFrame, places: int = 6) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp, fn; 0 where a denominator is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return (
        df.withColumn("precision", F.round(ratio(tp, tp + fp), places))
        .withColumn("recall", F.round(ratio(tp, tp + fn), places))
        .withColumn("f1", F.round(ratio(2 * tp, 2 * tp + fp + fn), places))
    )


def drop_masked(df: DataFrame, masks: DataFrame) -> DataFrame:
    """Rows whose page is in none of the file's inclusive ranges (lo, hi), which may overlap.

    A sweep: ranges open at lo and close behind hi, a page is masked where more have
    opened than closed; linear in pages and ranges, whatever their length.
    """
    m = masks.where("lo <= hi").select("file", F.explode(F.array(F.struct(F.col("lo").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("hi").alias("at"), F.lit(2).alias("kind")))).alias("e")).select("file", "e.*")
    rows = df.select("*", F.col("page").alias("__at"), F.lit(1).alias("__kind")).unionByName(m.select("file", F.col("at").alias("__at"), F.col("kind").alias("__kind")), allowMissingColumns=True)
    edge = lambda k: ("count", F.when(F.col("__kind") == k, 1))
    return scan(rows, ["file"], ["__at", "__kind"], __opened=edge(0), __closed=edge(2)).where("__kind = 1 and __opened <= __closed").select(*df.columns)


def by_stratum(compared: DataFrame, strata: DataFrame, total: str = "ALL", known: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 per stratum and over all; files without one are ``?``.

    Strata of ``known`` have a row even if no file has them, and so has the total then.
    """
    s = compared.join(strata, "file", "left").withColumn("stratum", F.coalesce("stratum", F.lit("?")))
    r = s.rollup("stratum").agg(*counts(), F.grouping_id().alias("g"))
    r = r.withColumn("stratum", F.when(F.col("g") == 1, total).otherwise(F.col("stratum"))).drop("g")
    if known:
        every = compared.sparkSession.createDataFrame([(x,) for x in (*known, total)], "stratum string")
        r = r.join(every, "stratum", "full").na.fill(0, ["tp", "fp", "fn"])
    return prf(r)


def intervals(starts: DataFrame, totals: DataFrame) -> DataFrame:
    """(file, start, end, ordinal) of documents from distinct start pages; page 1 always starts one."""
    s = starts.select("file", "page").union(totals.select("file", F.lit(1).alias("page"))).distinct().join(totals, "file").where("page <= total_pages")
    w = Window.partitionBy("file").orderBy("page")
    return s.select("file", F.col("page").alias("start"), (F.lead("page").over(w) - 1).alias("e"), "total_pages", F.row_number().over(w).alias("ordinal")).select(
        "file", "start", F.coalesce("e", "total_pages").alias("end"), "ordinal"
    )


def docs_exact(truth: DataFrame, pred: DataFrame, totals: DataFrame) -> DataFrame:
    """One row: documents whose start and end are both right, and all documents."""
    t, p = intervals(truth, totals), intervals(pred, totals)
    hit = p.select("file", "start", "end", F.lit(1).alias("hit"))
    return t.join(hit, ["file", "start", "end"], "left").agg(F.count("hit").alias("docs_exact"), F.count(F.lit(1)).alias("docs_total"))


def tolerance_match(truth: DataFrame, pred: DataFrame, tol: int) -> DataFrame:
    """Greedy one-to-one matching within ``tol`` pages, per file: tp, fp, fn.

    Truths go in page order, each takes its nearest free prediction, the lower
    page on ties (the order of a hash set decides there otherwise).  Only truths that
    may want the same prediction depend on each other: a file is cut where neighbours
    are more than twice the tolerance apart, and each run is folded alone.  A truth meets
    at most 2 tol + 1 predictions, and a run's fold remembers no more taken ones.
    """
    t, p = truth.select("file", F.col("page").cast("long").alias("page")).distinct(), pred.select("file", F.col("page").cast("long").alias("page")).distinct()
    offer = t.select("file", F.col("page").alias("t"), F.explode(F.sequence(F.col("page") - tol, F.col("page") + tol)).alias("page")).join(p, ["file", "page"])
    near = offer.groupBy("file", "t").agg(F.sort_array(F.collect_list(F.struct(F.abs(F.col("page") - F.col("t")).alias("d"), F.col("page").alias("p")))).alias("near"))
    prev = scan(near, ["file"], ["t"], prev=("last_before", F.col("t")))
    cut = scan(prev, ["file"], ["t"], run=("count", F.when(F.col("prev").isNull() | (F.col("t") - F.col("prev") > 2 * tol), 1)))
    runs = cut.groupBy("file", "run").agg(F.sort_array(F.collect_list(F.struct("t", "near"))).alias("truths"))

    def step(acc: Column, x: Column) -> Column:
        left = F.filter(acc["taken"], lambda p: p >= x["t"] - tol)
        best = F.get(F.filter(x["near"], lambda n: ~F.array_contains(left, n["p"])), F.lit(0))["p"]
        return F.when(best.isNull(), F.struct(acc["tp"].alias("tp"), left.alias("taken"))).otherwise(F.struct((acc["tp"] + 1).alias("tp"), F.array_append(left, best).alias("taken")))

    none = F.array().cast("array<bigint>")
    hits = runs.select("file", F.aggregate("truths", F.struct(F.lit(0).cast("long").alias("tp"), none.alias("taken")), step, lambda acc: acc["tp"]).alias("tp")).groupBy("file").agg(F.sum("tp").alias("tp"))
    n = t.select("file", F.lit(1).alias("t"), F.lit(0).alias("p")).union(p.select("file", F.lit(0), F.lit(1))).groupBy("file").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    tp = F.coalesce("tp", F.lit(0).cast("long"))
    return n.join(hits, "file", "left").select("file", tp.alias("tp"), (F.col("n_pred") - tp).alias("fp"), (F.col("n_true") - tp).alias("fn"))


def rotation_counts(joined: DataFrame, by: list[str]) -> DataFrame:
    """Degrees-exact counts from true_deg and pred_deg (null: 0); a wrong angle is a false positive and a miss."""
    t, p = F.coalesce("true_deg", F.lit(0)), F.coalesce("pred_deg", F.lit(0))
    return joined.groupBy(*by).agg(
        F.count_if((t != 0) & (t == p)).alias("tp"), F.count_if((p != 0) & (t != p)).alias("fp"), F.count_if((t != 0) & (t != p)).alias("fn")
    )


def adjacency(compared: DataFrame) -> DataFrame:
    """False positives by what is one page away: double fire (a true start also predicted), localization (a missed one), isolated."""
    near = compared.where("in_truth").select(F.col("file").alias("__f"), F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("__p"), "in_pred").groupBy("__f", "__p").agg(F.max("in_pred").alias("hit"))
    fp = compared.where("in_pred and not in_truth")
    kind = F.when(F.col("hit"), "double_fire").when(~F.col("hit"), "localization").otherwise("isolated")
    return fp.join(near, (fp["file"] == near["__f"]) & (fp["page"] == near["__p"]), "left").select("file", "page", kind.alias("kind"))


def runs(df: DataFrame, page: str = "page") -> DataFrame:
    """Islands of consecutive pages per file: lo, hi, len."""
    w = Window.partitionBy("file").orderBy(page)
    return df.withColumn("__i", F.col(page) - F.row_number().over(w)).groupBy("file", "__i").agg(F.min(page).alias("lo"), F.max(page).alias("hi"), F.count(F.lit(1)).alias("len")).drop("__i")
