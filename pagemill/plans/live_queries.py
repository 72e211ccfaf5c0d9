"""Queries over streams: the given tables as files that arrive in several batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.decision import VERDICTS
from ..sources.committed import Cache
from ..sources.folders import scratch
from ..streaming import ingest
from . import demand
from .queries import DECISION_SQL, answers, query, totals

FILES, STARTS = 8, "file string, page int, confidence double, signal string"


def arrivals(spark, sf):
    """Answers as they come from a sender: every page a row, one-page files announced."""
    names = [x.split()[0] for x in VERDICTS.split(", ")]
    given = answers(spark, sf).select(*[F.col(c).cast(k) for c, k in (x.split() for x in VERDICTS.split(", "))])
    alone = totals(spark, sf).where("total_pages = 1").select(F.col("file").cast("string").alias("file"), F.lit(0).alias("n"), "total_pages")
    return given.unionByName(alone, allowMissingColumns=True).select(*names)


@query(DECISION_SQL)
def live_decision(spark, sf):
    """Section 2.10: pages in an order of their own, two files of rows a batch, give the decision's rows."""
    root = scratch(spark, "live")
    # Dealt by page, so that a file's pages lie in different batches.
    arrivals(spark, sf).repartition(FILES, F.col("n") * 5 % FILES).write.parquet(f"{root}/in")
    ingest.live_now(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint", files_per_batch=2)
    return ingest.read_epochs(spark, f"{root}/out", STARTS).select(F.col("file").cast("bigint").alias("file"), F.col("page").cast("bigint").alias("page"), F.round("confidence", 6).alias("confidence"), "signal")


@query(DECISION_SQL)
def demand_decision(spark, sf):
    """O-K7, O-S14: answers are asked for in rounds, only where the decision comes to depend on them."""
    known = answers(spark, sf)
    has = [F.struct(F.lit(k).alias("kind"), F.col(c[0]).alias("flag"), (F.col(c[1]) if c[1:] and c[1].startswith("id_") else F.lit(None).cast("boolean")).alias("extra"), (F.col(c[1]) if c[1:] and c[1].endswith("conf") else F.lit(None).cast("double")).alias("conf")) for k, c in demand.KINDS.items()]
    told = known.select("file", "n", F.explode(F.array(*has)).alias("x")).select("file", "n", "x.*")
    cache = Cache(spark, scratch(spark, "answers"), "flag boolean, extra boolean, conf double", buckets=8)
    given = known.select(*[F.col(c).cast(k) for c, k in (x.split() for x in VERDICTS.split(", "))])
    b = demand.decide(given, totals(spark, sf).withColumn("file", F.col("file").cast("string")), lambda asked: asked.join(told.withColumn("file", F.col("file").cast("string")), ["file", "n", "kind"]), cache)
    return b.select(F.col("file").cast("bigint").alias("file"), F.col("page").cast("bigint").alias("page"), F.round("confidence", 6).alias("confidence"), "signal")
