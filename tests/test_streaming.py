"""Pages that arrive live: any order, several batches, restarts, replays and repeats."""

import os

import pytest
from pyspark.sql import functions as F

from pagemill.plans import decision as D
from pagemill.plans import live_queries as LQ
from pagemill.plans import queries as Q
from pagemill.streaming import ingest


@pytest.fixture(scope="module")
def want(spark, sf):
    b = D.boundaries(Q.answers(spark, sf), Q.totals(spark, sf))
    return sorted((str(r["file"]), r["page"], round(r["confidence"], 9), r["signal"]) for r in b.collect())


def rows(spark, out):
    return sorted((r["file"], r["page"], round(r["confidence"], 9), r["signal"]) for r in ingest.read_epochs(spark, out, LQ.STARTS).collect())


def last(folder):
    return max((f for f in os.listdir(folder) if f.isdigit()), key=int)


def test_any_order_restart_and_replay(spark, sf, tmp_path, want):
    """Later pages come first; the second run goes on with the state of the first; a replayed batch replaces itself."""
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    pages = LQ.arrivals(spark, sf).cache()
    pages.where("n % 2 = 0").repartition(3).write.parquet(source)
    ingest.live_now(spark, source, out, cp, files_per_batch=1)
    early = rows(spark, out)
    assert set(early) < set(want) and len(early) < len(want)  # only what no missing page can change
    pages.where("n % 2 = 1").repartition(3).write.mode("append").parquet(source)
    pages.where("n < 3").coalesce(1).write.mode("append").parquet(source)  # senders repeat themselves
    ingest.live_now(spark, source, out, cp, files_per_batch=2)
    assert rows(spark, out) == want
    # Stopped after the write, before the checkpoint: the last batch runs again.
    epoch = last(f"{cp}/commits")
    written = ingest.read_epochs(spark, out, LQ.STARTS).where(F.col("epoch") == int(epoch)).count()
    os.remove(f"{cp}/commits/{epoch}")
    if os.path.exists(f"{cp}/commits/.{epoch}.crc"):
        os.remove(f"{cp}/commits/.{epoch}.crc")
    ingest.live_now(spark, source, out, cp, files_per_batch=2)
    assert last(f"{cp}/commits") == epoch
    assert rows(spark, out) == want
    assert ingest.read_epochs(spark, out, LQ.STARTS).where(F.col("epoch") == int(epoch)).count() == written
    pages.unpersist()


def test_replayed_batch_of_whole_files(spark, sf, tmp_path, want):
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    LQ.arrivals(spark, sf).where("n > 0").coalesce(1).write.parquet(source)
    for _ in range(2):
        ingest.available_now(spark, source, out, cp)
        epoch = last(f"{cp}/commits")
        for f in (epoch, f".{epoch}.crc"):
            if os.path.exists(f"{cp}/commits/{f}"):
                os.remove(f"{cp}/commits/{f}")
    files = {r["file"] for r in Q.totals(spark, sf).where("total_pages > 1").select(F.col("file").cast("string").alias("file")).collect()}
    assert rows(spark, out) == [r for r in want if r[0] in files]


def test_epochs(spark, tmp_path):
    """Half-written batches are not read; a batch written twice counts once; nothing written is empty."""
    path = str(tmp_path / "out")
    assert ingest.read_epochs(spark, path, "x long").collect() == []
    for n, epoch in ((3, 0), (2, 1), (5, 1)):
        ingest.write_epoch(spark.range(n).withColumnRenamed("id", "x"), path, epoch)
    assert sorted(r["epoch"] for r in ingest.read_epochs(spark, path, "x long").collect()) == [0] * 3 + [1] * 5
    ingest.write_epoch(spark.range(4).withColumnRenamed("id", "x"), path, 2)
    os.remove(f"{path}/epoch=2/_SUCCESS")
    assert ingest.read_epochs(spark, path, "x long").count() == 8


def test_late_repeats_and_signals_out_of_turn(spark, tmp_path):
    """A decided file stays decided; one-page files are announced; nothing else comes of it."""
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    v = dict.fromkeys([x.split()[0] for x in D.VERDICTS.split(", ")], False) | {
        "total_pages": 3, "is_end": True, "conf": 0.9, "signal": "fresh_letterhead", "starts_conf": 0.0, "next_conf": 0.0, "confirm_conf": 0.0, "layout_prev": "form", "layout_curr": "form",
    }
    page = lambda n, **x: tuple((v | {"file": "a", "n": n, "signal_page": n + 1} | x).values())
    alone = tuple((dict.fromkeys(v) | {"file": "b", "n": 0, "total_pages": 1}).values())
    for batch in ([page(2)], [page(1), alone], [page(1), page(2), alone]):
        spark.createDataFrame(batch, D.VERDICTS).coalesce(1).write.mode("append").parquet(source)
        ingest.live_now(spark, source, out, cp)
    assert [r[:2] for r in rows(spark, out)] == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]
