"""The boundary decision over pages that arrive live, in any order and over many batches.

A row is a page's answers (``VERDICTS``).  Every step that needs only them runs as
columns before the state; the state of a file is what the pages before leave behind:
the next page to decide, whether an appendix chain is active, whether the last page
broke the style, and the starts and best ends of the last few pages.  Pages that come
early wait in a map of the state until those before them are there; pages that were
decided or are waiting already are ignored, so senders may repeat themselves.

A start is given out once, as soon as no later page can change it: page p's end is
the key p - 1, which pages p - 2 to p + 1 can set.  So signal pages must lie in the
page's window (n - 1 to n + 1), as the questions ask.  A file of one page has no
answers; a row with n = 0 announces it.

State per file is bounded by its gap of missing pages; a decided file keeps one small
row, which a time to live removes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

from ..functions import verdicts as V
from ..plans.decision import after_chain, before_chain, boosted

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUTCOME = {"entered": "boolean", "start": "int", "key": "int", "conf": "double", "is_end": "boolean"}
#: A page as it waits; outcomes without and with an active chain.
_PAGE = {"n": "int", "total_pages": "int", "chain": "int", "breaks": "boolean", "starts_new": "boolean", "starts_conf": "double", "signal": "string"} | {f"{k}_{c}": t for k in ("idle", "chained") for c, t in _OUTCOME.items()}
_PAGE_DDL = ", ".join(f"{c} {t}" for c, t in _PAGE.items())
_STATE = "next int, active boolean, breaks boolean, starts array<int>, end_keys array<int>, end_confs array<double>, end_signals array<string>"


def outcomes(verdicts: DataFrame) -> DataFrame:
    """Each page with what its steps give where no chain is active (``idle_``) and where one is (``chained_``)."""
    d = before_chain(verdicts)
    changed = ["is_end", "conf", "effective_end"]
    d = d.withColumn("__own", F.struct(*changed))
    for name, active in (("idle", False), ("chained", True)):
        d = after_chain(d.withColumn("active", F.lit(active)))
        start = F.when(F.col("new_start") <= F.col("total_pages"), F.col("new_start").cast("int"))
        found = {"entered": F.col("entered"), "start": start, "key": F.col("effective_end").cast("int"), "conf": F.col("conf"), "is_end": F.col("is_end")}
        d = d.withColumns({f"{name}_{c}": v for c, v in found.items()}).withColumns({c: F.col(f"__own.{c}") for c in changed})
    return d.withColumn("breaks", V.style_break(F.col("letterhead_match"), F.col("layout_prev"), F.col("layout_curr"))).select("file", *_PAGE)


class Decision(StatefulProcessor):
    """One file's pages in order; the fold's state and the pages that wait."""

    def __init__(self, keep_ms: int | None = None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "n int", _PAGE_DDL)
        self.state = handle.getValueState("state", _STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self.state.get()
        at, active, breaks, starts, *ends = tuple(now) if now is not None else (1, False, False, [1], [], [], [])
        starts, best = list(starts), {k: (c, s) for k, c, s in zip(*ends, strict=True)}
        early: dict[int, dict] = {}
        total = None
        for r in rows:
            total = r["total_pages"]
            if r["n"] >= at and r["n"] not in early and not self.waiting.containsKey((r["n"],)):
                early[r["n"]] = {c: r[c] for c in _PAGE}
        out: list[int] = []
        if total == 1 and at == 1:
            out, at = [1], 2
        while True:
            r = early.pop(at, None)
            if r is None and self.waiting.containsKey((at,)):
                r = dict(zip(_PAGE, self.waiting.getValue((at,)), strict=True))
                self.waiting.removeKey((at,))
            if r is None:
                break
            active, breaks = _step(r, active, breaks, starts, best)
            last = at >= r["total_pages"] - 1
            out += [p for p in starts if last or p < at]
            starts = [p for p in starts if not last and p >= at]
            at += 1
            yield from (_start(key[0], p, best) for p in sorted(out))
            out = []
            best = {} if last else {k: v for k, v in best.items() if k >= at - 2}
        for n, r in early.items():
            self.waiting.updateValue((n,), tuple(r.values()))
        self.state.update((at, active, breaks, starts, list(best), [v[0] for v in best.values()], [v[1] for v in best.values()]))
        yield from (_start(key[0], p, best) for p in out)

    def close(self) -> None:
        pass


def _step(r: dict, active: bool, breaks: bool, starts: list[int], best: dict[int, tuple[float, str]]) -> tuple[bool, bool]:
    """Enters what page ``r`` decides into ``starts`` and ``best``; whether a chain is active and the style broken behind it."""
    n = r["n"]
    entered, start, key, conf, is_end = (r[f"{'chained' if active else 'idle'}_{c}"] for c in _OUTCOME)
    offers = []
    if entered:
        if start is not None and start not in starts:
            starts.append(start)
        offers.append((key, conf, r["signal"]))
    if n > 1 and n not in starts and (is_end or breaks) and r["starts_new"]:
        starts.append(n)
        offers.append((n - 1, r["starts_conf"], "start_only_heading"))
    for k, c, s in offers:
        if k not in best or c > best[k][0]:
            best[k] = (c, s)
    return active if r["chain"] is None else r["chain"] == 1, r["breaks"]


def _start(file: str, page: int, best: dict[int, tuple[float, str]]) -> Row:
    conf, signal = best.get(page - 1, (1.0, "none"))
    return Row(file=file, page=page, confidence=conf, signal=signal)


def boundaries(verdicts: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Stream of file, page, confidence and signal of document starts, each as soon as it is final.

    The session needs ``STORE`` as its state store's provider.
    """
    out = T.StructType.fromDDL("file string, page int, confidence double, signal string")
    pages = outcomes(verdicts).withColumn("file", F.col("file").cast("string"))
    found = pages.groupBy("file").transformWithState(Decision(keep_ms), out, outputMode="Append", timeMode="ProcessingTime" if keep_ms else "None")
    return found.withColumn("confidence", boosted(F.col("confidence"), F.col("signal")))
