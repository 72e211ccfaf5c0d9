"""Asking a model only for what the decision needs: rounds to a fixed point.

Every page's end and style are asked.  All else is asked where the decision comes to
depend on it, which is what a page-by-page fold would ask: a page's steps are walked
as far as its answers are there, and the first one without its answer is a question.
Steps that need other pages (an active appendix chain, a page opened before) wait until
those are settled.  A round asks all files' open questions at once; answers are kept in
a cache, so a run that is stopped goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import verdicts as V
from ..sources.committed import Cache
from ..sources.folders import stored
from .decision import VERDICTS, after_chain, before_chain, boundaries

#: Kinds of questions beyond a page's end and style: the columns that their answers fill.
KINDS = {
    "title_prev": ("title_prev", "id_prev"), "title_cur": ("title_cur", "id_cur"), "title_next": ("title_next", "id_next"), "self_contained_next": ("self_contained_next",), "standalone": ("standalone",),
    "starts_new": ("starts_new", "starts_conf"), "next_starts": ("next_starts", "next_conf"), "confirmed": ("confirmed", "confirm_conf"),
}
_ANSWERS = [c for cols in KINDS.values() for c in cols]
_TYPES = dict(x.split() for x in VERDICTS.split(", "))


def _filled(d: DataFrame) -> DataFrame:
    """Answers that are not there yet as false and 0: what follows from them is not used."""
    return d.withColumns({c: F.coalesce(c, F.lit(0.0) if _TYPES[c] == "double" else F.lit(False)) for c in _ANSWERS})


def _chain_before(d: DataFrame) -> DataFrame:
    """Adds ``active`` and ``sure``: whether a chain is active before a page, and whether that is settled.

    ``chain`` (1 begins, 0 ends) of a page with open questions may be anything (``open``); an
    appendix whose standalone answer is not there (``maybe``) begins one only where none is.
    """
    w = Window.partitionBy("file").orderBy("n")
    upto, before = (w.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    event = F.when(~F.col("open") & ~F.col("maybe"), F.col("chain"))
    d = d.withColumn("__e", event)
    since = {}
    for c in ("open", "maybe"):
        d = d.withColumn(f"__{c}", F.count_if(c).over(upto))
        at = F.coalesce(F.last(F.when(F.col("__e").isNotNull(), F.col(f"__{c}")), ignorenulls=True).over(before), F.lit(0))
        since[c] = F.coalesce(F.lag(f"__{c}").over(w), F.lit(0)) - at
    d = d.withColumn("active", F.coalesce(F.last("__e", ignorenulls=True).over(before), F.lit(0)) == 1)
    return d.withColumn("sure", (since["open"] == 0) & (F.col("active") | (since["maybe"] == 0))).drop("__e", "__open", "__maybe")


def questions(given: DataFrame) -> DataFrame:
    """(file, n, kind) that the decision needs and has no answer to; ``given``: ``VERDICTS`` with nulls where nothing was asked."""
    c = F.col
    d = _filled(given.withColumns({f"has_{k}": c(cols[0]).isNotNull() for k, cols in KINDS.items()})).withColumn("known", F.lit(True))
    asked: dict[str, list[str]] = {k: [] for k in KINDS}

    def need(d: DataFrame, when: Column, kind: str) -> DataFrame:
        name = f"ask_{kind}_{len(asked[kind])}"
        asked[kind].append(name)
        when = F.coalesce(when, F.lit(False))
        return d.withColumn(name, c("known") & when & ~c(f"has_{kind}"))

    def settle(d: DataFrame) -> DataFrame:
        """Behind questions that are asked together: known if all have answers."""
        return d.withColumn("known", c("known") & ~reduce(lambda a, b: a | b, [c(x) for xs in asked.values() for x in xs]))

    gate = c("is_end") & (c("signal") == "titled_id_header")
    places = (("prev", -1), ("cur", 0), ("next", 1))
    for p, k in places:
        d = need(d, gate & (c("signal_page") == c("n") + k), f"title_{p}")
    d = settle(d)
    seen = reduce(lambda a, b: a + b, [F.when(c("signal_page") == c("n") + k, c(f"title_{p}").cast("int") + c(f"id_{p}").cast("int")).otherwise(0) for p, k in places])
    nowhere = gate & (seen == 0)
    for p, k in places:
        d = need(d, nowhere & (c("signal_page") != c("n") + k) & (c("n") + k >= 1), f"title_{p}")
    d = settle(d)
    d = before_chain(d)
    d = need(d, c("is_end") & c("signal").isin(V.END_SIGNALS) & (c("signal_page") == c("n") + 1), "self_contained_next")
    appendix = c("is_end") & F.contains(c("signal"), F.lit("appendix"))
    d = d.withColumn("open", ~c("known")).withColumn("maybe", c("known") & appendix & ~c("has_standalone"))
    d = settle(d)
    d = _chain_before(d).withColumn("known", c("known") & (~appendix | c("sure")))
    d = need(d, appendix & ~c("active"), "standalone")
    d = need(d, appendix & c("active") & (c("n") > 1), "starts_new")
    d = settle(d)
    end = F.when(appendix, F.when(c("active"), (c("n") > 1) & c("starts_new")).otherwise(c("standalone"))).otherwise(c("is_end"))
    d = d.withColumn("__end", end).withColumn("__sign", c("__end") & c("signal").isin(V.SIGNOFF_SIGNALS) & (c("effective_end") == c("n")))
    d = settle(need(d, c("__sign"), "next_starts"))
    conf = F.when(c("__sign") & c("next_starts"), (c("conf") + c("next_conf")) / 2).otherwise(c("conf"))
    d = d.withColumn("__end", c("__end") & (~c("__sign") | c("next_starts"))).withColumn("__low", V.needs_confirmation(c("__end"), conf, c("signal")))
    d = settle(need(d, c("__low"), "confirmed"))
    d = settle(need(d, c("__end") & (~c("__low") | c("confirmed")) & (c("effective_end") + 1 > c("total_pages")), "self_contained_next"))
    # A page may be opened by itself or the two before; then whether it starts a document is not asked.
    w = Window.partitionBy("file").orderBy("n")
    d = after_chain(d)
    d = d.withColumn("__opens", F.when(c("entered") & (c("new_start") <= c("total_pages")), c("new_start")))
    opened = reduce(lambda a, b: a | b, [F.coalesce((c("__opens") if k == 0 else F.lag("__opens", k).over(w)) == c("n"), F.lit(False)) for k in range(3)])
    settled = reduce(lambda a, b: a & b, [c("known") if k == 0 else F.coalesce(F.lag("known", k).over(w), F.lit(True)) for k in range(3)])
    broken = V.style_break(F.lag("letterhead_match").over(w), F.lag("layout_prev").over(w), F.lag("layout_curr").over(w))
    d = d.withColumns({"__opened": opened, "__settled": settled, "__broken": broken}).withColumn("known", c("__settled"))
    d = need(d, (c("n") > 1) & ~c("__opened") & (c("is_end") | c("__broken")), "starts_new")
    kinds = F.array(*[F.when(reduce(lambda a, b: a | b, [c(x) for x in xs]), F.lit(k)) for k, xs in asked.items()])
    return d.select("file", "n", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def with_answers(base: DataFrame, cache: Cache) -> DataFrame:
    """``base`` (file, n, total_pages, end and style) with the answers that the cache has, null where it has none."""
    wide = base.select("file", "n", F.explode(F.array(*[F.lit(k) for k in KINDS])).alias("kind"))
    got = cache.found(wide.withColumn("key", F.concat_ws("/", "file", "n", "kind")))
    first = {k: F.max(F.when(F.col("kind") == k, F.struct("flag", "extra", "conf"))).alias(k) for k in KINDS}
    rows = got.groupBy("file", "n").agg(*first.values())
    d = base.drop(*_ANSWERS).join(rows, ["file", "n"], "left")
    cols = {}
    for k, names in KINDS.items():
        cols[names[0]] = F.col(f"{k}.flag")
        if len(names) > 1:
            cols[names[1]] = F.col(f"{k}.extra") if names[1].startswith("id_") else F.col(f"{k}.conf")
    return d.select(*[x for x in base.columns if x not in _ANSWERS], *[v.alias(n) for n, v in cols.items()]).select(*_TYPES)


def settle_all(base: DataFrame, provider: Callable[[DataFrame], DataFrame], cache: Cache, most: int = 1_000) -> tuple[DataFrame, int]:
    """Asks ``provider`` (file, n, kind -> with flag, extra, conf) in rounds until nothing is open: verdicts, and the number of rounds."""
    for done in range(most):
        given = stored(with_answers(base, cache), f"round{done}")
        todo = stored(questions(given), f"questions{done}")
        if todo.isEmpty():
            return _filled(given), done
        cache.add(provider(todo).withColumn("key", F.concat_ws("/", "file", "n", "kind")))
    raise RuntimeError(f"open questions after {most} rounds")


def decide(base: DataFrame, totals: DataFrame, provider: Callable[[DataFrame], DataFrame], cache: Cache) -> DataFrame:
    """``boundaries`` with as few questions as a page-by-page run asks."""
    return boundaries(settle_all(base, provider, cache)[0], totals)
