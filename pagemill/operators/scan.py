"""Ordered scans of a log of any length: no task holds a whole section.

Lines are dealt by ranges of (section, order).  A part finds last and next values and
counts within itself; a part's own last value, first value and count are one row, and
what they carry into the other parts of their section is a window over parts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.folders import stored

KINDS = ("last", "last_before", "next", "count", "count_before")


def scan(df: DataFrame, section: list[str], seq: list[str], /, **wanted: tuple[str, Column]) -> DataFrame:
    """Adds a column for each of ``wanted``: (kind, value), by order ``seq`` within ``section``.

    last: the last non-null value up to this row; last_before: without it; next: the
    first from this row on; count, count_before: how many non-null values there are.
    Nulls of ``section`` are a section, those of ``seq`` come first.
    """
    if bad := {k for k, _ in wanted.values()} - set(KINDS):
        raise ValueError(f"unknown kinds {bad}")
    by = [*section, *seq]
    value = {name: f"__v_{name}" for name in wanted}
    dealt = df.withColumns({value[n]: v for n, (_, v) in wanted.items()}).repartitionByRange(*by)
    dealt = stored(dealt.withColumn("__part", F.spark_partition_id()), "lines")
    own, parts = Window.partitionBy("__part", *section), Window.partitionBy(*section)
    upto, before = (own.orderBy(*seq).rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    back = own.orderBy(*[F.desc(c) for c in seq]).rowsBetween(Window.unboundedPreceding, 0)
    order = F.struct(*seq)
    local, of_part, carry = {}, [], {}
    for n, (kind, _) in wanted.items():
        v = F.col(value[n])
        edge = F.when(v.isNotNull(), F.struct(order.alias("o"), v.alias("v")))
        if kind.startswith("count"):
            local[n], x, how = F.count(v).over(upto if kind == "count" else before), F.count(v), F.sum
        elif kind == "next":
            local[n], x, how = F.last(v, ignorenulls=True).over(back), F.min(edge)["v"], None
        else:
            local[n], x, how = F.last(v, ignorenulls=True).over(upto if kind == "last" else before), F.max(edge)["v"], None
        of_part.append(x.alias(f"__c_{n}"))
        w = parts.orderBy(F.desc("__part") if kind == "next" else F.asc("__part")).rowsBetween(Window.unboundedPreceding, -1)
        carry[n] = how(f"__c_{n}").over(w) if how else F.last(f"__c_{n}", ignorenulls=True).over(w)
    keys = [f"__k{i}" for i in range(len(section))]
    carried = dealt.groupBy("__part", *section).agg(*of_part).select(F.col("__part").alias("__p"), *[F.col(c).alias(k) for c, k in zip(section, keys, strict=True)], *[c.alias(f"__c_{n}") for n, c in carry.items()])
    met = reduce(lambda c, kc: c & F.col(kc[0]).eqNullSafe(F.col(kc[1])), zip(section, keys, strict=True), F.col("__part") == F.col("__p"))
    out = dealt.withColumns({f"__l_{n}": c for n, c in local.items()}).join(carried, met)
    found = [(F.coalesce(f"__l_{n}", F.lit(0)) + F.coalesce(f"__c_{n}", F.lit(0)) if kind.startswith("count") else F.coalesce(f"__l_{n}", f"__c_{n}")).alias(n) for n, (kind, _) in wanted.items()]
    return out.select(*[c for c in df.columns if c not in wanted], *found)
