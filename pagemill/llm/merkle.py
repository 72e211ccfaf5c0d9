"""Merkle manifest of a dataset: a tree per source, and one over the sources' roots.

A leaf is the SHA-256 of a row's fields; H is the lower-case hex SHA-256 of the
concatenated hex digests of a run.  Rows of a source are numbered by (doc_id, leaf);
a level's index divided by the fanout is the parent's, so every level is one
aggregation of at most ``fanout`` children by (source, parent), stored, until each
source has one node.  Those subroots are numbered by source and go the same way.

Proofs come down from the root: a level's runs join their parents' paths and each
child puts its siblings in front, so a path is stored once per run of leaves and
never per leaf.  Joins and groups are by (source, index): a hot source is dealt
over all tasks.

Defined results: a null field is hashed as ``-`` and differs from an empty one; rows
with a null source are a source of their own, the first; null doc_ids come first and
equal ones are ordered by leaf, so repeated rows are leaves of their own with equal
digests; empty and very long texts are hashed whole; an empty table gives no rows;
further columns are neither hashed nor returned, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Workspace, crc32_sql, joined, let, numbered

FIELDS, FANOUT = ("doc_id", "source", "lang", "n_chars", "text"), 16


def _field(value: Column) -> Column:
    s = value.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(text: Column) -> Column:
    """Digest of a row of documents whose text is ``text``."""
    return F.sha2(F.concat(*[_field(text if c == "text" else F.col(c)) for c in FIELDS]), 256)


def _tree(space: Workspace, nodes: DataFrame, keys: list[str], carry: list[str], fanout: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Levels over nodes (keys, idx, n, hash): the runs of every level (keys, up, n, run), and the trees that end there (keys, level, hash).

    Members of the lowest runs also have ``carry``.
    """
    runs, tops, level = [], [], 0
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.where("n = 1").select(*keys, F.lit(level).alias("level"), "hash", *([] if level else carry)))
        if most <= 1:
            return runs, tops
        child = F.struct("idx", "hash", *([] if level else carry))
        run = nodes.where("n > 1").groupBy(*keys, F.floor(F.col("idx") / fanout).alias("up"), "n").agg(F.sort_array(F.collect_list(child)).alias("run"))
        runs.append(space.store(run, f"{name}{level}"))
        nodes = runs[-1].select(*keys, F.col("up").alias("idx"), F.ceil(F.col("n") / fanout).alias("n"), F.sha2(F.array_join(F.col("run.hash"), ""), 256).alias("hash"))
        most, level = -(-most // fanout), level + 1


def _down(runs: DataFrame, above: DataFrame, keys: list[str], fanout: int) -> DataFrame:
    """Members of ``runs`` with their paths: siblings before and after, then those of their parents in ``above`` (keys, idx, path, ...)."""
    rest = [c for c in above.columns if c not in (*keys, "idx", "path")]
    met = joined(runs.drop("n"), above.withColumnRenamed("idx", "up"), [*keys, "up"], grows=False)
    x = met.select(*keys, *rest, "path", "run", F.posexplode("run.idx").alias("pos", "idx"))
    side = lambda start, n: F.array_join(F.slice(F.col("run.hash"), start, n), "")
    own = F.struct(side(F.lit(1), F.col("pos")).alias("before"), side(F.col("pos") + 2, F.lit(fanout)).alias("after"))
    return x.select(*keys, *rest, "idx", F.get("run", F.col("pos")).alias("node"), F.concat(F.array(own), F.col("path")).alias("path"))


def _empty_path() -> Column:
    return F.array().cast("array<struct<before:string,after:string>>")


def prove(docs: DataFrame, claim: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """doc_id, source, leaf, claimed (the leaf with ``claim`` as text), subroot, root and path of every row.

    ``path`` are the siblings (before, after) of each level from the leaf to the root.
    """
    space = Workspace(docs.sparkSession)
    own = leaf(F.col("text"))
    rows = docs.select("doc_id", "source", own.alias("hash"), (own if claim is None else leaf(claim)).alias("claimed"))
    rows = rows.withColumn("claimed", F.when(F.col("claimed") != F.col("hash"), F.col("claimed")))
    rows = space.store(rows, "rows")
    leaves = space.store(numbered(space, rows, ["source"], ["doc_id", "hash"], "dealt"), "leaves")
    space.drop(rows)
    runs, tops = _tree(space, leaves, ["source"], ["doc_id", "claimed"], fanout, "level")
    subroots = tops[0].select("source", F.col("level").alias("depth"), "hash")
    for t in tops[1:]:
        subroots = subroots.union(t.select("source", "level", "hash"))
    subroots = numbered(space, space.store(subroots, "tops"), [], ["source"], "subroots")
    over, last = _tree(space, space.store(subroots, "indexed"), [], ["source", "depth"], fanout, "over")
    # From the root down to the subroots: nodes of a level with the hash that the next needs.
    paths = last[-1].select(F.lit(0).cast("long").alias("idx"), _empty_path().alias("path"), F.col("hash").alias("root"), *(["hash", "source", "depth"] if len(last) == 1 else []))
    for k in range(len(over) - 1, -1, -1):
        met = _down(over[k], paths, [], fanout)
        paths = met.select("idx", "path", "root", *(["node.hash", "node.source", "node.depth"] if k == 0 else []))
    paths = space.store(paths.select("source", "depth", F.lit(0).cast("long").alias("idx"), "path", "root", F.col("hash").alias("subroot")), "paths")
    above = paths.where(F.col("depth") == len(runs)).drop("depth")
    for k in range(len(runs) - 1, 0, -1):
        met = _down(runs[k], above, ["source"], fanout).drop("node").unionByName(paths.where(F.col("depth") == k).drop("depth"))
        above = space.store(met, f"above{k}")
    out = ["doc_id", "source", "leaf", F.coalesce("claimed", "leaf").alias("claimed"), "subroot", "root", "path"]
    alone = joined(tops[0].withColumnRenamed("hash", "leaf"), paths.where("depth = 0").drop("depth", "idx"), ["source"], grows=False).select(*out)
    if not runs:
        return alone
    met = _down(runs[0], above, ["source"], fanout).select("source", "node.doc_id", F.col("node.hash").alias("leaf"), "node.claimed", "subroot", "root", "path")
    return met.select(*out).unionByName(alone)


def siblings(path: Column) -> Column:
    """H of all siblings of a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def fold(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, digest, lambda acc, x: F.sha2(F.concat(x["before"], acc, x["after"]), 256))


def verify(proofs: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root and verified; takes path away."""
    p = proofs.withColumn("__pagemill_p", let(F.col("path"), lambda p: F.struct(siblings(p).alias("proof"), fold(F.col("claimed"), p).alias("folded")))).drop("path")
    return p.withColumn("proof_sha256", F.col("__pagemill_p.proof")).withColumn("folded_root", F.col("__pagemill_p.folded")).drop("__pagemill_p").withColumn("verified", F.col("folded_root") == F.col("root"))


def lowered() -> Column:
    """What tampering makes of every fifth row's text: A-Z lowered."""
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def _oracle(deep: int = 6, over: int = 4) -> str:
    """The same by unrolled levels; a finished tree is handed on unchanged."""
    f = ", ".join(f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end" for c in FIELDS[:-1])
    cut = lambda t: f"sha256(concat({f}, case when text is null then '-' else strlen({t}) || ':' || {t} end))"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    with_ = [
        f"d as (select doc_id, source, {cut('text')} as h, case when text is not null and {crc32_sql('doc_id')} % 5 = 0 then {cut(low)} end as c from documents)",
        "t0 as (select *, row_number() over (partition by source order by doc_id nulls first, h) - 1 as i0, count(*) over (partition by source) as n from d)",
        "a0 as (select source, i0 as i, h, n from t0)",
    ]
    step = lambda keys, a, b: [
        f"{b} as (select {keys} case when n > 1 then i // 16 else 0 end as i, case when n > 1 then sha256(string_agg(h, '' order by i)) else any_value(h) end as h, (n + 15) // 16 as n from {a} group by {keys} case when n > 1 then i // 16 else 0 end, n)"
    ]
    for k in range(deep):
        with_ += step("source,", f"a{k}", f"a{k + 1}")
    with_.append(f"b0 as (select source, row_number() over (order by source nulls first) - 1 as i, h, count(*) over () as n from a{deep})")
    for k in range(over):
        with_ += step("", f"b{k}", f"b{k + 1}")
    # Siblings before and after every node; none where its tree has ended.
    sides = lambda keys, t: (
        f"select {keys} i, n, coalesce(string_agg(h, '') over (partition by {keys} i // 16 order by i rows between unbounded preceding and 1 preceding), '') as l, coalesce(string_agg(h, '') over (partition by {keys} i // 16 order by i rows between 1 following and unbounded following), '') as r from {t}"
    )
    levels = [("source", f"a{k}") for k in range(deep)] + [("", f"b{k}") for k in range(over)]
    with_ += [f"s{j} as ({sides(f'{k},' if k else '', t)})" for j, (k, t) in enumerate(levels)]
    joins, proof, fold_ = [], [], "coalesce(t0.c, t0.h)"
    for j, (k, _) in enumerate(levels):
        at = f"t0.i0 // {16**j}" if k else f"b0.i // {16 ** (j - deep)}"
        joins.append(f"join s{j} on s{j}.i = case when s{j}.n > 1 then {at} else 0 end" + (f" and s{j}.source is not distinct from t0.source" if k else ""))
        proof.append(f"case when s{j}.n > 1 then s{j}.l || s{j}.r else '' end")
    with_.append("f0 as (select t0.doc_id, t0.h as leaf, b0.h as subroot, " + f"b{over}.h as root, {fold_} as v, sha256(concat({', '.join(proof)})) as proof_sha256, " + ", ".join(f"s{j}.n as n{j}, s{j}.l as l{j}, s{j}.r as r{j}" for j in range(len(levels))) + f" from t0 join b0 on b0.source is not distinct from t0.source cross join b{over} {' '.join(joins)})")
    for j in range(len(levels)):
        with_.append(f"f{j + 1} as (select * replace (case when n{j} > 1 then sha256(l{j} || v || r{j}) else v end as v) from f{j})")
    return f"with {', '.join(with_)} select doc_id, leaf, subroot, root, proof_sha256, v as folded_root, v = root as verified from f{len(levels)}"


ORACLE = _oracle()
