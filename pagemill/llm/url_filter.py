"""URL filter: explicit rules first, else empirical-Bayes host reputation (native).

Labelled page outcomes (good or not) are counted per host.  Beta-binomial priors
are fitted by moments: all labels give a suffix its prior, the suffix's posterior
mean gives its registered domains theirs, and those theirs to hosts.  A host is
allowed if the lower posterior bound ``mean - z * sd`` reaches ``min_good``.

Of rules that fit the longest wins; of equally long ones that with the longer host,
and of the same rule given twice with both verdicts the block.

Suffixes are the last label of a host unless ``suffixes`` names longer ones; the
registered domain is the suffix and one label more.  Defined results: a null or
schemeless url has an empty host and path and takes the prior of the empty
suffix; a null outcome is no label; repeated labels count each; repeated pages
each get a row, those with a null page_id too; without any label every bound is
that of Beta(1, 1); an empty table gives none; very long urls are read whole; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, joined

#: The contract's rules: (rule, verdict).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
Z, MIN_GOOD, LEAST, MOST = 1.645, 0.5, 2.0, 200.0
#: Rule lists up to this long become one CASE expression; longer ones are joined.
CASE_RULES = 200


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    has = F.instr(u, "://") > 0
    rest = F.regexp_extract(u, "(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, "(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, "(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def match_rules(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null where no rule fits) to rows with host and path.

    A rule without ``/`` is about its whole host.  A DataFrame of (rule, verdict), or a list above ``CASE_RULES``, is joined on
    the host's suffixes; there each page meets as many keys as its host has labels.
    """
    spark = pages.sparkSession
    if isinstance(rules, list) and len(rules) <= CASE_RULES:
        rule = verdict = F.lit(None).cast("string")
        for r, v in sorted(rules, key=lambda x: (len(x[0]), len(x[0].split("/")[0]), x[1] == "block")):  # the last is tested first
            h, _, p = r.partition("/")
            fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(f"/{p}"))
            rule, verdict = F.when(fits, r).otherwise(rule), F.when(fits, v).otherwise(verdict)
        return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "rule string, verdict string")
    table = table.select(
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.expr("case when instr(rule, '/') = 0 then '/' else substring(rule, instr(rule, '/')) end").alias("start"),
        F.col("rule").alias("__rule"),
        F.col("verdict").alias("__verdict"),
    )
    labels = F.split("host", "\\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (
        pages.select("page_id", "host", "path", F.explode(tails).alias("suffix"))
        .join(table, "suffix")
        .where(F.startswith(F.col("path"), F.col("start")))
        .groupBy(F.col("page_id").alias("__page"), F.col("host").alias("__host"), F.col("path").alias("__path"))
        .agg(F.max(F.struct(F.length("__rule"), F.length("suffix"), F.col("__verdict") == "block", "__rule", "__verdict")).alias("b"))
    )
    on = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("host") == F.col("__host")) & (F.col("path") == F.col("__path"))
    return pages.join(best, on, "left").withColumn("rule", F.col("b.__rule")).withColumn("rule_verdict", F.col("b.__verdict")).drop("__page", "__host", "__path", "b")


def with_domain(df: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``suffix`` and ``domain`` to rows with host."""
    parts = F.split("host", "\\.")
    suffix = F.element_at(parts, -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((F.col("host") == s) | F.endswith(F.col("host"), F.lit(f".{s}")), s).otherwise(suffix)
    df = df.withColumn("suffix", suffix)
    more = F.expr("substring(host, 1, greatest(length(host) - length(suffix) - 1, 0))")
    return df.withColumn("domain", F.when(F.col("host") == F.col("suffix"), F.col("host")).otherwise(F.concat_ws(".", F.substring_index(more, ".", -1), "suffix")))


def _strength() -> Column:
    """Moment estimate of a beta prior's a + b from the groups' own rates, clamped."""
    p = F.sum("good") / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("good") / F.col("n"), 2)) / F.sum("n") - p * p
    noise = p * (1 - p) * F.count(F.lit(1)) / F.sum("n")
    between = spread - noise
    s = F.when(between > 0, F.try_divide(p * (1 - p), between) - 1).otherwise(MOST)
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), s))


def reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """One row per host of ``pages``: labels seen, posterior mean and lower bound.

    ``outcomes``: page_id and good (0, 1 or null).
    """
    host, _ = split_url(F.col("url"))
    hosts = with_domain(pages.select("page_id", host.alias("host")), suffixes)
    o = outcomes.where(F.col("good").isNotNull()).groupBy(F.col("page_id").alias("__page")).agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"))
    per_host = (
        hosts.join(o, hosts["page_id"] == o["__page"], "left")
        .groupBy("host", "domain", "suffix")
        .agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"))
    )
    per_domain = per_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    per_suffix = per_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # Four numbers fitted over all labels; the only thing the driver sees.
    levels = [t.where("n > 0").select(F.lit(k).alias("level"), "n", "good") for k, t in enumerate((per_suffix, per_domain, per_host), 1)]
    fits = {r["level"]: r for r in levels[0].union(levels[1]).union(levels[2]).groupBy("level").agg(_strength().alias("s"), (F.sum("good") / F.sum("n")).alias("p")).collect()}
    s1, s2, s3 = (F.lit(fits[k]["s"] if k in fits else LEAST) for k in (1, 2, 3))
    p = F.lit(fits[1]["p"] if 1 in fits else 0.5)
    suf = per_suffix.select("suffix", ((F.col("good") + s1 * p) / (F.col("n") + s1)).alias("m1"))
    dom = joined(per_domain, suf, ["suffix"], grows=False)
    dom = dom.select("domain", ((F.col("good") + s2 * F.col("m1")) / (F.col("n") + s2)).alias("m2"))
    a, b = F.col("good") + s3 * F.col("m2"), F.col("n") - F.col("good") + s3 * (1 - F.col("m2"))
    mean = a / (a + b)
    bound = mean - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    out = joined(per_host, dom, ["domain"])
    return out.select("host", F.col("n").alias("host_labels"), mean.alias("reputation"), bound.alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] | DataFrame = RULES, min_good: float = MIN_GOOD, suffixes: tuple[str, ...] = ()) -> DataFrame:
    """Every page's host, path, rule, reputation, bound and verdict."""
    host, path = split_url(F.col("url"))
    p = match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    rep = reputation(pages, outcomes, suffixes)
    out = joined(p, rep, ["host"], "left")
    method = F.when(F.col("bound") >= min_good, "allow").otherwise("block")
    return out.select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"), "host_labels",
        F.round("reputation", 6).alias("reputation"), F.round("bound", 6).alias("bound"),
    )


ORACLE = r"""
with u as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0 then regexp_extract(url, '(?s)^.*?://(.*)$', 1) else '' end as rest from pages),
p as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) as path from u),
q as (
  select *, case when starts_with(path, '/en/') and (host = 'www.example.com' or host like '%.www.example.com') then 'www.example.com/en/'
    when starts_with(path, '/en/') and (host = 'example.com' or host like '%.example.com') then 'example.com/en/'
    when starts_with(path, '/es/') and (host = 'net' or host like '%.net') then 'net/es/'
    when starts_with(path, '/fr/') and (host = 'net' or host like '%.net') then 'net/fr/'
    when starts_with(path, '/') and (host = 'com' or host like '%.com') then 'com/' end as rule,
    string_split(host, '.')[-1] as suffix,
    case when len(string_split(host, '.')) = 1 then host else array_to_string(string_split(host, '.')[-2:], '.') end as domain
  from p),
lab as (select doc_id as page_id, count(*) as n, sum(quality) as good from labels where quality is not null group by doc_id),
h as (select host, domain, suffix, sum(coalesce(n, 0)) as n, sum(coalesce(good, 0)) as good from q left join lab using (page_id) group by all),
d as (select domain, suffix, sum(n) as n, sum(good) as good from h group by all),
s as (select suffix, sum(n) as n, sum(good) as good from d group by all),
lv as (select 1 as l, n, good from s where n > 0 union all select 2, n, good from d where n > 0 union all select 3, n, good from h where n > 0),
mo as (
  select l, sum(good) / sum(n) as p, sum(n * pow(good / n, 2)) / sum(n) - pow(sum(good) / sum(n), 2)
    - (sum(good) / sum(n)) * (1 - sum(good) / sum(n)) * count(*) / sum(n) as between_var from lv group by l),
st as (select l, p, least(200.0, greatest(2.0, case when between_var > 0 then p * (1 - p) / between_var - 1 else 200.0 end))::double as s from mo),
f as (select coalesce(max(p) filter (l = 1), 0.5) as p, coalesce(max(s) filter (l = 1), 2.0) as s1, coalesce(max(s) filter (l = 2), 2.0) as s2,
  coalesce(max(s) filter (l = 3), 2.0) as s3 from st),
ms as (select suffix, (good + s1 * p) / (n + s1) as m1 from s, f),
md as (select domain, (good + s2 * m1) / (n + s2) as m2 from d join ms using (suffix), f),
ab as (select host, n, good + s3 * m2 as a, n - good + s3 * (1 - m2) as b from h join md using (domain), f),
r as (select host, n, a / (a + b) as reputation, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as bound from ab)
select page_id, q.host, path, rule,
  case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' when bound >= 0.5 then 'allow' else 'block' end as verdict,
  n::bigint as host_labels, round(reputation, 6) as reputation, round(bound, 6) as bound
from q join r using (host)
"""
