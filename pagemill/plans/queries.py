"""One query per operator over the driver's tables, with its DuckDB oracle.

Stand-ins: a conversation is a page sequence (file = conv_id, page = turn + 1), a
user's events are a log section ordered by (ts, event_id), orders are pages with
rotation, parts and nations are codes and names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import verdicts as V
from ..operators import logs as L
from ..operators import matching as M
from ..operators import scoring as S
from ..operators import truth as R
from ..operators.scan import scan
from ..sources import sinks
from . import decision as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("page"), "role", "text")


def truth_pred(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Truth: user turns and page 1.  Prediction: the role changes."""
    t = turns(spark, sf)
    w = Window.partitionBy("file").orderBy("page")
    pred = t.withColumn("prev", F.lag("role").over(w)).where("prev is null or prev <> role")
    return t.where("role = 'user' or page = 1").select("file", "page"), pred.select("file", "page")


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return turns(spark, sf).groupBy("file").agg(F.max("page").cast("int").alias("total_pages"))


def strata(df: DataFrame) -> DataFrame:
    return df.select("file").distinct().select("file", F.concat(F.lit("s"), F.pmod("file", F.lit(3))).alias("stratum"))


TP = """
t as (select conv_id as file, turn + 1 as page, role, text from conversations),
tr as (select distinct file, page from t where role = 'user' or page = 1),
pr as (select file, page from (select *, lag(role) over (partition by file order by page) as prev from t) where prev is null or prev <> role),
cmp as (select coalesce(tr.file, pr.file) as file, coalesce(tr.page, pr.page) as page, tr.file is not null as in_truth, pr.file is not null as in_pred
  from tr full join pr on tr.file = pr.file and tr.page = pr.page),
tot as (select file, max(page)::int as total_pages from t group by file)"""
CNT = "count(*) filter (in_truth and in_pred) as tp, count(*) filter (not in_truth and in_pred) as fp, count(*) filter (in_truth and not in_pred) as fn"
PRF = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1"""


def _stratum_sql(where: str) -> str:
    return f"""with {TP}, g as (select case when grouping(s) = 1 then 'ALL' else s end as stratum, {CNT}
    from (select *, 's' || (file % 3) as s from cmp where {where}) group by rollup(s))
  select stratum, tp, fp, fn, {PRF} from g"""


@query(_stratum_sql("page <> 1"))
def boundary_prf_by_stratum(spark, sf):
    """O-J1, O-A1..A3, O-P1: page 1 is free and not scored."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1")
    return S.by_stratum(c, strata(c))


@query(_stratum_sql("true"))
def boundary_prf_incl_first(spark, sf):
    """T1: the older definition counts page 1."""
    c = S.compare(*truth_pred(spark, sf))
    return S.by_stratum(c, strata(c))


@query(_stratum_sql("page <> 1 and not (file % 5 = 0 and page between 2 and 3)"))
def masked_scoring(spark, sf):
    """O-P2: inclusive page ranges leave both sides."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1")
    masks = c.select("file").distinct().where("file % 5 = 0").select("file", F.lit(2).alias("lo"), F.lit(3).alias("hi"))
    c = S.drop_masked(c, masks)
    return S.by_stratum(c, strata(c))


@query(f"""with {TP}, c as (select *, (in_pred and not in_truth and (file * 31 + page) % 4 = 0) as waived from cmp where page <> 1),
  g as (select count(*) filter (in_truth and in_pred) as tp, count(*) filter (not in_truth and in_pred) as fp, count(*) filter (in_truth and not in_pred) as fn,
    count(*) filter (waived) as n_waived from c)
  select tp, fp, fn, n_waived, round(2 * tp / (2 * tp + fp + fn), 6) as f1_strict, round(2 * tp / (2 * tp + fp - n_waived + fn), 6) as f1_waived from g""")
def waived_scoring(spark, sf):
    """O-P3, O-A5: waivers remove false positives only; both variants in one pass."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1")
    waivers = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), (F.col("turn") + 1).alias("page")).where("(file * 31 + page) % 4 = 0").distinct()
    w = c.join(waivers.withColumn("w", F.lit(True)), ["file", "page"], "left").withColumn("waived", F.coalesce("w", F.lit(False)) & F.col("in_pred") & ~F.col("in_truth"))
    g = w.agg(*S.counts(), F.count_if("waived").alias("n_waived"))
    f1 = lambda fp: F.round(S.ratio(2 * F.col("tp"), 2 * F.col("tp") + fp + F.col("fn")), 6)
    return g.withColumn("f1_strict", f1(F.col("fp"))).withColumn("f1_waived", f1(F.col("fp") - F.col("n_waived")))


@query(f"""with {TP}, ti as (select file, page, coalesce(lead(page) over (partition by file order by page) - 1, total_pages) as e from tr join tot using (file)),
  pi as (select file, page, coalesce(lead(page) over (partition by file order by page) - 1, total_pages) as e from (select distinct file, page from pr) join tot using (file))
  select count(pi.file) as docs_exact, count(*) as docs_total from ti left join pi using (file, page, e)""")
def docs_exact(spark, sf):
    """O-J3, O-W2, O-A16."""
    t, p = truth_pred(spark, sf)
    return S.docs_exact(t, p, totals(spark, sf))


MANIFEST_SQL = f"""with {TP}, i as (select tr.file, tr.page as start, coalesce(lead(tr.page) over w - 1, total_pages) as e, row_number() over w as ordinal
    from tr join tot on tot.file = tr.file window w as (partition by tr.file order by tr.page)),
  d as (select i.*, (i.start * 100)::int as code, t.text as name, (i.file % 10) / 10 < 0.8 and i.start <> 1 as flagged from i join t on t.file = i.file and t.page = i.start)
  select file, start::bigint as start, e::bigint as "end", ordinal::int as ordinal,
    'f' || file || '_' || lpad(ordinal::varchar, 3, '0') || '_' || lpad(code::varchar, 5, '0') || '_' ||
    regexp_replace(trim(regexp_replace(name, '[/\\\\:*?"<>|]', '-', 'g'), chr(32) || chr(9) || chr(10) || chr(13)), '\\s+', '_', 'g')[1:50] || case when flagged then '_REVIEW' else '' end || '.pdf' as out_name,
    case when start = e then 'page ' || start else 'pages ' || start || '–' || e end as pages from d"""


@query(MANIFEST_SQL)
def doc_ranges_manifest(spark, sf):
    """O-W2, O-W3, O-F9, O-F10, O-P4, O-K1: one output per document."""
    t, _ = truth_pred(spark, sf)
    d = S.intervals(t, totals(spark, sf)).join(turns(spark, sf).select("file", F.col("page").alias("start"), F.col("text").alias("name")), ["file", "start"])
    d = d.withColumn("code", (F.col("start") * 100).cast("int")).withColumn("flagged", V.review_flag(F.pmod("file", F.lit(10)) / 10, F.col("start")))
    named = sinks.manifest(d.withColumn("file", F.concat(F.lit("f"), F.col("file"))))
    return named.withColumn("file", F.substring("file", 2, 20).cast("bigint")).select("file", F.col("start").cast("bigint"), F.col("end").cast("bigint"), "ordinal", "out_name", "pages")


@query(f"""with {TP} select file, page, concat_ws(',', lag(page) over w, page, lead(page) over w) as context, coalesce(lag(role) over w, 'none') as prev_role,
  coalesce(lead(role) over w, 'none') as next_role from t window w as (partition by file order by page)""")
def page_context_window(spark, sf):
    """O-W1, O-W4: pages before, at and after, and a neighbour's attribute."""
    w = Window.partitionBy("file").orderBy("page")
    context = F.array_join(F.collect_list("page").over(w.rowsBetween(-1, 1)), ",")
    return turns(spark, sf).select("file", "page", context.alias("context"), F.coalesce(F.lag("role").over(w), F.lit("none")).alias("prev_role"), F.coalesce(F.lead("role").over(w), F.lit("none")).alias("next_role"))


@query("""with c as (select distinct o_custkey as file, datediff('day', timestamp '1992-01-01', o_orderdate) // 20 as page from orders), t as (select file, max(page) + file % 3 as total from c group by file),
  g as (select t.file, p.page from t, generate_series(2, (select max(total) from t)) p(page) where p.page <= total and not exists (select 1 from c where c.file = t.file and c.page = p.page)),
  i as (select *, page - row_number() over (partition by file order by page) as k from g) select file, (min(page) - 1)::bigint as lo, (max(page) + 1)::bigint as hi from i group by file, k""")
def gap_runs(spark, sf):
    """O-W5: runs of 20-day spans without an order, one span wider on both sides; the first and last ones too."""
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.floor(F.datediff("o_orderdate", F.lit("1992-01-01")) / 20).alias("page"))
    t = c.groupBy("file").agg((F.max("page") + F.col("file") % 3).alias("total_pages"))
    return R.gap_runs(c, t, margin=1)


PIECES_SQL = f"""{TP}, pc as (select file, page as start_page, 1 + page % 2 as n_pages from t where (file + page) % 3 = 0),
  cov as (select distinct file, page from (select file, unnest(generate_series(start_page, start_page + n_pages - 1)) as page from pc)),
  allp as (select file, unnest(generate_series(1, total_pages)) as page from tot),
  gap as (select * from allp anti join cov using (file, page))"""


def _pieces(spark, sf) -> DataFrame:
    return turns(spark, sf).where("(file + page) % 3 = 0").select("file", F.col("page").cast("int").alias("start_page"), (1 + F.col("page") % 2).cast("int").alias("n_pages"))


@query(f"""with {PIECES_SQL}, f as (select file, page from (select *, lag(page) over (partition by file order by page) as prev from gap) where prev is null or prev < page - 1)
  select file, page::bigint as page from (select file, start_page as page from pc union select file, page from f union select file, 1 from tot)""")
def coverage_starts(spark, sf):
    """O-W6, O-J16: starts of pieces and of uncovered runs."""
    return R.coverage_starts(_pieces(spark, sf), totals(spark, sf)).select("file", F.col("page").cast("bigint"))


@query(f"with {PIECES_SQL} select file, page::bigint as page from gap")
def uncovered_pages(spark, sf):
    """O-J16: pages in no piece."""
    return R.uncovered(_pieces(spark, sf), totals(spark, sf)).select("file", F.col("page").cast("bigint"))


@query(f"""with {PIECES_SQL}, o as (select file, start_page + i as page, start_page, ((file + i) % 4) * 90 as split_deg from pc, generate_series(0, 1) g(i) where i < n_pages)
  select t.file, t.page, coalesce((360 - (split_deg - ((t.page % 4) * 90) + 360) % 360) % 360, 0)::bigint as deg
  from t left join (select file, page, max(split_deg) as split_deg from o group by all) o on o.file = t.file and o.page = t.page""")
def rotation_truth(spark, sf):
    """O-J15, O-F22, O-S8: pieces' pages mapped back to original pages, metadata change to counter-clockwise degrees."""
    p = _pieces(spark, sf).select("file", "start_page", F.explode(F.expr("sequence(0, n_pages - 1)")).alias("i"))
    split = p.groupBy("file", (F.col("start_page") + F.col("i")).cast("bigint").alias("page")).agg(F.max((F.col("file") + F.col("i")) % 4 * 90).alias("split_deg"))
    t = turns(spark, sf).select("file", F.col("page").cast("bigint").alias("page"))
    return t.join(split, ["file", "page"], "left").select("file", "page", F.coalesce(V.ccw(F.col("page") % 4 * 90, F.col("split_deg")), F.lit(0)).cast("bigint").alias("deg"))


@query("""with c as (select quality = 1 as in_truth, n_chars >= 500 as in_pred, lang from labels join documents using (doc_id)),
  g as (select lang, count(*) filter (in_truth and in_pred) as tp, count(*) filter (not in_truth and in_pred) as fp, count(*) filter (in_truth and not in_pred) as fn from c group by lang)
  select lang, tp, fp, fn, """ + PRF + " from g")
def label_prf(spark, sf):
    """O-A2 on labels: quality as truth, length as prediction."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    c = table(spark, sf, "labels").join(d, "doc_id").select("lang", (F.col("quality") == 1).alias("in_truth"), (F.col("n_chars") >= 500).alias("in_pred"))
    return S.prf(c.groupBy("lang").agg(*S.counts()))


@query("""with c as (select o_orderpriority as file, (o_orderkey % 4) * 90 as t, (o_custkey % 4) * 90 as p from orders)
  select file, count(*) filter (t <> 0 and t = p) as tp, count(*) filter (p <> 0 and t <> p) as fp, count(*) filter (t <> 0 and t <> p) as fn from c group by file""")
def rotation_degree_exact(spark, sf):
    """O-J5: a wrong angle counts on both sides."""
    c = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), (F.col("o_orderkey") % 4 * 90).alias("true_deg"), (F.col("o_custkey") % 4 * 90).alias("pred_deg"))
    return S.rotation_counts(c, ["file"])


@query("""with c as (select o_orderpriority as file, o_orderkey % 4 <> 0 as in_truth, o_custkey % 4 <> 0 as in_pred from orders)
  select file, """ + CNT + " from c group by file")
def rotation_presence(spark, sf):
    """O-J4: rotated or not, whatever the angle."""
    c = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("file"), (F.col("o_orderkey") % 4 != 0).alias("in_truth"), (F.col("o_custkey") % 4 != 0).alias("in_pred"))
    return c.groupBy("file").agg(*S.counts())


@query("""with recursive s as (select conv_id as file, (turn + 1)::int as page, ((conv_id * 7 + turn * turn * 5 + turn) % 3 % 2 * 90)::int as deg from conversations),
  f(file, page, deg) as (
    select file, page, deg from s where page = 1
    union all
    select s.file, s.page, case when n.file is null then s.deg when s.deg = 0 and f.deg <> 0 and f.deg = n.deg then f.deg
      when s.deg <> 0 and f.deg = 0 and n.deg = 0 then 0 else s.deg end
    from f join s on s.file = f.file and s.page = f.page + 1 left join s n on n.file = s.file and n.page = s.page + 1)
  select file, page, deg from f""")
def rotation_smooth(spark, sf):
    """O-W8: in-place smoothing, later pages see earlier changes."""
    t = turns(spark, sf)
    turn = F.col("page") - 1
    return R.smooth(t.select("file", F.col("page").cast("int").alias("page"), ((F.col("file") * 7 + turn * turn * 5 + turn) % 3 % 2 * 90).cast("int").alias("deg")))


@query("""with s as (select conv_id as file, (turn + 1)::int as page, case when (conv_id + turn + 1) % 4 < 2 then 90 else 0 end as deg from conversations),
  r as (select file, min(page) as lo, max(page) as hi, arg_min(deg, page) as d from (select *, page - row_number() over (partition by file order by page) as i from s where deg <> 0) group by file, i having count(*) > 1)
  select s.file, s.page, case when s.deg <> 0 or (s.file * s.page) % 2 <> 1 then s.deg else coalesce((select d from r where r.file = s.file and r.hi = s.page - 1), (select d from r where r.file = s.file and r.lo = s.page + 1), s.deg) end as deg from s""")
def rotation_extend(spark, sf):
    """O-W7: runs of two rotated pages or more take in a corroborated upright page on either side."""
    t = turns(spark, sf)
    rot = t.select("file", F.col("page").cast("int").alias("page"), (F.when((F.col("file") + F.col("page")) % 4 < 2, 90).otherwise(0)).alias("deg"))
    return R.extend_runs(rot, t.where("(file * page) % 2 = 1").select("file", F.col("page").cast("int").alias("page"), F.lit(90).alias("deg")))


@query("""select page_id, (page_id % 4) * 90 as orientation, case when (page_id * 13) % 100 / 10 >= 3 then (page_id % 4) * 90 else 0 end as osd_deg,
  round(least(0.95, (page_id * 13) % 100 / 10 / 10), 6) as osd_conf, case when (page_id * 7) % 4 <> 0 and (page_id * 17) % 101 < 95 then 0 else ((page_id * 7) % 4) * 90 end as model_deg,
  case when (page_id * 13) % 100 / 10 < 3 or page_id % 4 = 0 then 0 when (page_id * 7) % 4 <> 0 then ((page_id * 7) % 4) * 90 else (page_id % 4) * 90 end as both_deg,
  case when length(url) > 1.15 * 40 then 90 else 0 end as aspect_deg from pages""")
def rotation_decisions(spark, sf):
    """O-F23..F26: detector, model, both, and the aspect rule."""
    p = table(spark, sf, "pages")
    pid = F.col("page_id")
    orient, oconf, model, mconf = pid % 4 * 90, (pid * 13) % 100 / 10, (pid * 7) % 4 * 90, (pid * 17) % 101
    osd = V.osd_degrees(orient, oconf)
    return p.select(
        "page_id", orient.alias("orientation"), F.coalesce(osd, F.lit(0)).alias("osd_deg"), F.round(V.osd_confidence(oconf), 6).alias("osd_conf"),
        V.model_rotation(model, mconf).alias("model_deg"), V.corroborated_rotation(model, osd != 0, osd).alias("both_deg"), V.aspect_rotation(F.length("url"), F.lit(40)).alias("aspect_deg"),
    )


NORM = r"""list_filter(string_split_regex(regexp_replace(translate(lower({0}), 'aeopcxybhtmk', 'аеорсхувнтмк'), '["''«»“”„`’‘()\[\]{{}}.,;:!?/\\|№#*+\-–—_]+', ' ', 'g'), '\s+'), lambda x: x <> '')"""
TRI = "list_distinct([('  ' || {0} || ' ')[i:i+2] for i in range(1, length({0}) + 2)])"
TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query(f"select page_id, array_to_string({NORM.format(TITLE)}, '') as squashed, len({NORM.format(TITLE)})::int as n_tokens from pages")
def title_norm(spark, sf):
    """O-F11, O-F12."""
    tokens = T.title_tokens(F.regexp_extract("html", "<title>(.*?)</title>", 1))
    return table(spark, sf, "pages").select("page_id", T.squash(tokens).alias("squashed"), F.size(tokens).alias("n_tokens"))


PAIR_SQL = f"""a as (select page_id, array_to_string({NORM.format(TITLE)}, '') as q from pages),
  b as (select p_partkey, array_to_string({NORM.format("p_name || ' ' || p_type")}, '') as e from part),
  ab as (select page_id, q, e from a join b on p_partkey = page_id)"""


def _pairs(spark, sf) -> DataFrame:
    q = table(spark, sf, "pages").select("page_id", T.squash(T.title_tokens(F.regexp_extract("html", "<title>(.*?)</title>", 1))).alias("q"))
    e = table(spark, sf, "part").select(F.col("p_partkey").alias("page_id"), T.squash(T.title_tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("e"))
    return q.join(e, "page_id")


@query(f"""with {PAIR_SQL}, g as (select *, {TRI.format('q')} as tq, {TRI.format('e')} as te from ab)
  select page_id, round(case when q = '' or e = '' then 0 else len(list_intersect(tq, te)) / len(list_distinct(tq || te)) end, 6) as score from g""")
def trigram_jaccard(spark, sf):
    """O-F13, O-F14."""
    return _pairs(spark, sf).select("page_id", F.round(T.trigram_jaccard(F.col("q"), F.col("e")), 6).alias("score"))


@query(f"""with {PAIR_SQL}, s as (select page_id, q, e from ab union all select page_id, q, q[1:greatest(1, length(q) // 2 + page_id % 3 - 1)] from ab)
  select page_id, count(*) filter (least(length(q), length(e)) >= 5 and least(length(q), length(e)) >= 0.45 * greatest(length(q), length(e)) and (contains(q, e) or contains(e, q))) as n_contained from s group by page_id""")
def containment(spark, sf):
    """O-F16: against a name, and against a part of itself about half as long."""
    p = _pairs(spark, sf)
    half = F.substring(F.col("q"), F.lit(1), F.greatest(F.lit(1), (F.floor(F.length("q") / 2) + F.col("page_id") % 3 - 1)).cast("int"))
    s = p.select("page_id", "q", "e").union(p.select("page_id", "q", half.alias("e")))
    return s.groupBy("page_id").agg(F.count_if(T.contained(F.col("q"), F.col("e"))).alias("n_contained"))


def _nomenclature(spark, sf) -> DataFrame:
    """Names of part kinds in a fixed order: a table of some dozens of rows at any scale factor."""
    kinds = table(spark, sf, "part").groupBy(F.concat_ws(" ", "p_name", "p_type").alias("name")).agg(F.min("p_partkey").alias("code"))
    return kinds.withColumn("idx", F.row_number().over(Window.orderBy("name")))


def _titles(spark, sf) -> DataFrame:
    """Noisy names: a letter dropped, an identifier added, two words only, or a word of a page."""
    p = table(spark, sf, "part")
    full = F.concat_ws(" ", "p_name", "p_type")
    k = F.col("p_partkey") % 4
    noisy = F.when(k == 0, full).when(k == 1, F.concat(F.substring(full, 1, 3), F.expr("substring(concat_ws(' ', p_name, p_type), 5)"))).when(k == 2, F.concat(full, F.lit(" №12/3"))).otherwise(F.col("p_name"))
    return p.select(noisy.alias("title"))


MATCH_SQL = f"""kinds as (select p_name || ' ' || p_type as name, min(p_partkey) as code from part group by 1),
  nom as (select name, code, row_number() over (order by name) as idx, array_to_string({NORM.format('name')}, '') as e from kinds),
  ti as (select distinct case p_partkey % 4 when 0 then f when 1 then f[1:3] || f[5:] when 2 then f || ' №12/3' else p_name end as title
    from (select p_partkey, p_name, p_name || ' ' || p_type as f from part)),
  q as (select title, array_to_string({NORM.format("array_to_string(list_filter(string_split_regex(title, chr(92) || 's+'), lambda t: not regexp_matches(t, '[0-9№#]')), ' ')")}, '') as q from ti),
  sc as (select title, idx, name, (q <> '' and q = e)::int as exact, (q <> '' and least(length(q), length(e)) >= 5 and least(length(q), length(e)) >= 0.45 * greatest(length(q), length(e))
     and (contains(q, e) or contains(e, q)))::int as containment, {TRI.format('q')} as tq, {TRI.format('e')} as te, q from q, nom where e <> ''),
  s2 as (select *, case when q = '' then 0 else len(list_intersect(tq, te)) / len(list_distinct(tq || te)) end as tri from sc),
  rk as (select *, row_number() over (partition by title order by exact desc, containment desc, tri desc, idx) as rank from s2)"""
MATCH_OUT = """select title, rank::int as rank, idx::int as idx, name, exact, containment, round(tri, 4) as trigram,
  case when exact = 1 or containment = 1 or round(tri, 4) >= 0.74 then 'MATCH' when round(tri, 4) >= 0.5 then 'AMBIGUOUS' else 'NONE' end as band from rk where rank <= """


@query(f"with {MATCH_SQL} {MATCH_OUT} 1")
def title_best_match(spark, sf):
    """O-J8, O-W12, O-F17 without the fuzzy token score."""
    return M.top(_titles(spark, sf), _nomenclature(spark, sf), 1, fuzzy=False).drop("token_set")


@query(f"with {MATCH_SQL} {MATCH_OUT} 3")
def title_topk(spark, sf):
    """O-W12: three candidates per title."""
    return M.top(_titles(spark, sf), _nomenclature(spark, sf), 3, fuzzy=False).drop("token_set")


@query(None)
def title_best_match_full(spark, sf):
    """O-F15 included; tests hold the ratio against the standard library."""
    return M.top(_titles(spark, sf), _nomenclature(spark, sf), 1)


CODES_SQL = """nom as (select (n_regionkey * 1000 + n_nationkey)::int as code, n_name as name from nation union all select (r_regionkey * 1000 + 999)::int, r_name || ' rest' from region where r_regionkey < 3
    union all select 19999, 'unknown')"""


def _code_table(spark, sf) -> DataFrame:
    n = table(spark, sf, "nation").select((F.col("n_regionkey") * 1000 + F.col("n_nationkey")).cast("int").alias("code"), F.col("n_name").alias("name"))
    r = table(spark, sf, "region").where("r_regionkey < 3").select((F.col("r_regionkey") * 1000 + 999).cast("int").alias("code"), F.concat("r_name", F.lit(" rest")).alias("name"))
    return n.union(r).union(spark.createDataFrame([(19999, "unknown")], "code int, name string"))


@query(f"""with {CODES_SQL}, c as (select p_partkey, case when p_partkey % 7 = 0 then 'n/a' else ((p_partkey % 6) * 1000 + p_size) || ' ' || p_name end as answer from part),
  d as (select *, coalesce(try_cast(regexp_extract(trim(answer), '^\\d+', 0) as int), 19999) as code from c)
  select p_partkey, d.code, coalesce(a.code, b.code, 19999) as resolved, coalesce(a.name, b.name, 'unknown') as resolved_name
  from d left join nom a on a.code = d.code left join nom b on b.code = d.code // 1000 * 1000 + 999""")
def code_resolve(spark, sf):
    """O-F1, O-F4."""
    answer = F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise(F.concat(((F.col("p_partkey") % 6) * 1000 + F.col("p_size")).cast("string"), F.lit(" "), "p_name"))
    return M.resolve_codes(table(spark, sf, "part").select("p_partkey", V.leading_int(answer).alias("code")), _code_table(spark, sf))


@query(f"with {CODES_SQL} select (code // 1000 * 1000)::int as category, string_agg(code || ' ' || name, '; ' order by code, name) as listed from nom group by 1")
def listagg_nomenclature(spark, sf):
    """O-F27."""
    return M.categories(_code_table(spark, sf))


@query(r"""with r as (select event_id, event_id % 6 as v, regexp_extract(props, '(\d+)', 1)::int as k from events)
  select event_id, case when v in (0, 1, 2, 5) then k end::bigint as k, case when v in (0, 1, 2, 5) then least(100.0, greatest(0.0, k * 1.5)) / 100 else 0.5 end as conf,
    case when v = 2 then true when v in (0, 1, 5) then k % 2 = 1 else false end as is_end from r""")
def json_verdict_parse(spark, sf):
    """O-F2, O-F3, O-F5, D3, T2: fenced, thinking, quoted booleans, broken and missing objects."""
    e = table(spark, sf, "events")
    k = F.regexp_extract("props", "(\\d+)", 1).cast("int")
    flag = F.when(k % 2 == 1, "true").otherwise("false")
    obj = F.concat(F.lit('{"k": '), k, F.lit(', "confidence": '), (k * 1.5).cast("string"), F.lit(', "end": '), flag, F.lit("}"))
    quoted = F.concat(F.lit('{"k": '), k, F.lit(', "confidence": '), (k * 1.5).cast("string"), F.lit(', "end": "false"}'))
    v = F.col("event_id") % 6
    raw = (
        F.when(v == 0, obj).when(v == 1, F.concat(F.lit("<think>{maybe}</think>\n```json\n"), obj, F.lit("\n```"))).when(v == 2, quoted)
        .when(v == 3, F.concat(F.lit('{"k": '), k)).when(v == 4, F.lit("no answer")).otherwise(F.concat(F.lit("Answer: "), obj, F.lit(" done")))
    )
    d = e.select("event_id", raw.alias("raw"))
    return d.select(
        "event_id", V.json_field(F.col("raw"), "k").try_cast("bigint").alias("k"), V.confidence(V.json_field(F.col("raw"), "confidence")).alias("conf"), V.truthy_field(F.col("raw"), "end", False).alias("is_end")
    )


@query("""select conv_id, turn, translate(regexp_replace(lower(text), '[^0-9a-zа-я]', '', 'g'), 'copaexy', 'сораеху') as ident,
  lower(trim(role)) not in ('', 'none', 'system') as is_grounded from conversations""")
def identifier_fold(spark, sf):
    """O-F7, O-F8."""
    role = F.when(F.lower("role") == "system", "None").otherwise(F.col("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.identifier(F.col("text")).alias("ident"), V.grounded(role).alias("is_grounded"))


SIGNAL_SQL = "['signature_block', 'titled_id_header', 'table_end', 'same_letterhead', 'none', 'appendix_heading']"


@query(f"""with s as (select event_id, {SIGNAL_SQL}[event_id % 6 + 1] as signal, value / 20 as conf, event_type <> 'view' as said from events),
  r as (select *, said and signal not in ('table_continuation', 'blank_signature_fields', 'same_letterhead', 'none') as is_end from s)
  select event_id, is_end, is_end and conf < 0.75 and signal <> 'titled_id_header' as confirm, case when signal in ('signature_block', 'table_end') then 'end' when signal in ('titled_id_header', 'appendix_heading') then 'start' else 'neither' end as side from r""")
def signal_rules(spark, sf):
    """O-F6, O-P5, O-P7."""
    names = ["signature_block", "titled_id_header", "table_end", "same_letterhead", "none", "appendix_heading"]
    sig = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    d = table(spark, sf, "events").select("event_id", sig.alias("signal"), (F.col("value") / 20).alias("conf"), (F.col("event_type") != "view").alias("said"))
    d = d.withColumn("is_end", V.real_end(F.col("said"), F.col("signal")))
    side = F.when(F.col("signal").isin(V.END_SIGNALS), "end").when(F.col("signal").isin(V.START_SIGNALS), "start").otherwise("neither")
    return d.select("event_id", "is_end", V.needs_confirmation(F.col("is_end"), F.col("conf"), F.col("signal")).alias("confirm"), side.alias("side"))


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")


SEQ = ["ts", "event_id"]


@query("""select event_id, first_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as marker from events""")
def asof_next_marker(spark, sf):
    """O-J11: lines belong to the marker that follows."""
    m = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return scan(_events(spark, sf), ["user_id"], SEQ, marker=("next", m)).select("event_id", "marker")


@query("""select event_id, last_value(case when event_type = 'signup' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as marker from events""")
def asof_prev_marker(spark, sf):
    """O-J12: lines belong to the marker before."""
    m = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return scan(_events(spark, sf), ["user_id"], SEQ, marker=("last", m)).select("event_id", "marker")


@query("""select event_id, coalesce(last_value(case when event_type = 'view' then floor(value)::bigint end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row), 0) as iteration from events""")
def carry_iteration(spark, sf):
    """O-J14."""
    v = F.when(F.col("event_type") == "view", F.floor("value"))
    return scan(_events(spark, sf), ["user_id"], SEQ, it=("last", v)).select("event_id", F.coalesce("it", F.lit(0)).alias("iteration"))


DUP_SQL = """c as (select event_id, user_id, ts, event_type, floor(value)::bigint % 5 as page, sum((event_type = 'view')::int) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as it from events),
  f as (select *, min(case when event_type = 'click' then it end) over (partition by user_id, page order by ts, event_id rows between unbounded preceding and 1 preceding) as first_it from c)"""


@query(f"with {DUP_SQL} select event_id, first_it, coalesce(first_it = it - 1, false) as duplicate from f where event_type = 'purchase'")
def dup_reopen(spark, sf):
    """O-W9, O-W10: a target first opened exactly one iteration ago."""
    w = Window.partitionBy("user_id").orderBy(*SEQ).rowsBetween(Window.unboundedPreceding, 0)
    d = _events(spark, sf).withColumn("page", F.floor("value") % 5).withColumn("it", F.sum((F.col("event_type") == "view").cast("int")).over(w))
    d = d.withColumn("first_it", L.first_emitted(F.col("it"), F.col("event_type") == "click", "user_id", "page", SEQ)).where("event_type = 'purchase'")
    return d.select("event_id", "first_it", F.coalesce(F.col("first_it") == F.col("it") - 1, F.lit(False)).alias("duplicate"))


@query("""with e as (select *, coalesce(sum((event_type = 'error')::int) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as epoch from events)
  select event_id, stashed from (select event_id, event_type, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id, epoch order by ts, event_id rows unbounded preceding) as stashed from e) where event_type = 'error'""")
def heading_stash(spark, sf):
    """O-J13: used once, then gone."""
    d = L.stash(_events(spark, sf), "user_id", SEQ, F.when(F.col("event_type") == "purchase", F.col("event_id")), F.col("event_type") == "error")
    return d.where("event_type = 'error'").select("event_id", "stashed")


@query("""select event_id, coalesce(last_value(case when event_type = 'signup' then 1 when event_type = 'purchase' then 0 end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as active from events""")
def chain_state(spark, sf):
    """O-W11."""
    e = _events(spark, sf)
    return e.select("event_id", L.active_before(F.col("event_type") == "signup", F.col("event_type") == "purchase", "user_id", SEQ).alias("active"))


@query("select user_id, arg_max(event_type, row(value, -event_id)) as signal, max(value) as conf from events group by user_id")
def max_conf_per_key(spark, sf):
    """O-A6: the first of equal confidences wins."""
    return _events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", F.struct("value", -F.col("event_id"))).alias("signal"), F.max("value").alias("conf"))


@query("""select case when grouping(s) = 1 then 'ALL' else s end as stratum, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error,
  count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view, count(*) as n from (select *, 's' || (user_id % 3) as s from events) group by rollup(s)""")
def event_counters_by_stratum(spark, sf):
    """O-A11, O-A9."""
    e = _events(spark, sf).withColumn("s", F.concat(F.lit("s"), F.pmod("user_id", F.lit(3))))
    kinds = ["click", "error", "purchase", "signup", "view"]
    r = e.rollup("s").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return r.withColumn("stratum", F.when(F.col("g") == 1, "ALL").otherwise(F.col("s"))).drop("s", "g")


@query("""select p_type as name, count(*) filter (p_size % 2 = 0) as "TP", count(*) filter (p_size % 2 = 1) as "FP", count(*) as total from part where p_size > 5 group by p_type""")
def entry_hits_pivot(spark, sf):
    """O-A10."""
    p = table(spark, sf, "part").where("p_size > 5").select(F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 0, "TP").otherwise("FP").alias("label"))
    h = p.groupBy("name").pivot("label", ["TP", "FP"]).count().na.fill(0)
    return h.withColumn("total", F.col("TP") + F.col("FP"))


@query("""select o_orderpriority as run, count(*) as n, round(avg(o_totalprice), 4) as mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) as sd, round(median(o_totalprice), 4) as med, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by 1""")
def score_dist(spark, sf):
    """O-A7, O-A8."""
    p = F.col("o_totalprice")
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(p), F.lit(0.0)), 4).alias("sd"), F.round(F.median(p), 4).alias("med"), F.min(p).alias("lo"), F.max(p).alias("hi")
    )


@query("""select c_mktsegment as label, """ + ", ".join(f"""coalesce(round(avg(o_totalprice) filter (year(o_orderdate) = {y}), 2)::varchar <> '', false) as has_{y}, count(*) filter (year(o_orderdate) = {y}) as n_{y}""" for y in (1995, 1996, 1997)) + """ from orders join customer on o_custkey = c_custkey group by 1""")
def run_matrix_pivot(spark, sf):
    """O-W14, D21: label by run, with a mark for missing cells."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("label"), F.year("o_orderdate").alias("y"))
    p = o.groupBy("label").pivot("y", [1995, 1996, 1997]).count()
    return p.select("label", *[c for y in (1995, 1996, 1997) for c in (F.col(str(y)).isNotNull().alias(f"has_{y}"), F.coalesce(F.col(str(y)), F.lit(0)).alias(f"n_{y}"))])


TIMING_SQL = """e as (select user_id, strftime(min(ts), '%H:%M:%S') as a, strftime(max(ts), '%H:%M:%S') as b, count(*) % 4 as pages from events group by user_id),
  s as (select *, (substr(b, 1, 2)::int * 3600 + substr(b, 4, 2)::int * 60 + substr(b, 7, 2)::int - substr(a, 1, 2)::int * 3600 - substr(a, 4, 2)::int * 60 - substr(a, 7, 2)::int + 86400) % 86400 as sec from e)"""


@query(f"""with {TIMING_SQL}, g as (select count(*) as n, sum(sec)::bigint as total_s, round(avg(sec), 4) as s_per_file, sum(pages)::bigint as pages, round(sum(pages) / count(*), 4) as pages_per_file, round(sum(sec) / sum(pages), 4) as s_per_page from s)
  select *, case when total_s >= 3600 then (total_s // 3600) || 'h ' || (total_s % 3600 // 60) || 'm ' || (total_s % 60) || 's' when total_s >= 60 then (total_s // 60) || 'm ' || (total_s % 60) || 's' else total_s || 's' end as total from g""")
def timing_summary(spark, sf):
    """O-A13, O-F20, O-F21: pages of files without any count in the mean's denominator, not in the sum."""
    e = _events(spark, sf).groupBy("user_id").agg(F.date_format(F.min("ts"), "HH:mm:ss").alias("a"), F.date_format(F.max("ts"), "HH:mm:ss").alias("b"), (F.count(F.lit(1)) % 4).alias("pages"))
    s = e.withColumn("sec", T.elapsed(T.clock_seconds(F.col("a")), T.clock_seconds(F.col("b"))))
    g = s.agg(
        F.count(F.lit(1)).alias("n"), F.sum("sec").alias("total_s"), F.round(F.avg("sec"), 4).alias("s_per_file"), F.sum("pages").alias("pages"),
        F.round(F.sum("pages") / F.count(F.lit(1)), 4).alias("pages_per_file"), F.round(S.ratio(F.sum("sec"), F.sum("pages")), 4).alias("s_per_page"),
    )
    return g.withColumn("total", T.hms(F.col("total_s")))


FRAGMENTS = [(0, "bolt", "fastener"), (1, "red", "red thing"), (2, "ring", "seal"), (3, "blue", "blue thing"), (4, "small", "small thing")]
FRAG_SQL = ", ".join(f"({i}, '{f}', '{lab}')" for i, f, lab in FRAGMENTS)


@query(f"select name, arg_min(label, idx) as label from (select distinct p_name as name from part) join (values {FRAG_SQL}) f(idx, fragment, label) on contains(name, fragment) group by name")
def stem_to_label(spark, sf):
    """O-J7."""
    return L.first_fragment(table(spark, sf, "part").select(F.col("p_name").alias("name")), spark.createDataFrame(FRAGMENTS, "idx int, fragment string, label string"))


@query("""select user_id as file, floor(value)::bigint as page, array_to_string(list_sort(list_distinct(list(event_type))), ',') as signals, count(distinct event_type) = 1 and min(event_type) = 'click' as click_only,
  bool_or(event_type = 'click') as has_click from events group by 1, 2""")
def signal_attribution(spark, sf):
    """O-J10, O-A12: which signals resolve to a boundary, and whether one alone does."""
    a = L.attribution(_events(spark, sf).select(F.col("user_id").alias("file"), F.floor("value").alias("page"), "event_type"), ["file", "page"], "event_type")
    only = F.array_contains("signals", "click") & (F.size(F.array_remove("signals", "click")) == 0)
    return a.select("file", "page", F.array_join("signals", ",").alias("signals"), only.alias("click_only"), F.array_contains("signals", "click").alias("has_click"))


@query("""select url as path from pages where url in (select url from pages where page_id % 3 = 0) or regexp_extract(url, '://[^/]*(/.*)$', 1) in (select regexp_extract(url, '://[^/]*(/.*)$', 1) from pages where page_id % 7 = 0)""")
def shard_filter(spark, sf):
    """O-S3: inputs listed by absolute or relative path."""
    rel = F.regexp_extract("url", r"://[^/]*(/[^\n]*)\z", 1)  # only a line feed ends a line, and nothing may follow the path
    p = table(spark, sf, "pages").select(F.col("url").alias("path"), rel.alias("rel_path"), "page_id")
    listed, listed_rel = p.where("page_id % 3 = 0").select(F.col("path").alias("name")), p.where("page_id % 7 = 0").select(F.col("rel_path").alias("name"))
    return sinks.shard(p.drop("page_id"), listed, listed_rel).select("path")


@query("""with i as (select 'c_' || c_custkey as stem from customer), o as (select 'c_' || o_custkey || '_' || o_orderkey as name from orders where o_orderkey % 2 = 0)
  select stem from i where not exists (select 1 from o where starts_with(o.name, i.stem || '_'))""")
def resume_anti(spark, sf):
    """O-S4: inputs without any output named after them."""
    i = table(spark, sf, "customer").select(F.concat(F.lit("c_"), "c_custkey").alias("stem"))
    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0").select(F.concat_ws("_", F.lit("c"), "o_custkey", "o_orderkey").alias("name"))
    return sinks.unfinished(i, o)


@query(f"""with {TP} select 'tp' as kind, file, page from (select file, page from tr intersect select file, page from pr) union all select 'fp', file, page from (select file, page from pr except select file, page from tr)
  union all select 'fn', file, page from (select file, page from tr except select file, page from pr)""")
def set_ops_tp_fp_fn(spark, sf):
    """Section 2.9: intersection and both differences."""
    t, p = truth_pred(spark, sf)
    tag = lambda k, d: d.select(F.lit(k).alias("kind"), "file", "page")
    return tag("tp", t.intersect(p)).union(tag("fp", p.subtract(t))).union(tag("fn", t.subtract(p)))


@query("""with r as (select doc_id, text, sha256(text)[1:16] as key from documents), c as (select sha256(text)[1:16] as key, min(doc_id) as raw from documents where doc_id % 3 = 0 group by 1)
  select doc_id, r.key, raw is null as pending from r left join c on c.key = r.key""")
def prompt_cache_join(spark, sf):
    """O-S14, D23: answered by the cache, or pending."""
    d = table(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    cache = d.where("doc_id % 3 = 0").groupBy(T.cache_key(F.col("prompt")).alias("key")).agg(F.min("doc_id").alias("raw"))
    done, todo = sinks.pending(d, cache)
    return done.select("doc_id", "key", F.lit(False).alias("pending")).union(todo.select("doc_id", "key", F.lit(True)))


@query(f"""with {TP}, c as (select * from cmp where page <> 1), near as (select file, page + d as page, max(in_pred::int) as hit from c, (values (-1), (1)) v(d) where in_truth group by all)
  select c.file, c.page, case when hit = 1 then 'double_fire' when hit = 0 then 'localization' else 'isolated' end as kind from c left join near on near.file = c.file and near.page = c.page where in_pred and not in_truth""")
def fp_adjacency(spark, sf):
    """O-D1."""
    return S.adjacency(S.compare(*truth_pred(spark, sf)).where("page <> 1"))


@query("""with d as (select distinct o_custkey as file, datediff('day', timestamp '1992-01-01', o_orderdate) // 30 as page from orders), i as (select *, page - row_number() over (partition by file order by page) as g from d)
  select file, min(page)::bigint as lo, max(page)::bigint as hi, count(*) as len from i group by file, g having count(*) > 1""")
def fp_stack(spark, sf):
    """O-D2: runs of consecutive pages."""
    d = table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.floor(F.datediff("o_orderdate", F.lit("1992-01-01")) / 30).alias("page")).distinct()
    return S.runs(d).where("len > 1").select("file", "lo", "hi", "len")


@query(f"""with {TP}, b as (select file, page from pr where (file + page) % 5 <> 0 union select file, page from tr where (file + page) % 7 = 0)
  select 'a' as side, file, page from (select file, page from pr except select file, page from b) union all select 'b', file, page from (select file, page from b except select file, page from pr)""")
def build_diff(spark, sf):
    """O-D3: symmetric difference of two builds' predictions."""
    t, a = truth_pred(spark, sf)
    b = a.where("(file + page) % 5 <> 0").union(t.where("(file + page) % 7 = 0")).distinct()
    return a.subtract(b).select(F.lit("a").alias("side"), "file", "page").union(b.subtract(a).select(F.lit("b"), "file", "page"))


@query(f"""with {TP}, x as (select *, in_pred and (file + page) % 5 <> 0 as in_new from cmp where page <> 1),
  g as (select count(*) filter (in_truth and in_pred) as tp, count(*) filter (not in_truth and in_pred) as fp, count(*) filter (in_truth and not in_pred) as fn,
    count(*) filter (in_truth and in_new) as tp2, count(*) filter (not in_truth and in_new) as fp2, count(*) filter (in_truth and not in_new) as fn2,
    count(*) filter (in_truth and in_pred and file % 3 = 2) as tf, count(*) filter (not in_truth and in_pred and file % 3 = 2) as ff,
    count(*) filter (in_truth and in_new and file % 3 = 2) as tf2, count(*) filter (not in_truth and in_new and file % 3 = 2) as ff2 from x)
  select round(2 * tp / (2 * tp + fp + fn), 6) as f1_base, round(2 * tp2 / (2 * tp2 + fp2 + fn2), 6) as f1_new, round(tf / (tf + ff), 6) as fresh_base, round(tf2 / (tf2 + ff2), 6) as fresh_new,
    round(2 * tp2 / (2 * tp2 + fp2 + fn2), 6) >= round(2 * tp / (2 * tp + fp + fn), 6) and round(tf2 / (tf2 + ff2), 6) >= round(tf / (tf + ff), 6) as keep from g""")
def keep_gate(spark, sf):
    """O-D6: kept only if neither the aggregate nor the fresh stratum's precision falls."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1").withColumn("in_new", F.col("in_pred") & ((F.col("file") + F.col("page")) % 5 != 0))
    fresh = F.col("file") % 3 == 2
    t = F.col("in_truth")
    cells = {}
    for k, p in (("base", F.col("in_pred")), ("new", F.col("in_new"))):
        cells |= {f"tp_{k}": t & p, f"fp_{k}": ~t & p, f"fn_{k}": t & ~p, f"ft_{k}": t & p & fresh, f"ff_{k}": ~t & p & fresh}
    g = c.agg(*[F.count_if(v).alias(k) for k, v in cells.items()])
    f1 = lambda k: F.round(S.ratio(2 * F.col(f"tp_{k}"), 2 * F.col(f"tp_{k}") + F.col(f"fp_{k}") + F.col(f"fn_{k}")), 6)
    pf = lambda k: F.round(S.ratio(F.col(f"ft_{k}"), F.col(f"ft_{k}") + F.col(f"ff_{k}")), 6)
    g = g.select(f1("base").alias("f1_base"), f1("new").alias("f1_new"), pf("base").alias("fresh_base"), pf("new").alias("fresh_new"))
    return g.withColumn("keep", (F.col("f1_new") >= F.col("f1_base")) & (F.col("fresh_new") >= F.col("fresh_base")))


@query(f"""with {TP} select file, page from (select distinct file, page, lag(page) over (partition by file order by page) as prev from pr) where prev is null or page - prev > 1""")
def adjacent_dedup(spark, sf):
    """O-D9: of adjacent boundaries the first stays."""
    _, p = truth_pred(spark, sf)
    w = Window.partitionBy("file").orderBy("page")
    return p.distinct().withColumn("prev", F.lag("page").over(w)).where("prev is null or page - prev > 1").select("file", "page")


@query(f"""with {TP}, x as (select cmp.*, t.role, lag(t.role) over (partition by cmp.file order by cmp.page) as prev from cmp join t on t.file = cmp.file and t.page = cmp.page where in_pred)
  select file, page, role, role = prev as merge_same, role = 'system' as suppressed, in_truth from x""")
def domain_rules(spark, sf):
    """O-D7: merge consecutive starts of one type, suppress by issuer; with what each would fix or harm."""
    c = S.compare(*truth_pred(spark, sf)).where("in_pred").join(turns(spark, sf).select("file", "page", "role"), ["file", "page"])
    w = Window.partitionBy("file").orderBy("page")
    return c.select("file", "page", "role", (F.col("role") == F.lag("role").over(w)).alias("merge_same"), (F.col("role") == "system").alias("suppressed"), "in_truth")


@query(f"""with {TP}, a as (select *, in_pred and not in_truth and file % 4 = 0 as accepted from cmp where page <> 1),
  g as (select count(*) filter (in_pred and (in_truth or accepted)) as tp, count(*) filter (in_pred and not in_truth and not accepted) as fp, count(*) filter (in_truth and not in_pred) as fn from a) select tp, fp, fn, {PRF} from g""")
def human_accept(spark, sf):
    """O-D8: accepted false positives count as true."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1")
    acc = F.col("in_pred") & ~F.col("in_truth") & (F.col("file") % 4 == 0)
    return S.prf(c.agg(*S.counts(F.col("in_truth") | acc, F.col("in_pred"))))


@query(f"""with {TP}, g as (select file % 3 as s, {CNT} from cmp where page <> 1 group by 1), f as (select s, 2 * tp / (2 * tp + fp + fn) as f1 from g)
  select round(max(f1) filter (s = 0) - max(f1) filter (s = 2), 6) as gap, count(*) as strata from f""")
def overfit_gap(spark, sf):
    """O-A4: development score less fresh score."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1").groupBy((F.col("file") % 3).alias("s")).agg(*S.counts())
    f = c.withColumn("f1", S.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return f.agg(F.round(F.max(F.when(F.col("s") == 0, F.col("f1"))) - F.max(F.when(F.col("s") == 2, F.col("f1"))), 6).alias("gap"), F.count(F.lit(1)).alias("strata"))


@query("""with m as (select p_partkey, p_size > 40 as matched, p_size % 3 = 0 as good from part)
  select count(*) filter (matched) as n_match, count(*) filter (matched and good) as n_good, round(count(*) filter (matched and good) / count(*) filter (matched), 6) as p_good, count(distinct matched) as kinds from m""")
def match_precision(spark, sf):
    """O-D4, O-A14: share of true positives among matches."""
    m = table(spark, sf, "part").select((F.col("p_size") > 40).alias("matched"), (F.col("p_size") % 3 == 0).alias("good"))
    g = m.agg(F.count_if("matched").alias("n_match"), F.count_if(F.col("matched") & F.col("good")).alias("n_good"), F.countDistinct("matched").alias("kinds"))
    return g.select("n_match", "n_good", F.round(S.ratio(F.col("n_good"), F.col("n_match")), 6).alias("p_good"), "kinds")


@query(f"""with {TP}, l as (select file, page, role, lead(role) over w as nxt, lag(role) over w as prev from t window w as (partition by file order by page))
  select file, page, (prev is not null and ((role = 'user' and false) or prev <> role)) as style_break from l""")
def style_breaks(spark, sf):
    """O-P6: layout changes; an unknown letterhead is no change."""
    w = Window.partitionBy("file").orderBy("page")
    t = turns(spark, sf).withColumn("prev", F.lag("role").over(w))
    return t.select("file", "page", V.style_break(F.lit(None).cast("boolean"), F.coalesce("prev", "role"), F.col("role")).alias("style_break"))


@query(f"""with recursive {TP}, p0 as (select file, list_sort(list(page)) as a from (select distinct file, page from pr where page <> 1) group by file),
  t0 as (select file, list_sort(list(page)) as a from (select distinct file, page from tr where page <> 1 union select file, page + 1 from tr where file % 2 = 0) group by file),
  fl as (select file, coalesce(t0.a, []) as t, coalesce(p0.a, []) as p from t0 full join p0 using (file)),
  r(file, t, free, i, tp) as (
    select file, t, p, 1, 0 from fl
    union all
    select file, t, case when b is null then free else list_filter(free, lambda x: x <> b) end, i + 1, tp + (b is not null)::int
    from (select *, list_sort(list_filter(free, lambda x: abs(x - t[i]) <= 1), 'asc') as near,
      case when list_contains(free, t[i]) then t[i] when list_contains(free, t[i] - 1) then t[i] - 1 when list_contains(free, t[i] + 1) then t[i] + 1 end as b from r where i <= len(t)))
  select file, max(tp)::bigint as tp, (len(any_value(p)) - max(tp))::bigint as fp, (len(any_value(fl.t)) - max(tp))::bigint as fn from r join fl using (file) group by file""")
def tolerance_match(spark, sf):
    """O-J2 at one page."""
    t, p = truth_pred(spark, sf)
    t2 = t.where("page <> 1").union(t.where("file % 2 = 0").select("file", (F.col("page") + 1).alias("page")))
    return S.tolerance_match(t2, p.where("page <> 1"), 1)


# Answers of an imaginary model: arithmetic on (file, n), the same text for both engines.
ANSWERS = """select file, cast(n as int) as n, total_pages,
  (file * 31 + n * 17) % 5 < 3 as is_end, ((file * 13 + n * 29) % 100) / 100.0 as conf,
  case (file * 7 + n * 5) % 9 when 0 then 'titled_id_header' when 1 then 'signature_block' when 2 then 'table_end' when 3 then 'appendix_heading' when 4 then 'fresh_letterhead'
    when 5 then 'project_signoff' when 6 then 'page_number_reset' when 7 then 'appendix_mid_doc' else 'titled_id_header' end as signal,
  cast(case when n = 1 then n + (file + n) % 2 else n - 1 + (file * 3 + n) % 3 end as int) as signal_page,
  (file * 5 + n) % 4 = 0 and n > 1 as title_prev, (file * 11 + n) % 3 = 0 as title_cur, (file + n * 7) % 3 = 0 as title_next,
  (file * 3 + n) % 5 = 0 and n > 1 as id_prev, (file + n) % 4 = 0 as id_cur, (file * 9 + n) % 4 = 0 as id_next,
  (file + n * 3) % 2 = 0 as self_contained_next, (file * 3 + n * 2) % 3 = 0 as standalone, (file * 5 + n * 3) % 2 = 0 as starts_new, ((file * 17 + n * 3) % 100) / 100.0 as starts_conf,
  (file + n * 11) % 3 > 0 as next_starts, ((file * 19 + n) % 100) / 100.0 as next_conf, (file * 7 + n) % 3 > 0 as confirmed, ((file * 23 + n * 7) % 100) / 100.0 as confirm_conf,
  (file + n) % 3 > 0 as letterhead_match, case (file + n) % 4 when 0 then 'form' else 'narrative' end as layout_prev, case (file * 3 + n) % 5 when 0 then 'drawing' else 'narrative' end as layout_curr
  from ("""
PAGES = "select conv_id as file, turn + 1 as n, total_pages from conversations join (select conv_id as cid, cast(max(turn) + 1 as int) as total_pages from conversations group by conv_id) on cid = conv_id where turn + 1 < total_pages)"

_END = "('signature_block', 'project_signoff', 'table_end')"
_START = "('titled_id_header', 'fresh_letterhead', 'header_block_reset', 'appendix_heading', 'blank_form', 'page_number_reset', 'stamp_change')"
DECISION_SQL = f"""with v as ({ANSWERS}{PAGES}),
  a as (select *, case when is_end and signal in {_START} then signal_page - 1 when is_end then signal_page else n end as e0, is_end and signal = 'titled_id_header' as tg,
    (case when signal_page = n - 1 then title_prev when signal_page = n then title_cur else title_next end)::int + (case when signal_page = n - 1 then id_prev when signal_page = n then id_cur else id_next end)::int as g,
    (title_prev and signal_page <> n - 1 and n > 1)::int + (title_cur and signal_page <> n)::int + (title_next and signal_page <> n + 1)::int as oth,
    case when title_prev and signal_page <> n - 1 and n > 1 then n - 1 when title_cur and signal_page <> n then n else n + 1 end as op,
    case when title_prev and signal_page <> n - 1 and n > 1 then id_prev when title_cur and signal_page <> n then id_cur else id_next end as oid from v),
  b as (select * exclude (is_end, conf, signal_page), is_end and not (tg and g = 0 and oth <> 1) as is_end,
    case when tg and (g = 1 or (g = 0 and oth = 1 and not oid)) then least(conf, 0.6) else conf end as conf,
    case when tg and g = 0 and oth = 1 then op - 1 when tg and g = 0 then n else e0 end as e1, case when tg and g = 0 and oth = 1 then op else signal_page end as signal_page from a),
  c as (select * exclude (conf), case when is_end and signal in {_END} and signal_page = n + 1 and self_contained_next then n else e1 end as e2,
    case when signal in ('table_end', 'page_number_reset', 'stamp_change') then least(conf, 0.6) else conf end as conf, contains(signal, 'appendix') as app from b),
  d as (select *, coalesce(last_value(case when is_end and app and not standalone then 1 when is_end and not app then 0 end ignore nulls) over (partition by file order by n rows between unbounded preceding and 1 preceding), 0) = 1 as active from c),
  e as (select * exclude (is_end), case when is_end and app then (case when active then n > 1 and starts_new else standalone end) else is_end end as is_end from d),
  f as (select *, is_end and signal in ('signature_block', 'project_signoff') and e2 = n as sg from e),
  g as (select * exclude (is_end, conf), is_end and (not sg or next_starts) as is_end, case when sg and next_starts then (conf + next_conf) / 2 else conf end as conf from f),
  h as (select *, is_end and conf < 0.75 and signal not in ('fresh_letterhead', 'header_block_reset', 'titled_id_header') as cf from g),
  i as (select * exclude (is_end, conf), is_end and (not cf or confirmed) as is_end, case when cf and confirmed then (conf + confirm_conf) / 2 else conf end as conf from h),
  j as (select *, is_end as entered, is_end and e2 + 1 > total_pages as oob from i),
  k as (select * exclude (is_end), case when oob and self_contained_next then n when oob then least(e2, total_pages) else e2 end as key, case when oob and self_contained_next then n + 1 else e2 + 1 end as ns,
    is_end and (not oob or self_contained_next) as is_end, lag(letterhead_match) over w as pl, lag(layout_prev) over w as pp, lag(layout_curr) over w as pc from j window w as (partition by file order by n)),
  en as (select file, n as iter, 0 as src, case when ns <= total_pages then ns end as start, key, conf, signal from k where entered),
  st as (select k.file, k.n, 1, k.n, k.n - 1, starts_conf, 'start_only_heading' from k where n > 1 and not exists (select 1 from en where en.file = k.file and en.start = k.n and en.iter <= k.n)
    and (is_end or pl is not distinct from false or pp is distinct from pc) and starts_new),
  em as (select * from en union all select * from st),
  best as (select file, key, arg_max(conf, row(conf, -iter, -src)) as conf, arg_max(signal, row(conf, -iter, -src)) as signal from em group by file, key),
  pg as (select file, start as page from em where start is not null union select conv_id, 1 from conversations)
  select pg.file, pg.page::bigint as page, round(case when signal in ('signature_block', 'project_signoff') then least(1.0, conf + 0.1) else coalesce(conf, 1.0) end, 6)::double as confidence, coalesce(signal, 'none') as signal
  from pg left join best on best.file = pg.file and best.key = pg.page - 1"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.sql((ANSWERS + PAGES).replace("from conversations", "from {conversations}"), conversations=table(spark, sf, "conversations"))
    return d.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in d.dtypes])


@query(DECISION_SQL)
def decision_pass(spark, sf):
    """Section 3.2: the whole boundary decision."""
    b = D.boundaries(answers(spark, sf), totals(spark, sf))
    return b.select("file", F.col("page").cast("bigint").alias("page"), F.round("confidence", 6).alias("confidence"), "signal")
