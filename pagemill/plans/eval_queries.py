"""Queries over evaluation sets, review rules, prompts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verdicts as V
from ..operators import evaluation as E
from ..operators import matching as M
from ..operators import scoring as S
from ..sources import sinks
from .queries import CNT, MATCH_OUT, MATCH_SQL, PIECES_SQL, PRF, TP, _nomenclature, _pieces, _titles, query, table, totals, truth_pred, turns

LISTING = "select '/root/tests/p' || cast(page_id % 9 as string) || case page_id % 9 % 3 when 0 then '' else '/c' || cast(page_id % 4 as string) end || case page_id % 5 when 0 then '/image_' when 1 then '/Image_' when 2 then '/IMAGE_' when 3 then '/scan_' else '/x/Image_' end || cast(page_id as string) || case page_id % 7 when 0 then '.PDF' when 1 then '.txt' else '.pdf' end as path from pages"


@query(f"""with l as ({LISTING}), o as (select path, string_split(path[13:], '/') as s from l where starts_with(upper(string_split(path, '/')[-1]), 'IMAGE_') and ends_with(lower(path), '.pdf')),
  f as (select s[1] as project from o where len(s) = 2) select array_to_string(s[1:-2], '/') as "case", path from o where len(s) = 2 or (len(s) = 3 and s[1] not in (from f))""")
def case_discovery(spark, sf):
    """O-S5, O-S6: originals in flat or nested cases."""
    return E.cases(spark.sql(LISTING.replace("from pages", "from {pages}"), pages=table(spark, sf, "pages")), "/root/tests")


def _evaluation(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = totals(spark, sf).select("file")
    strata = files.where("file % 3 < 2").select("file", F.when(F.col("file") % 3 == 0, "dev").otherwise("holdout").alias("stratum"))
    return E.evaluation_set(_pieces(spark, sf), totals(spark, sf), strata, files.where("file % 5 = 0"))


EVAL_SQL = f"""{PIECES_SQL}, fg as (select file, page from (select *, lag(page) over (partition by file order by page) as prev from gap) where prev is null or prev < page - 1),
  sts as (select file, start_page::int as page from pc union select file, page::int from fg union select file, 1 from tot), us as (select file from sts group by file having count(*) > 1),
  gi as (select file, page - row_number() over (partition by file order by page) as i, page from gap where page <> 1 and file in (from us) and file % 5 <> 0),
  ms as (select file, min(page) - 1 as lo, max(page) + 1 as hi from gi group by file, i)"""


@query(f"with {EVAL_SQL} select file, lo::bigint as lo, hi::bigint as hi from ms")
def evaluation_masks(spark, sf):
    """O-K4, O-W5: uncovered runs of files that nobody attested, a page wider on both sides."""
    return _evaluation(spark, sf)[2]


@query(f"with {EVAL_SQL} select file, page from sts where file in (from us)")
def evaluation_truth(spark, sf):
    """O-K4: starts of files with more than one document."""
    return _evaluation(spark, sf)[0].select("file", F.col("page").cast("int").alias("page"))


@query(f"with {EVAL_SQL}, s as (select case file % 3 when 0 then 'dev' when 1 then 'holdout' else 'fresh' end as stratum, count(*) as files from us group by 1) select n.s as stratum, coalesce(files, 0) as files from (values ('dev'), ('holdout'), ('fresh'), ('probe')) n(s) left join s on s.stratum = n.s")
def strata_counts(spark, sf):
    """O-A15."""
    return E.stratum_sizes(_evaluation(spark, sf)[1], ["dev", "holdout", "fresh", "probe"])


@query(f"""with {TP}, st as (select file, page from pr union select file, 1 from tot), d as (select st.file, page, coalesce(lead(page) over (partition by st.file order by page), total_pages + 1) - page as n from st join tot on tot.file = st.file where page <= total_pages)
  select tot.file, coalesce(sum(n), 0)::bigint as split_pages, any_value(total_pages)::int as total_pages, coalesce(sum(n), 0) = any_value(total_pages) as agree from tot left join d on d.file = tot.file group by tot.file""")
def pages_invariant(spark, sf):
    """O-A17: documents of a file have all its pages."""
    t = totals(spark, sf)
    return E.pages_covered(S.intervals(truth_pred(spark, sf)[1], t), t)


@query(f"""with {TP}, s as (select file, count(*) filter (in_truth and in_pred) as tp, count(*) filter (not in_truth and in_pred) as fp, count(*) filter (in_truth and not in_pred) as fn,
    coalesce(string_agg(page::varchar, ',' order by page) filter (not in_truth and in_pred), '') as extra, coalesce(string_agg(page::varchar, ',' order by page) filter (in_truth and not in_pred), '') as missed from cmp where page <> 1 group by file),
  r as (select file, {PRF}, extra, missed from s) select file, precision, recall, f1, extra, missed from r order by f1, file limit 12""")
def lowest_files(spark, sf):
    """Section 2.8: a report of the worst files; the limit is the feature."""
    return E.lowest(S.compare(*truth_pred(spark, sf)).where("page <> 1"), 12)


@query("""with n as (select 'test_run' || p_partkey || case when p_partkey % 5 = 0 then '.txt' else '.log' end as name, p_partkey as k from part) select max(name) as by_name, arg_max(name, k) as by_number from n where ends_with(name, '.log')""")
def latest_log(spark, sf):
    """O-S16: text order and number order differ (run 9 against run 14)."""
    k = F.col("p_partkey")
    return E.latest_run(table(spark, sf, "part").select(F.concat(F.lit("test_run"), k.cast("string"), F.when(k % 5 == 0, ".txt").otherwise(".log")).alias("name")))


_K = {"end_of_doc": "You see consecutive scanned pages ({a}, {b}). Does page {a} END a document?", "style_continuity": "Compare these two scanned document pages visually, the second page (page {b}).", "self_contained": "Look at page {a}: a SELF-CONTAINED one-page document?",
      "next_page_starts_new": "Page {a} ends with a signature or approval block; the page (page {b})?", "starts_new_document": "Does it BEGIN a new, separate document distinct (page {a} and page {b})", "confirm_boundary": "Do page {a} and page {b} belong to DIFFERENT documents that should be filed separately?",
      "appendix_standalone": "You are examining pages {a},{b} from it. Page {b} starts with an appendix heading", "classify": "This is the FIRST page of a document", "doc_identifier": "the most prominent document number"}
_LIT = lambda s: "'" + s.replace("{a}", "' || cast(event_id % 50 as string) || '").replace("{b}", "' || cast(event_id % 50 + 1 as string) || '") + "'"
PROMPTS = "select event_id, case event_id % 11 " + " ".join(f"when {i} then {_LIT(t)}" for i, t in enumerate(_K.values())) + " when 9 then 'Does page x END a document?' else 'other' end as prompt from events"
PAGES_SQL = """case event_id % 11 when 0 then a || ',' || b when 1 then a || ',' || b when 2 then a when 3 then a || ',' || b when 4 then a || ',' || b when 5 then a || ',' || b when 6 then a || ',' || b when 9 then '' end"""


@query(f"""with p as (select event_id, (event_id % 50)::varchar as a, (event_id % 50 + 1)::varchar as b from events) select event_id, case event_id % 11 {' '.join(f"when {i} then '{k}'" for i, k in enumerate(_K))} when 9 then 'end_of_doc' else 'unknown' end as kind,
  {PAGES_SQL} as pages, case event_id % 11 when 0 then a::int when 6 then b::int end as current from p""")
def prompt_kinds_pages(spark, sf):
    """O-F28: kinds and pages of prompts, the first pattern that fits."""
    d = spark.sql(PROMPTS.replace("from events", "from {events}"), events=table(spark, sf, "events"))
    pages, current = E.prompt_pages(F.col("prompt"))
    return d.select("event_id", E.prompt_kind(F.col("prompt")).alias("kind"), F.array_join(F.transform(pages, lambda x: x.cast("string")), ",").alias("pages"), current.alias("current"))


@query("select sha256(text)[1:16] as key, any_value(length(text)::varchar) as raw, bool_and(doc_id % 4 <> 0) as asked from (select text, min(doc_id) as doc_id from documents where text is not null group by text) group by 1")
def provider_answers(spark, sf):
    """2.11a: a pluggable provider answers what the cache does not hold."""
    d = table(spark, sf, "documents").where("text is not null").groupBy(F.col("text").alias("prompt")).agg(F.min("doc_id").alias("doc_id"))
    cache = d.where("doc_id % 4 = 0").select(T.cache_key(F.col("prompt")).alias("key"), F.length("prompt").cast("string").alias("raw"))
    done, todo = sinks.pending(d, cache)
    return done.select("key", "raw", F.lit(False).alias("asked")).unionByName(E.infer(todo, lambda prompts: [str(len(p)) for p in prompts]).withColumn("asked", F.lit(True)))


@query("""select page_id, (page_id % 4 * 90)::int as model_deg, case when page_id % 5 <> 0 then length(url) % 2 = 1 end as corr_rotated, case when page_id % 5 <> 0 and length(url) % 4 = 1 then (length(url) % 3 * 90 + 90)::int end as corr_deg,
  case when page_id % 5 = 0 or length(url) % 2 = 0 then 0 when page_id % 4 <> 0 then page_id % 4 * 90 when length(url) % 4 = 1 then length(url) % 3 * 90 + 90 else 90 end::int as deg from pages""")
def rotation_second_opinion(spark, sf):
    """2.11: a pluggable corroborator says whether a page is turned, and by what angle if it knows; the model's angle needs its consent."""

    def provider(b):
        n = b["url"].str.len()
        return [None if i % 5 == 0 else (k % 2 == 1, int(k % 3 * 90 + 90) if k % 4 == 1 else None, 0.9) for i, k in zip(b["page_id"], n, strict=True)]

    p = E.corroborate(table(spark, sf, "pages").select("page_id", "url", (F.col("page_id") % 4 * 90).cast("int").alias("model_deg")), provider)
    deg = V.corroborated_rotation(F.col("model_deg"), F.col("corr_rotated"), F.col("corr_deg"))
    return p.select("page_id", "model_deg", "corr_rotated", "corr_deg", deg.cast("int").alias("deg"))


@query("""with r as (select (p_partkey - 1)::int as idx, case when p_partkey % 10 = 1 then (p_partkey // 10 * 1000)::varchar when p_partkey % 10 = 7 then 'n/a' else (p_partkey // 10 * 1000 + p_partkey % 10)::varchar || '.0' end as raw, case when p_partkey % 13 = 0 then '  ' else p_name end as name from part),
  c as (select *, try_cast(try_cast(raw as double) as int) as code from r), f as (select *, last_value(case when code % 1000 = 0 then trim(name) end ignore nulls) over (order by idx) as category from c)
  select idx, code, trim(name) as name, category, replace(lower(trim(name)), ' ', '') in ('redbolt', 'smallring') as is_sheet_type from f where trim(name) <> ''""")
def nomenclature_entries(spark, sf):
    """O-S13: categories filled forward from their headings, kinds of sheets marked."""
    k = F.col("p_partkey")
    raw = F.when(k % 10 == 1, (F.floor(k / 10) * 1000).cast("string")).when(k % 10 == 7, "n/a").otherwise(F.concat((F.floor(k / 10) * 1000 + k % 10).cast("string"), F.lit(".0")))
    rows = table(spark, sf, "part").select((k - 1).cast("int").alias("idx"), raw.alias("raw_code"), F.when(k % 13 == 0, "  ").otherwise(F.col("p_name")).alias("name"))
    return M.read_entries(rows, ["Red Bolt", "small-ring"]).select("idx", "code", "name", "category", "is_sheet_type")


@query(f"with {MATCH_SQL}, b as ({MATCH_OUT} 1) select length(title) % 3 as kind, count(*) filter (band = 'MATCH') as match, count(*) filter (band = 'AMBIGUOUS') as ambiguous, count(*) filter (band = 'NONE') as none from b group by 1")
def band_histogram(spark, sf):
    """O-A9: bands of best matches by kind of title."""
    b = M.top(_titles(spark, sf), _nomenclature(spark, sf), 1, fuzzy=False)
    p = b.groupBy((F.length("title") % 3).cast("bigint").alias("kind")).pivot("band", ["MATCH", "AMBIGUOUS", "NONE"]).count().na.fill(0)
    return p.select("kind", F.col("MATCH").alias("match"), F.col("AMBIGUOUS").alias("ambiguous"), F.col("NONE").alias("none"))


def _rules(spark, sf) -> DataFrame:
    t = turns(spark, sf)
    c = S.compare(*truth_pred(spark, sf)).where("in_pred and page <> 1")
    pages = t.select("file", "page", ((F.col("file") + F.col("page")) % 4 == 0).alias("typed"), ((F.col("file") * 3 + F.col("page")) % 5 == 0).alias("marker"))
    return E.close_at_marker(c, pages)


RULES_SQL = f"""{TP}, cn as (select file, page, in_truth from cmp where in_pred and page <> 1), ty as (select file, page from cn where (file + page) % 4 = 0), mk as (select file, page from t where (file * 3 + page) % 5 = 0),
  op as (select ty.file, ty.page, min(mk.page) as close from ty join mk on mk.file = ty.file and mk.page >= ty.page group by all),
  cl as (select cn.*, exists (select 1 from op where op.file = cn.file and op.page < cn.page and cn.page <= op.close) as suppressed from cn)"""


@query(f"with {RULES_SQL} select file, page, in_truth, suppressed from cl")
def rule_close_at_marker(spark, sf):
    """O-D7: no boundary between a typed start and its closing mark."""
    return _rules(spark, sf).select("file", "page", "in_truth", "suppressed")


@query(f"""with {RULES_SQL}, fi as (select 'close_at_marker' as rule, 'suppress' as action, in_truth from cl where suppressed union all select 'issuer', 'suppress', in_truth from cn where file % 7 = 0 union all select 'soft_prior', 'prior', in_truth from cn where page % 3 = 0)
  select n.r as rule, count(*) filter (action = 'suppress' and not in_truth) as tp_fix, count(*) filter (action = 'suppress' and in_truth) as fp_harm, count(*) filter (action <> 'suppress') as prior from (values ('close_at_marker'), ('issuer'), ('soft_prior'), ('never')) n(r) left join fi on fi.rule = n.r group by 1""")
def domain_rule_effects(spark, sf):
    """O-D7: what each rule fixes and harms."""
    c = _rules(spark, sf)
    fire = lambda rule, action, where: c.where(where).select(F.lit(rule).alias("rule"), F.lit(action).alias("action"), "in_truth")
    fired = fire("close_at_marker", "suppress", "suppressed").union(fire("issuer", "suppress", "file % 7 = 0")).union(fire("soft_prior", "prior", "page % 3 = 0"))
    return E.rule_effects(fired, ["close_at_marker", "issuer", "soft_prior", "never"])


@query(f"""with {TP}, a as (select *, in_pred and not in_truth and file % 4 = 0 as acc from cmp where page <> 1 and not (in_truth and not in_pred and page % 2 = 0)),
  g as (select count(*) filter (in_pred and (in_truth or acc)) as tp, count(*) filter (in_pred and not in_truth and not acc) as fp, count(*) filter (in_truth and not in_pred) as fn from a) select tp, fp, fn, {PRF} from g""")
def human_review(spark, sf):
    """O-D8: accepted false positives are true, two-sided misses dropped."""
    t, p = truth_pred(spark, sf)
    return E.reviewed(S.compare(t, p).where("page <> 1"), p.where("file % 4 = 0"), t.where("page % 2 = 0"))


@query(f"""with {TP}, f as (select cmp.file, cmp.page, role as signal from cmp join t on t.file = cmp.file and t.page = cmp.page where in_pred and not in_truth and cmp.page <> 1 or cmp.page % 3 = 1),
  m as (select f.*, exists (select 1 from f g where g.file = f.file and abs(g.page - f.page) = 1) as s from f) select case when grouping(signal) = 1 then 'ALL' else signal end as signal, count(*) as n, count(*) filter (s) as in_stack from m group by rollup(signal)""")
def fp_stack_signals(spark, sf):
    """O-D2: false positives by signal, and those in runs of consecutive pages."""
    c = S.compare(*truth_pred(spark, sf)).where("(in_pred and not in_truth and page <> 1) or page % 3 = 1")
    return E.stacks(c.join(turns(spark, sf).select("file", "page", F.col("role").alias("signal")), ["file", "page"]).select("file", "page", "signal"))


@query(f"""with {TP}, x as (select *, case file % 4 when 0 then 'dev' when 1 then 'fresh' else '?' end as stratum from cmp where page <> 1),
  r as (select case when grouping(stratum) = 1 then 'ALL' else stratum end as stratum, {CNT} from x group by rollup(stratum)),
  a as (select coalesce(r.stratum, n.s) as stratum, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn from r full join (values ('dev'), ('holdout'), ('fresh'), ('ALL')) n(s) on n.s = r.stratum)
  select stratum, tp, fp, fn, {PRF} from a""")
def prf_all_strata(spark, sf):
    """O-A3: every stratum has a row, also one without files."""
    c = S.compare(*truth_pred(spark, sf)).where("page <> 1")
    strata = totals(spark, sf).where("file % 4 < 2").select("file", F.when(F.col("file") % 4 == 0, "dev").otherwise("fresh").alias("stratum"))
    return S.by_stratum(c, strata, known=("dev", "holdout", "fresh"))
