"""Queries over logs: lines made from the events table in the forms of detection and test logs.

Every user's events are one log; the same SQL text makes the
lines for both engines, the reading of them is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import scoring as S
from ..sources import detection_log as G
from .queries import query, table

LOG = """select 'log' || cast(user_id as string) as source, cast(row_number() over (partition by user_id order by ts, event_id) as int) as line_no,
  case event_id % 17 when 0 then ' Image_' || cast(event_id % 40 as string) || '.pdf ' when 1 then '  Checking page ' || cast(event_id * 5 % 12 as string)
    when 2 then '    p' || cast(event_id * 7 % 12 as string) || ': end=True, signal=' || case event_id % 2 when 0 then 'signature_block' else 'table_end' end || ', signal_on_page=' || cast(event_id * 7 % 12 + event_id % 3 as string) || ', conf=80%'
    when 3 then '    End at page 3 → doc starts at page ' || cast(event_id * 7 % 12 as string) || ' (conf=' || cast(event_id % 100 as string) || '%, signal=' || case event_id % 3 when 0 then 'signature_block' else 'titled_id_header' end || ')'
    when 4 then '[TITLE-GATE] p' || cast(event_id * 7 % 12 as string) || ': title=''ЧЕЛЕН ЛИСТ ' || cast(event_id % 9 as string) || ''' identifier=None -> grounded=' || cast(event_id % 3 as string) || '/2'
    when 5 then '[TITLE-GATE] p' || cast(event_id * 5 % 12 as string) || ' one-of-two grounded, capped' when 6 then '[TITLE-GATE] titled_id_header at p' || cast(event_id * 5 % 12 as string) || ' SUPPRESSED: 0/2'
    when 7 then '[TITLE-GATE-RELOC] grounded title on p' || cast(event_id * 11 % 12 as string) || ' (title="ПЛАН ' || cast(event_id % 4 as string) || '" id= 12/3, grounded=' || cast(event_id % 3 as string) || '/2)'
    when 8 then '[WINDOW-REQUERY] p' || cast(event_id % 12 as string) when 9 then '[START-DETECT] p' || cast(event_id * 7 % 12 as string) || ' new heading'
    when 10 then '    pred=[1, ' || cast(event_id % 12 as string) || ',' || cast(event_id * 7 % 12 as string) || ', ]' when 11 then 'tests/other_' || cast(event_id % 7 as string) || '.pdf'
    when 12 then '[TITLE-GATE] p' || cast(event_id * 5 % 12 as string) || ': title="A" identifier=''B-' || cast(event_id % 5 as string) || ''' -> grounded=' || cast(event_id % 3 as string) || '/2'
    when 13 then '    End at page 9 → doc starts at page ' || cast(event_id * 5 % 12 as string) || ' (conf=50%, signal=table_end)' when 14 then 'pred=[]' else event_type end as line
  from events"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return G.parse_detection(spark.sql(LOG.replace("from events", "from {events}"), events=table(spark, sf, "events")))


def _strata(files: DataFrame) -> DataFrame:
    k = F.regexp_extract("file", "_(\\d+)", 1).cast("int")
    f = files.select("file").distinct()
    return f.where(k % 10 != 9).select("file", F.when(k % 3 == 0, "dev").when(k % 3 == 1, "holdout").otherwise("fresh").alias("stratum"))


def _masks(files: DataFrame) -> DataFrame:
    k = F.regexp_extract("file", "_(\\d+)", 1).cast("int")
    return files.select("file").distinct().where(k % 4 == 0).select("file", F.lit(3).alias("lo"), F.lit(5).alias("hi"))


def _truth(files: DataFrame) -> DataFrame:
    k = F.regexp_extract("file", "_(\\d+)", 1).cast("int")
    return files.select("file").distinct().select("file", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("page")).where((k + F.col("page")) % 3 == 0)


# What the lines say and which section they are in, for the oracles.
RE = "regexp_extract(line, '{}', {})"
SECTIONS = rf"""lg as ({LOG}),
  pl as (select *, nullif(regexp_extract(trim(line), '^(Image_\w+\.pdf)$', 1), '') as fm from lg),
  sc as (select *, count(fm) over (partition by source order by line_no rows between unbounded preceding and 1 preceding) as section,
    first_value(fm ignore nulls) over (partition by source order by line_no rows between current row and unbounded following) as file from pl),
  se as (select * from sc where file is not null qualify section = max(section) over (partition by source, file))"""
NUM = "try_cast(nullif(regexp_extract(line, '{}', {}), '') as int)"
GATE_RE, RELOC_RE = r"\[TITLE-GATE\] p(\d+): title=(.*) identifier=(.*) -> grounded=(\d)/2", r"\[TITLE-GATE-RELOC\] grounded title on p(\d+) \(title=(.*) id=(.*), grounded=(\d)/2\)"
UNQ = "regexp_replace(trim({}), '^([''\"])(.*)([''\"])$', '\\2')"
EVENTS = rf"""{SECTIONS}, ge as (select source, file, section, line_no, starts_with(line, '[TITLE-GATE-RELOC]') as mv, {NUM.format(GATE_RE, 1)} as p1, {NUM.format(RELOC_RE, 1)} as p2,
    {RE.format(GATE_RE, 2)} as t1, {RE.format(RELOC_RE, 2)} as t2, {RE.format(GATE_RE, 3)} as i1, {RE.format(RELOC_RE, 3)} as i2, {NUM.format(GATE_RE, 4)} as g1, {NUM.format(RELOC_RE, 4)} as g2,
    {NUM.format(r"\[TITLE-GATE\] p(\d+) one-of-two", 1)} as cap, {NUM.format(r"\[TITLE-GATE\] titled_id_header at p(\d+) SUPPRESSED", 1)} as sup from se),
  ev as (select source, file, section, line_no, coalesce(p1, p2) as page, {UNQ.format("case when mv then t2 else t1 end")} as title, {UNQ.format("case when mv then i2 else i1 end")} as identifier, coalesce(g1, g2) as grounded,
    case when mv then 'RELOC' when g1 = 2 then 'KEEP' else 'PENDING' end as v0, lead(line_no) over (partition by source, section, coalesce(p1, p2) order by line_no) as until from ge where coalesce(p1, p2) is not null),
  ch as (select source, section, line_no, coalesce(cap, sup) as page, case when cap is not null then 'CAPPED' else 'SUPPRESSED' end as v from ge where coalesce(cap, sup) is not null),
  te as (select ev.source, file, ev.line_no, ev.page, title, identifier, grounded, coalesce(arg_max(ch.v, ch.line_no), any_value(v0)) as verdict from ev left join ch
    on ch.source = ev.source and ch.section = ev.section and ch.page = ev.page and ch.line_no > ev.line_no and (until is null or ch.line_no < until) group by all)"""
KEY = "cast(regexp_extract({}, '_(\\d+)', 1) as int)"
STRATA = f"st as (select file, case {KEY.format('file')} % 3 when 0 then 'dev' when 1 then 'holdout' else 'fresh' end as stratum from (select distinct file from se) where {KEY.format('file')} % 10 <> 9)"
TRUTH = f"tr as (select file, page::int as page from (select distinct file from se), generate_series(1, 12) g(page) where ({KEY.format('file')} + page) % 3 = 0)"
PREDS = r"""pr as (select source, file, unnest(list_distinct(list_filter(list_transform(string_split(p, ','), lambda x: try_cast(trim(x) as int)), lambda x: x is not null))) as page
  from (select source, file, arg_max(regexp_extract(line, 'pred=\[([^\]]*)\]', 1), line_no) as p from
    (select *, last_value(case when ends_with(trim(line), '.pdf') then trim(line) end ignore nulls) over (partition by source order by line_no) as file from lg) where file is not null and contains(line, 'pred=[') group by source, file))"""


@query(rf"""with {SECTIONS} select source, line_no, file, section::bigint as section, {NUM.format(r'Checking page (\d+)', 1)} as checking, {NUM.format(r'doc starts at page (\d+)', 1)} as doc_start, {NUM.format(r'\[START-DETECT\] p(\d+)', 1)} as start_detect,
  {NUM.format(r'p(\d+): end=True, signal=(signature_block|table_end), signal_on_page=(\d+)', 3)} as end_signal_page, contains(line, '[WINDOW-REQUERY]') as requery from se""")
def log_line_parse(spark, sf):
    """Sections 4.1 and T12: typed lines in sections closed by a file's marker; of equal names the last."""
    return E.sections(_lines(spark, sf)).select("source", "line_no", "file", "section", "checking", "doc_start", "start_detect", "end_signal_page", "requery")


@query(f"with {EVENTS} select * from te")
def title_gate_events(spark, sf):
    """O-W13: a later verdict line changes the latest event of its page."""
    return E.title_events(E.sections(_lines(spark, sf)))


@query(f"""with {EVENTS}, {TRUTH}, lb as (select te.*, verdict in ('KEEP', 'CAPPED', 'RELOC') as kept, exists (select 1 from tr where tr.file = te.file and tr.page = te.page) as ok from te)
  select source, line_no, file, page, verdict, case when kept and ok then 'TP' when kept then 'FP' when ok then 'suppressed-was-true' else 'suppressed-was-false' end as label from lb""")
def gate_event_labels(spark, sf):
    """O-J9: kept events against truth; pending ones count as suppressed."""
    lines = E.sections(_lines(spark, sf))
    return E.label_events(E.title_events(lines), _truth(lines)).select("source", "line_no", "file", "page", "verdict", "label")


@query(rf"""with {SECTIONS}, {STRATA}, x as (select *, {NUM.format(r'Checking page (\d+)', 1)} as ck, {NUM.format(r'doc starts at page (\d+)', 1)} as ds, {NUM.format(r'\[TITLE-GATE-RELOC\] grounded title on p(\d+)', 1)} as rl,
    {NUM.format(r'\[TITLE-GATE\] titled_id_header at p(\d+) SUPPRESSED', 1)} as sp, {NUM.format(r'\[TITLE-GATE\] p(\d+) one-of-two', 1)} as cp, {NUM.format(r'p(\d+): end=True, signal=(signature_block|table_end), signal_on_page=(\d+)', 1)} as e1,
    {NUM.format(r'p(\d+): end=True, signal=(signature_block|table_end), signal_on_page=(\d+)', 3)} as e2 from se),
  y as (select *, coalesce(last_value(ck ignore nulls) over (partition by source, section order by line_no), 0) as it from x),
  d as (select source, section, ds, arg_min(it, line_no) as first_it, min(line_no) as at from y where ds is not null group by all),
  z as (select y.*, d.first_it from y left join d on d.source = y.source and d.section = y.section and d.ds = y.rl and d.at < y.line_no),
  k as (select file, 'titled_suppressed' as k, sp as p from z union all select file, 'titled_capped', cp from z union all select file, 'titled_reloc', rl from z union all select file, 'titled_reloc_dup', rl from z where first_it = it - 1
    union all select file, 'window_requery', -1 from z where contains(line, '[WINDOW-REQUERY]') union all select file, 'onelite_would_fire', e1 from z where e2 = e1 + 1),
  m as (select k.*, coalesce(stratum, '?') as stratum from k left join st using (file) where p is not null and (k = 'window_requery' or not ({KEY.format('k.file')} % 4 = 0 and p between 3 and 5))),
  r as (select case when grouping(stratum) = 1 then 'ALL' else stratum end as stratum, {', '.join(f"count(*) filter (k = '{x}') as {x}" for x in E.MEASURES)} from m group by rollup(stratum))
  select coalesce(r.stratum, n.s) as stratum, {', '.join(f'coalesce({x}, 0) as {x}' for x in E.MEASURES)} from r full join (values ('dev'), ('holdout'), ('fresh'), ('ALL')) n(s) on n.s = r.stratum""")
def stage_event_counts(spark, sf):
    """O-A11, O-A3: six counters by stratum; requeries are not masked; every stratum has a row."""
    lines = E.sections(_lines(spark, sf))
    return E.counters(lines, _strata(lines), _masks(lines), ["dev", "holdout", "fresh"])


@query(f"with lg as ({LOG}), {PREDS} select source, file, page from pr")
def log_predictions(spark, sf):
    """O-J12: the last prediction line of a file wins."""
    return E.predictions(_lines(spark, sf))


COMPARED = f"""{SECTIONS}, {STRATA}, {TRUTH}, {PREDS},
  fs as (select distinct file from se), p1 as (select distinct file, page from pr where page <> 1 and file in (from fs)), t1 as (select file, page from tr where page <> 1),
  cp as (select file, page, t1.page is not null as in_truth, p1.page is not null as in_pred from t1 full join p1 using (file, page))"""


def _compared(lines: DataFrame, sec: DataFrame) -> DataFrame:
    pred = E.predictions(lines).join(sec.select("file").distinct(), "file", "left_semi").select("file", "page").where("page <> 1")
    return S.compare(_truth(sec).where("page <> 1"), pred)


STARTS = r"""so as (select file, line_no, page, signal from (select file, line_no, try_cast(nullif(regexp_extract(line, 'doc starts at page (\d+) \(conf=\d+%, signal=(\w+)\)', 1), '') as int) as page, regexp_extract(line, 'doc starts at page (\d+) \(conf=\d+%, signal=(\w+)\)', 2) as signal from se
  union all select file, line_no, try_cast(nullif(regexp_extract(line, '\[START-DETECT\] p(\d+)', 1), '') as int), 'start_only_heading' from se) where page is not null)"""


@query(f"""with {COMPARED}, {STARTS}, g as (select file, page, list_distinct(list(signal)) as s from so group by all),
  j as (select * from cp join g using (file, page) join st using (file) where in_pred and list_contains(s, 'titled_id_header')),
  a as (select stratum, count(*) filter (in_truth) as tp, count(*) filter (in_truth and len(s) = 1) as alone, count(*) filter (in_truth and len(s) > 1) as with_others, count(*) filter (not in_truth) as fp from j group by 1)
  select n.s as stratum, coalesce(tp, 0) as tp, coalesce(alone, 0) as alone, coalesce(with_others, 0) as with_others, coalesce(fp, 0) as fp from (values ('dev'), ('holdout'), ('fresh')) n(s) left join a on a.stratum = n.s""")
def titled_attribution(spark, sf):
    """O-A12: true boundaries with the signal, alone or with others, and false ones."""
    lines = _lines(spark, sf)
    sec = E.sections(lines)
    return E.signal_attribution(_compared(lines, sec), E.starts(sec), _strata(sec), "titled_id_header", ["dev", "holdout", "fresh"])


@query(f"""with {EVENTS}, {TRUTH}, {PREDS}, ms as (select file, page from tr where page <> 1 except select file, page from pr)
  select te.file, te.page, array_to_string(list(title order by te.line_no, title), '|') as titles from te join ms on ms.file = te.file and ms.page = te.page group by all""")
def missed_heading_titles(spark, sf):
    """O-J17: headings seen on the pages of missed boundaries."""
    lines = _lines(spark, sf)
    sec = E.sections(lines)
    return E.missed_headings(_compared(lines, sec), E.title_events(sec)).select("file", "page", F.array_join("titles", "|").alias("titles"))


@query(rf"""with {COMPARED}, sg as (select distinct file, {NUM.format(r'p(\d+): end=True, signal=(signature_block)', 1)} + 1 as page from se)
  select cp.file, cp.page, sg.page is not null as signature from cp left join sg on sg.file = cp.file and sg.page = cp.page where in_pred and not in_truth""")
def signature_false_positives(spark, sf):
    """O-D5: false positives that follow a signature line of the page before."""
    lines = _lines(spark, sf)
    sec = E.sections(lines)
    return E.signature_triage(_compared(lines, sec), sec)


RUN_LOG = """select 'run' || cast(user_id as string) as source, cast(row_number() over (partition by user_id order by ts, event_id) as int) as line_no,
  case when event_id % 7 < 6 then {clock} || ' ' else '' end || case event_id % 6 when 0 then 'File  : /data/case/Image_' || cast(event_id % 50 as string) || '.pdf' when 1 then 'end-of-document detection (' || cast(event_id % 40 as string) || ' pages)'
    when 2 then 'Boundaries — TP=3 FP=1 FN=0 P=75% F1=' || cast(event_id % 101 as string) || '%' when 3 then 'Rotations  — TP=' || cast(event_id % 2 as string) || ' FP=0 FN=' || cast(event_id % 5 % 2 as string) || ' F1=' || cast(event_id * 3 % 101 as string) || '%' else 'note' end as line
  from events"""
RUN_SQL = rf"""lg as ({RUN_LOG.format(clock="strftime(ts, '%H:%M:%S')")}),
  x as (select *, nullif(regexp_extract(line, 'File\s+:\s+\S+/(Image_\S+\.pdf)', 1), '') as f, {NUM.format(r'end-of-document detection \((\d+) pages\)', 1)} as pg, {NUM.format(r'Boundaries — TP=\d+ FP=\d+ FN=\d+.*F1=(\d+)%', 1)} as bf,
    {NUM.format(r'Rotations\s+— TP=(\d+) FP=(\d+) FN=(\d+).*F1=(\d+)%', 4)} as rf, {NUM.format(r'Rotations\s+— TP=(\d+) FP=(\d+) FN=(\d+)', 1)} + {NUM.format(r'Rotations\s+— TP=(\d+) FP=(\d+) FN=(\d+)', 2)} + {NUM.format(r'Rotations\s+— TP=(\d+) FP=(\d+) FN=(\d+)', 3)} as ra,
    case when regexp_matches(line, '^\d{{2}}:\d{{2}}:\d{{2}}') then line[1:2]::int * 3600 + line[4:5]::int * 60 + line[7:8]::int end as ck from lg),
  y as (select *, case when f is not null and not contains(f, '7') then 'L' || ({KEY.format('f')} % 10) end as lab from x),
  z as (select *, count(lab) over (partition by source order by line_no) as fi from y),
  w as (select *, first_value(lab) over v as label, first_value(ck) over v as began, coalesce(count(rf) over (v rows between unbounded preceding and 1 preceding), 0) as shut, last_value(pg ignore nulls) over (v rows between unbounded preceding and 1 preceding) as stated,
    count(bf) over (v rows between unbounded preceding and current row) as nth from z where fi > 0 window v as (partition by source, fi order by line_no)),
  u as (select * from w where shut = 0), b as (select * from u where bf is not null and nth = 1), bb as (select source, label, arg_max(bf, line_no) as boundary_f1 from b group by all),
  tt as (select source, label, max(line_no) as ln from b where began is not null and ck is not null group by all),
  t as (select b.source, b.label, (ck - began + 86400) % 86400 as seconds, stated as pages from b join tt on tt.source = b.source and tt.label = b.label and tt.ln = b.line_no),
  rr as (select source, label, arg_max(rf, line_no) as rotation_f1 from u where rf is not null and ra > 0 group by all),
  ru as (select source, label, seconds, pages, boundary_f1, rotation_f1 from bb left join t using (source, label) full join rr using (source, label))"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.sql(RUN_LOG.format(clock="date_format(ts, 'HH:mm:ss')").replace("from events", "from {events}"), events=table(spark, sf, "events"))
    k = F.regexp_extract("run_file", "_(\\d+)", 1).cast("int")
    return E.run_results(G.parse_run(log), F.when(~F.contains("run_file", F.lit("7")), F.concat(F.lit("L"), (k % 10).cast("string"))))


@query(f"with {RUN_SQL} select * from ru")
def run_log_results(spark, sf):
    """O-J7, O-P8, stats of a run's log: seconds, pages, boundary and rotation F1 by label."""
    return _runs(spark, sf)


@query(f"""with {RUN_SQL}, s as (select source, count(*) as n, sum(seconds)::bigint as total_s, sum(coalesce(pages, 0))::bigint as pages from ru where seconds is not null group by source)
  select source, n, total_s, round(total_s / n, 4) as s_per_file, pages, round(pages / n, 4) as pages_per_file, case when pages = 0 then 0 else round(total_s / pages, 4) end as s_per_page from s""")
def run_log_timing(spark, sf):
    """O-A13 by log; 0 where a log states no pages."""
    return E.timing(_runs(spark, sf), ("source",))


@query("""with h as (select (p_partkey % 7)::int as run, round(avg(p_size), 4) as precision, round(avg(p_size) + 1, 4) as recall, round(avg(p_size) + 2, 4) as f1 from part group by 1)
  select run, precision, recall, f1 from h where run <> 3 union all select 3, 12.5, 0.0, 0.0""")
def rotation_history(spark, sf):
    """O-W15: the current run's figures override the stored ones, absent ones are 0."""
    s = F.avg("p_size")
    h = table(spark, sf, "part").groupBy((F.col("p_partkey") % 7).cast("int").alias("run")).agg(F.round(s, 4).alias("precision"), F.round(s + 1, 4).alias("recall"), F.round(s + 2, 4).alias("f1"))
    now = spark.createDataFrame([(3, 12.5, None, None)], "run int, precision double, recall double, f1 double")
    return E.rotation_history(h, now)


# A log per user: blocks of overall figures with few distinct values, so that lines repeat within and across logs.
OVERALL_LOG = """select user_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as line_no, {clock} || case event_id * 7 % 11
    when 0 then '   PAGE ROTATION' when 1 then '   BOUNDARY DETECTION ' when 2 then '     Precision : ' || cast(event_id % 4 as string) || '.5%' when 3 then '     Precision : ' || cast(event_id % 5 as string) || '1.0%'
    when 4 then '     Recall    : ' || cast(event_id % 4 as string) || '.5%' when 5 then '     Recall    : ' || cast(event_id % 5 as string) || '1.0%' when 6 then '     F1 score  : ' || cast(event_id % 4 as string) || '.5%'
    when 7 then '     F1 score  : ' || cast(event_id % 3 as string) || '0.0%' when 8 then ' NO PAGE ROTATION here' else ' note' end as line from events"""
OVERALL_SQL = rf"""ol as ({OVERALL_LOG.format(clock="strftime(ts, '%H:%M:%S')")}),
  oh as (select *, nullif(regexp_extract(line, '^\d\d:\d\d:\d\d\s*(BOUNDARY DETECTION|PAGE ROTATION)\s*$', 1), '') as h, try_cast(nullif(regexp_extract(line, 'Precision\s*:\s*([\d.]+)%', 1), '') as double) as p,
    try_cast(nullif(regexp_extract(line, 'Recall\s*:\s*([\d.]+)%', 1), '') as double) as r, try_cast(nullif(regexp_extract(line, 'F1 score\s*:\s*([\d.]+)%', 1), '') as double) as f from ol),
  ob as (select *, last_value(h ignore nulls) over v as kind, count(h) over v as block from oh window v as (partition by user_id order by line_no)),
  oo as (select user_id, block, arg_min(p, line_no) filter (p is not null) as p, min(line_no) filter (p is not null) as pl, arg_min(r, line_no) filter (r is not null) as r, min(line_no) filter (r is not null) as rl,
    arg_min(f, line_no) filter (f is not null) as f, min(line_no) filter (f is not null) as fl from ob where kind = 'PAGE ROTATION' group by all),
  ot as (select user_id, p as precision, case when rl > pl then r end as recall, case when rl > pl and fl > rl then f end as f1 from oo where p is not null qualify block = max(block) over (partition by user_id))"""


def _overall(spark: SparkSession, sf: str) -> DataFrame:
    log = spark.sql(OVERALL_LOG.format(clock="date_format(ts, 'HH:mm:ss')").replace("from events", "from {events}"), events=table(spark, sf, "events"))
    return E.rotation_blocks(G.parse_overall(log.withColumnRenamed("user_id", "source"))).withColumnRenamed("source", "user_id")


@query(f"with {OVERALL_SQL} select * from ot")
def rotation_overall(spark, sf):
    """T15: a log's overall rotation figures by their section, whatever else has the same text."""
    return _overall(spark, sf)


@query(f"""with {OVERALL_SQL}, h as (select (p_partkey % 7)::int as run, round(avg(p_size), 4) as precision, round(avg(p_size) + 1, 4) as recall, round(avg(p_size) + 2, 4) as f1 from part group by 1),
  n as (select (user_id % 5 + 4)::int as run, arg_max(row(precision, recall, f1), user_id) as x from ot group by 1), m as (select run, x[1] as precision, coalesce(x[2], 0) as recall, coalesce(x[3], 0) as f1 from n)
  select run, precision, recall, f1 from h where run not in (select run from m) union all select run, precision, recall, f1 from m""")
def rotation_history_from_logs(spark, sf):
    """O-W15: runs' figures as their logs state them take the place of stored ones."""
    s = F.avg("p_size")
    h = table(spark, sf, "part").groupBy((F.col("p_partkey") % 7).cast("int").alias("run")).agg(F.round(s, 4).alias("precision"), F.round(s + 1, 4).alias("recall"), F.round(s + 2, 4).alias("f1"))
    # The log of a run's last user.
    x = F.max_by(F.struct("precision", "recall", "f1"), "user_id")
    return E.rotation_history(h, _overall(spark, sf).groupBy((F.col("user_id") % 5 + 4).cast("int").alias("run")).agg(x.alias("x")).select("run", "x.*"))
