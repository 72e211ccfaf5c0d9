"""Quality rules by cross-document line frequency (native).

Base rules look at one text alone.  The method then hashes normalised lines
(A-Z lowered, white space collapsed), counts for each host the *distinct texts*
that hold a line, and removes lines found in more than ``max_docs`` of them from
every document but the earliest (smallest doc_id) that has them.  A document
that loses more than ``max_loss`` of its words this way is depleted and rejected.

Defined results: null or blank text has no words, no lines and fails the base
rule ``n_words < 10``; exact copies count as one text, so copying a page cannot
turn its lines into boilerplate; a null host is a host of its own; repeated rows
each get a row; rows are told apart by doc_id, host and text, so rows with equal or
null doc_id don't share losses; a null doc_id is the smallest, and all rows that
have the smallest doc_id of a line keep it; very long texts are counted whole; an
empty table gives none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, digest128, let, joined, window_hashes, words

MIN_WORDS, REPEAT_SHARE, MAX_DOCS, MAX_LOSS = 10, 20, 30, 50
HAS_WORD = "[^ \\t-\\r]"
KEY = ["__pagemill_id", "__pagemill_host", "__pagemill_t1", "__pagemill_t2"]


def keyed(docs: DataFrame, host: str) -> DataFrame:
    """What tells documents apart, in ``KEY``, and their text."""
    t1, t2 = digest128(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(*[c.alias(k) for c, k in zip((F.col("doc_id"), F.col(host), t1, t2), KEY, strict=True)], *docs.columns)


def key_is(left: DataFrame, right: DataFrame, prefix: str) -> Column:
    """Equality of ``KEY`` with the same columns of ``right`` named with ``prefix``; nulls are equal."""
    return (left[KEY[2]] == right[prefix + KEY[2]]) & (left[KEY[3]] == right[prefix + KEY[3]]) & left[KEY[0]].eqNullSafe(right[prefix + KEY[0]]) & left[KEY[1]].eqNullSafe(right[prefix + KEY[1]])


def repeat_words(ws: Column, n: int = 5) -> Column:
    """Words covered by ``n``-word windows that occur twice or more in the text.

    Texts without a repeated window, nearly all, stop at ``array_distinct``.
    Others sort (hash, position) and keep positions whose neighbour has the same
    hash, then measure the union of [p, p + n).
    """

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        starts = let(
            pairs,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"]) & (j > 0)) | F.get(s, j + 1)["h"].eqNullSafe(x["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        step = lambda acc, p: F.struct((p + n).alias("end"), (acc["n"] + p + n - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    return let(
        window_hashes(ws, n),
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)),
    ).cast("long")


def base(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document with the counts that a text gives alone; ``keep``: further columns to hand on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))
    counts = let(
        words(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            repeat_words(ws).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "doc_id",
        counts.alias("__c"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        *keep,
    ).select(
        "doc_id",
        "__c.n_words",
        "__c.word_chars",
        "n_symbols",
        "n_dup_lines",
        "__c.n_repeat_words",
        ((F.col("__c.n_words") < MIN_WORDS) | (100 * F.col("__c.n_repeat_words") > REPEAT_SHARE * F.col("__c.n_words"))).alias("base_failed"),
        *keep,
    )


def boilerplate(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Lines to remove of ``keyed`` documents: ``KEY``, line number (0-based, among \\n-split lines) and its words."""
    lines = docs.select(*KEY, F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike(HAS_WORD)).select(*KEY, "line_no", words(ascii_lower(F.col("line"))).alias("ws"))
    k1, k2 = digest128(F.array_join("ws", " "))
    lines = lines.select(*KEY, "line_no", F.size("ws").cast("long").alias("line_words"), k1.alias("k1"), k2.alias("k2"))
    line, least = [KEY[1], "k1", "k2"], F.coalesce(F.col(KEY[0]).cast("long"), F.lit(-(1 << 63)))
    over = (
        lines.groupBy(*line, KEY[2], KEY[3])
        .agg(F.min(least).alias("first"))
        .groupBy(*line)
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("first").alias("first_doc"))
        .where(F.col("n_docs") > max_docs)
    )
    # Lines above the limit are few; within Spark's size check they are sent to the lines, else both are shuffled.
    hit = joined(lines, over, line, grows=False)
    return hit.where(least != F.col("first_doc")).select(*KEY, "line_no", "line_words")


def _judge(docs: DataFrame, host: str, max_docs: int, max_loss: int) -> DataFrame:
    known = keyed(docs.select("doc_id", F.col(host), "text"), host)
    lost = (
        boilerplate(known, max_docs)
        .groupBy(*KEY, "line_no")
        .agg(F.max("line_words").alias("line_words"))
        .groupBy(*[F.col(k).alias("lost" + k) for k in KEY])
        .agg(F.sum("line_words").alias("removed_words"), F.array_sort(F.collect_list("line_no")).alias("removed_lines"))
    )
    b = base(known, tuple(KEY))
    removed = F.coalesce(F.col("removed_words"), F.lit(0)).cast("long")
    return b.join(lost, key_is(b, lost, "lost"), "left").select(
        *[c for c in b.columns if c not in KEY],
        removed.alias("removed_words"),
        F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"),
        (~F.col("base_failed") & (100 * removed <= max_loss * F.col("n_words"))).alias("kept"),
        *KEY,
    )


def judge(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_loss: int = MAX_LOSS) -> DataFrame:
    """``base`` plus ``removed_words``, ``removed_lines`` and ``kept``."""
    return _judge(docs, host, max_docs, max_loss).drop(*KEY)


def clean(docs: DataFrame, host: str = "source", max_docs: int = MAX_DOCS, max_loss: int = MAX_LOSS) -> DataFrame:
    """Kept documents, all their columns, with the lines above the limit cut from the text."""
    j = _judge(docs, host, max_docs, max_loss).where("kept").groupBy(*[F.col(k).alias("kept" + k) for k in KEY]).agg(F.first("removed_lines").alias("__pagemill_cut"))
    text = F.when(F.size("__pagemill_cut") == 0, F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("__pagemill_cut"), i)), "\n")
    )
    known = keyed(docs, host)
    out = known.join(j, key_is(known, j, "kept"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


ORACLE = r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, list_filter(string_split_regex(text, '[ \t-\r]+'), lambda x: x <> '') as ws from d),
win as (
  select doc_id, i, md5(concat_ws(chr(0), ws[i], ws[i+1], ws[i+2], ws[i+3], ws[i+4])) as h
  from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as i from w where len(ws) >= 5)),
rep as (select doc_id, i from (select *, count(*) over (partition by doc_id, h) as c from win) where c > 1),
cov as (select doc_id, count(distinct i + k) as n from rep, generate_series(0, 4) g(k) group by doc_id),
ln as (
  select doc_id, source, md5(text) as t, line, row_number() over (partition by doc_id order by line_no) as pos, line_no
  from (select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
               unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no from d)
  where regexp_matches(line, '[^ \t-\r]')),
dup as (select doc_id, count(*) - count(distinct line) as n from ln group by doc_id),
nl as (
  select doc_id, source, t, len(lw) as line_words, array_to_string(lw, ' ') as norm
  from (select *, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as lw from ln)),
over_limit as (select source, norm, min(doc_id) as first_doc from nl group by source, norm having count(distinct t) > 30),
lost as (
  select nl.doc_id, sum(line_words) as n from nl join over_limit o
  on nl.norm = o.norm and nl.source is not distinct from o.source where nl.doc_id <> o.first_doc group by nl.doc_id),
b as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
    coalesce(lost.n, 0)::bigint as removed_words
  from w left join cov using (doc_id) left join dup using (doc_id) left join lost using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed, removed_words,
  (not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * removed_words <= 50 * n_words) as kept
from b
"""
