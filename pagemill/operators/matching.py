"""Noisy titles against a reference nomenclature (idx, name) of any length.

The k best entries per title by (exact, containment, trigram similarity, token ratio,
table order), the same as if every title were scored against every entry, found in
rounds:

* the entries that have one of a title's rarest trigrams are scored; the k-th best
  sets the similarity that others must reach;
* entries that can reach it share a trigram of the title's prefix, its rarest
  |A| - ceil(t |A|) + 1 ones, and have a fitting number of trigrams;
* a contained name has the rarest trigram of what is inside the other;
* a title with fewer than k entries that share a trigram is filled up by token ratio
  alone.  Entries are dealt into blocks of equal length; a block's largest count of
  each letter bounds the ratio from above.  The best block is scored, then those whose
  bound reaches what it gave.

Ratios, the one step in Python, are made for entries that tie with the k-th best and in
those blocks only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources.folders import stored
from .scan import scan

#: Rarest trigrams of a title that are looked up first; entries in a block.
PROBES, BLOCK = 3, 256


def entries(nomenclature: DataFrame) -> DataFrame:
    """idx, name, tokens, squashed form and its trigrams of entries that are not empty when normalised."""
    e = nomenclature.select("idx", "name", T.title_tokens(F.col("name"), compose=True).alias("e_tokens")).withColumn("e_squashed", T.squash(F.col("e_tokens")))
    return e.where("e_squashed <> ''").withColumn("e_trigrams", T.trigrams(F.col("e_squashed")))


def _titles(titles: DataFrame) -> DataFrame:
    q = titles.select("title").where("title is not null").distinct().withColumn("q_tokens", T.title_tokens(F.col("title"), strip_identifiers=True, compose=True)).withColumn("q_squashed", T.squash(F.col("q_tokens")))
    return q.withColumn("q_trigrams", F.when(F.col("q_squashed") != "", T.trigrams(F.col("q_squashed"))).otherwise(F.array().cast("array<string>")))


def scored(pairs: DataFrame, q: DataFrame, e: DataFrame) -> DataFrame:
    """(title, idx) with exact, containment and trigram."""
    s = pairs.join(q, "title").join(e, "idx")
    s = s.withColumn("exact", ((F.col("q_squashed") != "") & (F.col("q_squashed") == F.col("e_squashed"))).cast("int"))
    s = s.withColumn("containment", ((F.col("q_squashed") != "") & T.contained(F.col("q_squashed"), F.col("e_squashed"))).cast("int"))
    s = s.withColumn("trigram", F.when(F.col("q_squashed") == "", 0.0).otherwise(T.jaccard(F.col("q_trigrams"), F.col("e_trigrams"))))
    return s.select("title", "idx", "exact", "containment", "trigram")


def _by_rarity(rows: DataFrame, key: str, grams: str, freq: DataFrame) -> DataFrame:
    """(key, place, t, found): a row's trigrams, the rarest first; those of no entry are not ``found``."""
    x = rows.select(key, F.explode(grams).alias("t")).join(freq, "t", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("n", "t")))
    return x.groupBy(key).agg(listed.alias("o")).select(key, F.posexplode("o").alias("place", "x")).select(key, "place", "x.t", (F.col("x.n") > 0).alias("found"))


def _inner(squashed: str) -> Column:
    """Distinct trigrams inside a string, without its padded ends."""
    s = F.col(squashed)
    return F.when(F.length(s) >= 5, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3)))))


def _contained(q: DataFrame, e: DataFrame, freq: DataFrame) -> DataFrame:
    """(title, idx) of which one is in the other: found by the rarest trigram inside the one that is contained."""
    qi, ei = q.select("title", "q_squashed", _inner("q_squashed").alias("g")), e.select("idx", "e_squashed", _inner("e_squashed").alias("g"))
    rarest = lambda d, key: _by_rarity(d, key, "g", freq).where("place = 0").select(key, "t")
    fits = T.contained(F.col("q_squashed"), F.col("e_squashed"))
    every = lambda d, *cols: d.select(*cols, F.explode("g").alias("t"))
    a = rarest(qi, "title").join(qi.drop("g"), "title").join(every(ei, "idx", "e_squashed"), "t").where(fits)
    b = rarest(ei, "idx").join(ei.drop("g"), "idx").join(every(qi, "title", "q_squashed"), "t").where(fits)
    return a.select("title", "idx").union(b.select("title", "idx"))


def sharing(q: DataFrame, e: DataFrame, k: int) -> DataFrame:
    """(title, idx, exact, containment, trigram) of the entries with a common trigram that may be among the k best, ties with the k-th included."""
    freq = stored(e.select(F.explode("e_trigrams").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")), "freq")
    order = stored(_by_rarity(q, "title", "q_trigrams", freq).join(q.select("title", F.size("q_trigrams").alias("nq")), "title"), "order")
    nth = F.row_number().over(Window.partitionBy("title").orderBy("place"))
    order = order.where("found").withColumn("nth", nth)
    posting = e.select("idx", F.size("e_trigrams").alias("ne"), F.explode("e_trigrams").alias("t"))
    first = order.where(F.col("nth") <= PROBES).join(posting, "t").select("title", "idx").union(_contained(q, e, freq)).distinct()
    first = stored(scored(first, q, e), "first")
    best = Window.partitionBy("title").orderBy(F.desc("exact"), F.desc("containment"), F.desc("trigram"))
    kth = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("title", F.when(F.col("containment") == 1, 2.0).otherwise(F.col("trigram")).alias("reach"))
    more = order.where(F.col("nth") > PROBES).join(kth, "title", "left").withColumn("reach", F.coalesce("reach", F.lit(0.0)))
    more = more.where(F.col("place") < F.col("nq") - F.ceil(F.col("reach") * F.col("nq") - 1e-9) + 1).where("reach <= 1").join(posting, "t")
    size = (F.col("ne") >= F.col("reach") * F.col("nq") - 1e-9) & (F.col("ne") * F.col("reach") <= F.col("nq") + 1e-9)
    more = more.where(size).select("title", "idx").distinct().join(first.select("title", "idx"), ["title", "idx"], "left_anti")
    every = first.union(scored(more, q, e)).where("trigram > 0")
    return every.withColumn("r", F.rank().over(best)).where(F.col("r") <= k).drop("r")


def _letters(text: str) -> Column:
    """How often each letter stands in a text."""
    s = F.col(text)
    return F.map_from_entries(F.transform(F.array_distinct(F.split(s, "")), lambda c: F.struct(c.alias("c"), (F.length(s) - F.length(F.replace(s, c, F.lit("")))).alias("n"))))


def _token_text(tokens: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def filled(q: DataFrame, e: DataFrame, found: DataFrame, k: int, fuzzy: bool) -> DataFrame:
    """(title, idx) of entries without a common trigram for titles that have fewer than k with one: enough for the k best."""
    have = found.groupBy("title").agg(F.count(F.lit(1)).alias("have"))
    short = q.join(have, "title", "left").withColumn("need", k - F.coalesce("have", F.lit(0))).where("need > 0")
    # Without ratios the table's order decides, and fewer than k entries are taken already.
    plain = short if not fuzzy else short.where("q_squashed = ''")
    first = e.orderBy("idx").limit(2 * k).select("idx")
    pairs = plain.select("title").join(F.broadcast(first)).select("title", "idx")
    if fuzzy:
        pairs = pairs.union(_by_ratio(stored(short.where("q_squashed <> ''").select("title", "need", "q_tokens"), "short"), e, found))
    return pairs.join(found.select("title", "idx"), ["title", "idx"], "left_anti")


def _by_ratio(short: DataFrame, e: DataFrame, found: DataFrame) -> DataFrame:
    """(title, idx) that hold the ``need`` best entries by token ratio besides ``found``."""
    t = short.withColumn("s", _token_text("q_tokens")).withColumn("ls", F.length("s")).withColumn("letters", _letters("s"))
    d = e.select("idx", "e_tokens", _token_text("e_tokens").alias("s")).withColumn("le", F.length("s"))
    size = d.groupBy("le").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    d = stored(d.join(size, "le").withColumn("part", F.pmod(F.xxhash64("idx"), F.col("parts"))), "dealt")
    most = d.select("le", "part", F.explode(_letters("s")).alias("c", "n")).groupBy("le", "part", "c").agg(F.max("n").alias("n")).groupBy("le", "part").agg(F.map_from_entries(F.collect_list(F.struct("c", "n"))).alias("most"))
    common = F.aggregate(F.map_entries("letters"), F.lit(0), lambda acc, x: acc + F.least(x["value"], F.coalesce(F.try_element_at("most", x["key"]), F.lit(0))))
    # Titles that share too little with any entry, against one row for BLOCK entries.
    bound = stored(t.select("title", "need", "ls", "letters").join(most).select("title", "need", "le", "part", (F.lit(2.0) * F.least(common, F.col("ls"), F.col("le")) / (F.col("ls") + F.col("le"))).alias("bound")), "bound")

    def rated(blocks: DataFrame) -> DataFrame:
        x = blocks.join(d, ["le", "part"]).join(found.select("title", "idx"), ["title", "idx"], "left_anti").join(t.select("title", "q_tokens"), "title")
        return x.select("title", "need", "idx", T.token_set_ratio("q_tokens", "e_tokens").alias("ratio"))

    w = Window.partitionBy("title").orderBy(F.desc("bound"), "le", "part")
    ranked = bound.withColumn("r", F.row_number().over(w))
    first = stored(rated(ranked.where("r = 1")), "rated")
    kth = first.withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("ratio")))).where("r = need").select("title", "ratio")
    rest = ranked.where("r > 1").join(kth.withColumnRenamed("ratio", "reach"), "title", "left").where("reach is null or bound >= reach")
    both = first.union(rated(rest.select("title", "need", "le", "part")))
    return both.withColumn("r", F.row_number().over(Window.partitionBy("title").orderBy(F.desc("ratio"), "idx"))).where("r <= need").select("title", "idx")


def top(titles: DataFrame, nomenclature: DataFrame, k: int = 1, fuzzy: bool = True) -> DataFrame:
    """The k best entries per distinct title (fewer only if the table has fewer); null titles have none."""
    q, e = stored(_titles(titles), "titles"), stored(entries(nomenclature), "entries")
    found = stored(sharing(q, e, k), "sharing")
    s = found.unionByName(scored(filled(q, e, found, k, fuzzy), q, e))
    s = s.join(q.select("title", "q_tokens"), "title").join(e.select("idx", "name", "e_tokens"), "idx")
    s = s.withColumn("token_set", T.token_set_ratio("q_tokens", "e_tokens") if fuzzy else F.lit(0.0))
    w = Window.partitionBy("title").orderBy(F.desc("exact"), F.desc("containment"), F.desc("trigram"), F.desc("token_set"), "idx")
    best = s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.select(
        "title", "rank", "idx", "name", "exact", "containment", F.round("trigram", 4).alias("trigram"), F.round("token_set", 4).alias("token_set"),
        T.band(F.col("exact"), F.col("containment"), F.col("trigram"), F.col("token_set")).alias("band"),
    )


def resolve_codes(codes: DataFrame, nomenclature: DataFrame, last: int = 19999) -> DataFrame:
    """Adds resolved code and name: the code itself, its category's rest class (x999), or ``last``."""
    n = nomenclature.select(F.col("code").alias("__c"), F.col("name").alias("__n"))
    d = codes.withColumn("__rest", (F.floor(F.col("code") / 1000) * 1000 + 999).cast("int"))
    d = d.join(n.select(F.col("__c").alias("__c1"), F.col("__n").alias("__n1")), F.col("code") == F.col("__c1"), "left")
    d = d.join(n.select(F.col("__c").alias("__c2"), F.col("__n").alias("__n2")), F.col("__rest") == F.col("__c2"), "left")
    d = d.join(n.where(F.col("__c") == last).select(F.col("__n").alias("__n3")), F.lit(True), "left")
    return d.withColumn("resolved", F.coalesce("__c1", "__c2", F.lit(last))).withColumn("resolved_name", F.coalesce("__n1", "__n2", "__n3")).drop("__rest", "__c1", "__n1", "__c2", "__n2", "__n3")


def categories(nomenclature: DataFrame) -> DataFrame:
    """One line per category: its names in code order."""
    cat = (F.floor(F.col("code") / 1000) * 1000).cast("int")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("code", "name"))), lambda x: F.concat(x["code"].cast("string"), F.lit(" "), x["name"]))
    return nomenclature.groupBy(cat.alias("category")).agg(F.array_join(listed, "; ").alias("listed"))


def read_entries(rows: DataFrame, sheet_types: list[str]) -> DataFrame:
    """A table of codes (idx, raw_code, name) as entries: idx, code, name, category, squashed, tokens, is_sheet_type.

    A row whose code is a multiple of 1000 names the category of those from it on; rows
    without a name are dropped after that, codes that are no numbers are null.  A
    table of any length is scanned in parts.
    """
    name = F.regexp_replace(F.coalesce("name", F.lit("")), "^(?U:\\s)+|(?U:\\s)+$", "")
    d = rows.select("idx", F.col("raw_code").try_cast("double").cast("int").alias("code"), name.alias("name"))
    d = scan(d, [], ["idx"], category=("last", F.when(F.col("code") % 1000 == 0, F.col("name")))).where("name <> ''")
    d = d.withColumn("tokens", T.title_tokens(F.col("name"), compose=True)).withColumn("squashed", T.squash(F.col("tokens")))
    known = rows.sparkSession.createDataFrame([(x,) for x in sheet_types], "sheet string").select(T.squash(T.title_tokens(F.col("sheet"), compose=True)).alias("squashed"), F.lit(True).alias("__sheet")).distinct()
    return d.join(known, "squashed", "left").select("idx", "code", "name", "category", "squashed", "tokens", F.coalesce("__sheet", F.lit(False)).alias("is_sheet_type"))
