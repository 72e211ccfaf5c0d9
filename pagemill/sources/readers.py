"""Readers: nested JSON truth, annotations, logs and folders as long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scan import scan

def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("j"))


def page_map(spark: SparkSession, path: str) -> DataFrame:
    """{file: [page, ...]} as (file, page)."""
    return _json(spark, path, "map<string, array<int>>").select(F.explode("j").alias("file", "pages")).select("file", F.explode("pages").alias("page"))


def strata(spark: SparkSession, path: str) -> DataFrame:
    return _json(spark, path, "map<string, string>").select(F.explode("j").alias("file", "stratum"))


def masks(spark: SparkSession, path: str) -> DataFrame:
    """{file: [[lo, hi], ...]}, inclusive, as (file, lo, hi)."""
    r = _json(spark, path, "map<string, array<array<int>>>").select(F.explode("j").alias("file", "ranges")).select("file", F.explode("ranges").alias("r"))
    return r.select("file", F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi"))


def waivers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, fp_page int, class string, rationale string, attested_by string, date string").json(path, multiLine=True)


def rotation_map(spark: SparkSession, path: str) -> DataFrame:
    """{file: {"page": degrees}} as (file, page, deg); pages are strings in JSON."""
    r = _json(spark, path, "map<string, map<string, int>>").select(F.explode("j").alias("file", "m")).select("file", F.explode("m").alias("p", "deg"))
    return r.select("file", F.col("p").cast("int").alias("page"), "deg")


def results(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of an evaluation result: (tol, file, page)."""
    schema = "docs_exact int, docs_total int, by_tolerance map<string, struct<TP int, FP int, FN int, precision double, recall double, f1 double, per_file array<struct<file string, pred array<int>, true array<int>, fp array<int>, fn array<int>>>>>"
    r = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("by_tolerance").alias("tol", "r")).select("tol", F.explode("r.per_file").alias("f"))
    return r.select(F.col("tol").cast("int").alias("tol"), "f.file", F.explode("f.pred").alias("page"))


def rotation_notes(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``path  page  degrees [tag]`` as (file, page, deg, nested)."""
    line = "^(.*\\S)\\s+(\\d+)\\s+(\\d+)\\s*(?:\\[(\\w+)\\])?\\s*$"
    t = spark.read.text(path).where(F.col("value").rlike(line))
    part = lambda k: F.regexp_extract("value", line, k)
    return t.select(part(1).alias("file"), part(2).cast("int").alias("page"), part(3).cast("int").alias("deg"), (part(4) == "nested").alias("nested"))


def page_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``path [a-b], n, ... # note`` as (file, page)."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("v")).where("v <> ''")
    items = F.regexp_extract_all("v", F.lit("(?:\\[(\\d+)-\\d+\\]|(\\d+))(?=\\s*(?:,|$))"), F.lit(0))
    t = t.select(F.regexp_extract("v", "^(\\S+)", 1).alias("file"), F.explode(items).alias("x"))
    lo = F.regexp_extract("x", "(\\d+)", 1).cast("int")
    hi = F.coalesce(F.regexp_extract("x", "-(\\d+)", 1).try_cast("int"), lo)
    return t.select("file", F.explode(F.sequence(lo, hi)).alias("page"))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, line_no, line) with the order of each file, from 0; undecodable bytes become U+FFFD.

    Files are read in splits, so one may be of any size: a line's number is its place
    in its split plus the lines of the file's splits before.
    """
    t = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.expr("make_valid_utf8(value)").alias("line"), F.monotonically_increasing_id().alias("at")
    )
    sizes = t.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("source", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("source", "block").orderBy("at")) - 1
    numbered = t.withColumn("local", local).join(before, ["source", "block"])
    return numbered.select("source", (F.col("before") + F.col("local")).cast("int").alias("line_no"), "line")


def pdf_listing(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Paths of PDF files in order.  Flat: any case of the suffix; recursive: ``.pdf`` only, nothing below a folder named split."""
    r = spark.read.format("binaryFile")
    if recursive:
        files = r.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(path)
        return files.select("path").where(~F.array_contains(F.split("path", "/"), "split")).orderBy("path")
    return r.load(path).select("path").where(F.lower("path").endswith(".pdf")).orderBy("path")


def usage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key string, label string, ms bigint, tokens bigint")


def piece_starts(paths: DataFrame) -> DataFrame:
    """First page of a split piece from its name ``..<n>_PDFsam_<stem>.pdf``: (path, stem, start_page)."""
    rx = "(\\d+)_PDFsam_([^/]*)\\.[pP][dD][fF]$"
    return paths.where(F.col("path").rlike(rx)).select("path", F.regexp_extract("path", rx, 2).alias("stem"), F.regexp_extract("path", rx, 1).cast("int").alias("start_page"))


def nomenclature_rows(spark: SparkSession, path: str) -> DataFrame:
    """(idx, raw_code, name) of a CSV file without header, in its order (see ``operators.matching.read_entries``)."""
    t = spark.read.csv(path, schema="raw_code string, name string")
    placed = t.select("*", F.monotonically_increasing_id().alias("__at"))
    return scan(placed, [], ["__at"], idx=("count_before", F.lit(1))).select(F.col("idx").cast("int").alias("idx"), "raw_code", "name")
