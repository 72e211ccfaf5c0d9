"""From raw documents to token identifiers in five stages.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of
``documents`` (the last one: what encoding gives), is written as Parquet to the
folder that all executors share, and read again as the next one's input.

Defined results: null, empty, blank and short texts go in the first stage; rows are
told apart by doc_id and text, so rows with equal or null doc_id and other texts are
documents of their own, and equal rows stay or go together; very long texts are
processed whole; an empty table gives none; further columns of documents are carried
to the last stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from pagemill.llm.common import read, stored
from pagemill.llm.queries import tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that their host repeats."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of near copies."""
    return jaccard_join.clean(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document has."""
    return line_dedup.clean(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of identifiers and decoded text."""
    import public_tokenizers

    return byte_bpe.encode(docs, tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substrings),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: BPE merging is not expressible in SQL; tests/llm hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
