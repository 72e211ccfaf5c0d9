"""The registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, conversation_trie, decontaminate, hpylm, jaccard_join, line_dedup, merkle, quality_classifier, quality_rules, sharding, token_counts, url_filter, warc
from .common import read, scratch, stored

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hpylm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they hold."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("distance")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page; the outcomes are the labels whose doc_id is the page_id."""
    outcomes = read(spark, sf_dir, "labels").selectExpr("doc_id as page_id", "quality as good")
    return url_filter.judge(read(spark, sf_dir, "pages"), outcomes)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without what an earlier one has, and the removed spans as start-end of the original text."""
    out = line_dedup.dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col(line_dedup.REMOVED)
    spans = F.array_join(F.transform(r, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), " ")
    words = F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x["n_words"])
    return out.select("doc_id", "text", words.alias("removed_words"), spans.alias("removed_spans"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC files in the shared folder and reads them back."""
    path = scratch(spark, "archive")
    warc.write(read(spark, sf_dir, "pages"), path)
    return warc.records(spark, path).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").selectExpr("doc_id", "quality as label")
    return quality_classifier.classify(read(spark, sf_dir, "documents"), labels)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("removed_lines")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.encode(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    convs = stored(conversation_trie.sequences(read(spark, sf_dir, "conversations")), "conversations")
    return conversation_trie.trie(conversation_trie.rebuilt(convs))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every fifth one is verified with its text lower-cased."""
    proofs = merkle.verify(merkle.prove(read(spark, sf_dir, "documents"), merkle.lowered()))
    return proofs.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes; ``slot`` is the place in the shard."""
    out = sharding.shard(read(spark, sf_dir, "documents"), 40)
    none = F.lit(None).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", none.alias("grown_shard"), "virtual_slot", "map_version")


QUERIES: dict[str, Query] = {
    "op1_hpylm": op1_hpylm,
    "op2_decontamination": op2_decontamination,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_warc": op7_warc,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_sharding": op13_sharding,
}

ORACLES: dict[str, str] = {
    "op6_substring_dedup": line_dedup.ORACLE,
    "op2_decontamination": decontaminate.ORACLE,
    "op5_url_filter": url_filter.ORACLE,
    "op7_warc": warc.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
