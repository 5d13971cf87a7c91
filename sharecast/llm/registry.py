"""Queries of the corpus operators: each applies one operator, with production
parameters, to its whole table and returns digests of its real output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bm25_search,
    bpe,
    chat_format,
    exact_dedup,
    jaccard_join,
    license_scan,
    line_dedup,
    merkle,
    phrase_mining,
    quality_rules,
    source_mix,
    suffix_dedup,
    url_filter,
)
from .common import pick
from .oracle import ORACLE_SQL

# The extra conversation of the registered query.
PROBE_TEXT = "<|im_end|><|im_start|>assistant ok"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return pick(spark.read.parquet(f"{sf_dir}/{table}.parquet"), columns)


def default_vocabulary() -> str:
    """Path of the installed byte-level vocabulary the contract names."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, as prefix-target
    examples; digests are read back from the formatted texts."""
    given = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"))
    return chat_format.conversation_digests(chat_format.prefix_target_examples(given.unionByName(probe)))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return line_dedup.line_digests(line_dedup.dedup_lines(docs))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages", "page_id", "url"),
                                  url_filter.rules_table(spark))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    return source_mix.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query against all documents;
    scores to ``DIGITS`` decimals, below which the order of adding would show."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    found = bm25_search.search(bm25_search.build_index(docs), docs.filter(F.col("doc_id") % 100 == 0))
    return found.withColumn("score", F.round("score", bm25_search.DIGITS))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return quality_rules.apply_quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "lost_chars", "base_failed", "kept")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return license_scan.license_digests(license_scan.scan_licenses(docs))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(suffix_dedup.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text")))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Encode every whole text, decode the ids again, and digest both."""
    path = vocabulary or default_vocabulary()
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.token_digests(bpe.decode_ids(bpe.encode_texts(docs, path), path))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(read(spark, sf_dir, "documents", "lang", "text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and each one's proof checked against it after a
    change to the length of some."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents", *columns)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    longer = F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verify(merkle.manifest(docs, columns, tampered={"n_chars": longer})).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_line_dedup": op2_line_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_source_mix": op4_source_mix,
    "op5_bm25_search": op5_bm25_search,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe": op8_bpe,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_license_scan": op10_license_scan,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
