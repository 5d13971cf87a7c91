"""A corpus pipeline of five operators over ``documents``.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last returns token digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharecast.llm import bpe, jaccard_join, line_dedup, quality_rules, registry, source_mix
from sharecast.llm.common import broadcast_if_small, pick
from sharecast.operators.ranks import global_rank
from sharecast.sources.files import drop_files, pin_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP = ("lang", "source")
#: Near copies: Jaccard of five-word shingles from 0.8 up (op9's 3 and 0.9 bind op9 only).
NEAR = {"n": 5, "num": 80, "den": 100}


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that failed. A null text
    has no words and goes; null ids, repeated rows and ids are judged row by row; an empty
    table gives no rows."""
    judged = quality_rules.apply_quality_rules(docs, keep=KEEP)
    return _documents(judged.filter("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share. A null text is one empty
    line; documents count by id (null ids as one), repeated rows each come back; a document
    whose lines all go stays with an empty text; an empty table gives no rows."""
    return _documents(line_dedup.dedup_lines(docs, keep=KEEP))


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents with ids and their number ``_doc``, a row each: the id where ids are
    unique, else the rank by id and text hash. Rows that repeat both are one document."""
    n, ids = docs.agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("_doc", F.col("doc_id"))
    d = docs.withColumn("_hash", F.xxhash64("text"))
    ranked = global_rank(d.select("doc_id", "_hash").distinct(), ["doc_id", "_hash"], rank_col="_doc")
    row = F.min(F.struct("lang", "source", "n_chars", "doc_id", "text")).alias("row")
    return d.join(ranked, ["doc_id", "_hash"]).groupBy("_doc").agg(row).select("row.*", "_doc")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents linked by similarity the one with the least id (and
    of its texts the one with the least hash). Rows that repeat an id and its text count
    once, different texts of one id are documents of their own; rows without an id are in
    no group and stay."""
    docs = pick(docs, COLUMNS)
    known = _numbered(docs.filter("doc_id is not null"))
    copies = jaccard_join.similar_groups(known, id_col="_doc", **NEAR).filter("_doc != component_id").select("_doc")
    first = known.join(broadcast_if_small(pin_table(copies, "pipeline-copies")), "_doc", "left_anti")
    return first.select(*COLUMNS).unionByName(docs.filter("doc_id is null").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (none, once or twice). A null or empty
    text has no words, so it only gets the certain copies of its source; a null source is a
    source; repeated rows share a draw and are taken or left alike; an empty table gives no
    rows."""
    mixed = source_mix.mix_sources(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text, per copy. A null text
    counts as empty and has no tokens; null and repeated ids each give their row; an empty
    table gives no rows."""
    vocabulary = registry.default_vocabulary()
    # the ids are written: encoding and decoding in one task would take two Python workers
    ids = pin_table(bpe.encode_texts(docs, vocabulary), "pipeline-ids")
    return bpe.token_digests(bpe.decode_ids(ids, vocabulary))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_copies", near_copies),
          ("source_mix", mixture), ("bpe", tokens)]

#: Not expressible in SQL (similarity components, token ids).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs, path = pin_table(stage(spark, docs, sf_dir), f"pipeline-{name}", with_path=True)
        if before:
            drop_files(spark, before)       # the next stage's rows are written
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
