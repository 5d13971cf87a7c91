"""Corpus-wide line deduplication.

Lines are normalised (ASCII white space stripped, A-Z lower-cased), exploded and
hashed; the distinct documents of every hash are counted; the lines of hashes in
at least ``min_docs`` documents go, and each document is put together again from
its other lines by position. Only hashes and positions are shuffled for the count:
the two-step count (distinct (hash, document), then documents per hash) combines
on the map side, so a line of a third of all documents costs a row per task. The
frequent keys are joined back by a broadcast of measured size, or with hot keys salted.
Texts move once, to meet their positions.

Defined cases: a null or empty text is one empty line; a key without characters is
never dropped; documents are told apart by id, null ids counting as one document;
repeated rows and ids each come back with their own text; a document whose lines
all go keeps an empty text; an empty table gives no rows; input columns other than
the id, the text and ``keep`` are ignored. Two 64-bit hashes stand for a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import lookup_join
from ..sources.files import pin_table
from .common import WS, ascii_lower, let, pick, sha256_hex

MIN_DOCS = 10


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def dedup_lines(docs: DataFrame, *, min_docs: int = MIN_DOCS, id_col: str = "doc_id",
                text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents without their frequent lines.

    Returns ``id_col``, the columns of ``keep``, ``text_col`` (the lines left, joined
    by line feeds), ``n_lines`` (before) and ``n_dropped``."""
    d = pick(docs, [id_col, text_col, *keep]).toDF("_id", "_text", *keep)
    d = d.withColumn("_text", F.coalesce("_text", F.lit("")))
    row_key = F.xxhash64("_text")
    lines = d.select("_id", row_key.alias("_row"),
                     F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    keyed = (lines.select("_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
             .filter(F.length("_key") >= 1)
             .select("_id", "_row", "_pos", F.xxhash64("_key").alias("_h"),
                     F.xxhash64(F.lit(min_docs), "_key", F.lit("line")).alias("_g")))
    keyed = pin_table(keyed, "line-keys")
    frequent = (keyed.select("_h", "_g", "_id").distinct()
                .groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") >= min_docs).select("_h", "_g"))
    drops = (lookup_join(keyed, pin_table(frequent.withColumn("_hit", F.lit(True)), "line-frequent"), ["_h", "_g"], salt_source="_row")
             .groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_drop"))
             .withColumnsRenamed({"_id": "_did", "_row": "_drow"}))
    both = d.withColumn("_row", row_key).join(
        drops, F.col("_id").eqNullSafe(F.col("_did")) & (F.col("_row") == F.col("_drow")), "left")
    left = let(F.split("_text", "\n", -1), lambda parts: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_drop")),
        lambda i: F.get(parts, i)), "\n"))
    n_lines = F.length("_text") - F.length(F.replace(F.col("_text"), F.lit("\n"), F.lit(""))) + 1
    return both.select(
        F.col("_id").alias(id_col), *keep,
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(left).alias(text_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))


def line_digests(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_lines", "n_dropped", sha256_hex(F.col("text")).alias("kept_sha256"))
