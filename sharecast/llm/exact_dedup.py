"""Exact deduplication by content: rows are grouped by a 128-bit hash of the normalised
text, the smallest id of a group stays, and the bytes inside groups are compared.

Hashes move, texts rarely do. One pass writes (id, hash) rows; groups are counted with
map-side combining, so a text that a third of all rows hold costs a row per task. Only
texts of groups of two or more are then compared: a second pass picks them by a
broadcast of the groups' hashes (measured), by a Bloom filter of bounded size, or, with
more groups than that holds, not at all; grouping by (hash, text) then compares bytes,
again a row per task for a hot text. A hash with two different texts (a collision) has
its rows grouped anew by hash and text; the others take their group by hash alone,
through a join that broadcasts a measured table or salts hot hashes.

Defined cases: a null text counts as empty; runs of ASCII white space count as one space,
also at the ends (no other character does); null ids come after all others, and a group
of such rows only has a null ``keep_id``; of rows that repeat an id and a text one stays
(any, they are alike); an empty table gives no rows; columns other than the id, the text
and ``keep`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import BLOOM_WORDS, bloom_prefilter, lookup_join
from ..sources.files import pin_table
from .common import BROADCAST_BYTES, pick, sha256_hex

#: A run of white space that is not a single space already.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A hash of 16 bytes with its share of a broadcast hash table.
HASH_BYTES = 64


def normal_text(c: Column) -> Column:
    """The text with every run of ASCII white space replaced by one space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), UNEVEN_SPACE, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the SHA-256 of the normalised text."""
    return F.unhex(F.substring(sha256_hex(text), 1, 32))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per group of two or more: its size, smallest id and the row that stays."""
    return (rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_least"),
        F.coalesce(F.min_by("_row", "_id"), F.min("_row")).alias("_first")).filter("_n > 1"))


def _decided(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return lookup_join(rows, groups, keys, how="left", salt_source="_row").select(
        "_id", "_sha", *[c for c in rows.columns if c not in ("_id", "_sha", "_h", "_row", "_norm")],
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("_keep"),
        F.coalesce("_n", F.lit(1)).alias("_n"),
        (F.col("_n").isNull() | (F.col("_row") == F.col("_first"))).alias("_stays"))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                 digest: Callable[[Column], Column] = content_hash, broadcast_bytes: int = BROADCAST_BYTES,
                 bloom_words: int = BLOOM_WORDS) -> DataFrame:
    """Per row: ``id_col``, the columns of ``keep``, ``keep_id`` (the smallest id of the
    rows with an equal text), ``group_size``, ``kept`` and ``text_sha256``.

    ``digest`` hashes a normalised text; whatever it is, only equal texts share a group."""
    d = pick(docs, [id_col, text_col, *keep]).toDF("_id", "_text", *[f"_k{i}" for i in range(len(keep))])
    hashed = d.withColumn("_norm", normal_text(F.col("_text"))).drop("_text").withColumn("_h", digest(F.col("_norm")))
    rows = pin_table(hashed.withColumn("_sha", sha256_hex(F.col("_norm"))).drop("_norm")
                     .withColumn("_row", F.monotonically_increasing_id()), "copies-rows")
    groups = pin_table(_groups(rows, ["_h"]), "copies-groups")
    wanted = groups.select("_h")
    if groups.count() * HASH_BYTES <= broadcast_bytes:
        members = hashed.join(F.broadcast(wanted), "_h", "left_semi")
    else:
        members = bloom_prefilter(hashed, wanted, ["_h"], max_words=bloom_words)
    texts = members.select("_h", "_norm").distinct()
    collided = pin_table(texts.groupBy("_h").agg(F.count(F.lit(1)).alias("_texts")).filter("_texts > 1").select("_h"),
                         "copies-collisions")
    if collided.limit(1).count() == 0:
        out = _decided(rows, groups, ["_h"])
    else:
        apart = pin_table(hashed.join(collided, "_h", "left_semi").withColumn("_sha", sha256_hex(F.col("_norm")))
                          .withColumn("_row", F.monotonically_increasing_id()), "copies-apart")
        out = _decided(rows.join(collided, "_h", "left_anti"), groups.join(collided, "_h", "left_anti"), ["_h"]).unionByName(
            _decided(apart, _groups(apart, ["_h", "_norm"]), ["_h", "_norm"]))
    return out.select(F.col("_id").alias(id_col), *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                      F.col("_keep").alias("keep_id"), F.col("_n").cast("long").alias("group_size"),
                      F.col("_stays").alias("kept"), F.col("_sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows that stay, with their texts and the columns of ``keep``."""
    columns = tuple(dict.fromkeys((text_col, *keep)))
    return exact_groups(docs, id_col=id_col, text_col=text_col, keep=columns).filter("kept").select(id_col, *columns)
