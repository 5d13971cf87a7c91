"""Join strategies with checked sizes and hot-key splitting.

* ``bounded_broadcast`` broadcasts a side only after counting it.
* ``bloom_prefilter`` drops rows without a partner ahead of a shuffle: a Bloom filter
  of bounded size is built from the keys by task, merged and broadcast.
* ``lookup_join`` joins a large fact table to a dimension with unique keys
  (a dictionary). A dimension of bounded rows and bytes is broadcast. A larger
  one is shuffle-joined; keys that carry a large share of the fact rows (a
  binary predictor's ``'0.0'``, a frequent value the dictionary lacks) are
  salted: their fact rows spread over up to ``salts`` reducers, in proportion to
  their share, and the few hot dimension rows are replicated to each of their
  salts, so no reducer receives a whole hot key. NULL keys match nothing and
  never enter the join; nor do rows that the Bloom filter of the dimension's keys
  (if they fit one) turns away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_BROADCAST_ROWS = 500_000
DEFAULT_MAX_HOT_KEYS = 10_000
DEFAULT_BROADCAST_BYTES = 64 << 20
#: A Bloom filter has at most so many 64-bit words (a broadcast of some 64 MB), and
#: so many bits a key; keys that would need more get no filter.
BLOOM_WORDS = 1 << 21
BLOOM_BITS = 12


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df``."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _small(dim: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether ``dim`` has at most so many rows and bytes (texts are measured)."""
    width = F.lit(16 * len(dim.columns))
    for f in dim.schema.fields:
        if isinstance(f.dataType, T.StringType):
            width = width + F.coalesce(F.octet_length(F.col(f.name)), F.lit(0))
    rows, size = dim.agg(F.count(F.lit(1)), F.sum(width.cast("long"))).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def _bloom_place(keys: list[str], words: int) -> tuple[Column, Column]:
    """The word of a key and its bits there (four of 64, from one 64-bit hash)."""
    h = F.xxhash64(*keys)
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.shiftrightunsigned(h, 24) % F.lit(words), mask


def bloom_prefilter(fact: DataFrame, dim: DataFrame, keys: list[str], *,
                    max_words: int = BLOOM_WORDS) -> DataFrame:
    """The rows of ``fact`` whose keys may occur in ``dim``: all that do, and of the
    others some two in a hundred. Where the distinct keys of ``dim`` need more than
    ``max_words`` words, ``fact`` itself (a filter of that size turns nothing away).
    Rows with a NULL key match nothing."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    wanted = dim.filter(known).select(*keys).distinct()
    words = max(1 << 10, wanted.count() * BLOOM_BITS // 64 + 1)
    if words > max_words:
        return fact
    word, mask = _bloom_place(keys, words)
    bits = (wanted.select(word.alias("_word"), mask.alias("_bits"))
            .groupBy("_word").agg(F.bit_or("_bits").alias("_bits")))
    return (fact.filter(known).withColumn("_word", word).withColumn("_mask", mask)
            .join(F.broadcast(bits), "_word")
            .filter(F.col("_bits").bitwiseAND(F.col("_mask")) == F.col("_mask"))
            .drop("_word", "_mask", "_bits"))


def lookup_join(fact: DataFrame, dim: DataFrame, keys: list[str], *, how: str = "inner",
                broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
                broadcast_bytes: int = DEFAULT_BROADCAST_BYTES,
                max_hot_keys: int = DEFAULT_MAX_HOT_KEYS,
                salts: int | None = None, salt_source: str | None = None) -> DataFrame:
    """Join ``fact`` to ``dim`` (unique on ``keys``), adding dim's other columns.

    ``how`` is ``inner`` or ``left``. A fact row with a NULL key matches nothing:
    it is dropped or, for ``left``, gets NULLs without passing the join.
    ``salt_source`` is a fact column used to spread hot rows.

    Hot keys are those carrying at least ``total / max_hot_keys`` fact rows
    (counted with map-side combining), so there are at most ``max_hot_keys`` of
    them (a bounded broadcast). A hot key with ``w`` rows gets
    ``min(salts, ceil(w / threshold))`` salts: its fact rows spread over that many
    reducers and its dimension row, if there is one, is replicated that many
    times — at most ``2 * max_hot_keys`` extra dimension rows.
    """
    payload = [c for c in dim.columns if c not in keys]
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    dim = dim.filter(known)
    if _small(dim, broadcast_rows, broadcast_bytes):
        return fact.join(F.broadcast(dim), keys, how)

    spark = fact.sparkSession
    salts = salts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = bloom_prefilter(fact.filter(known), dim, keys) if how == "inner" else fact.filter(known)
    counts = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_w"))
    threshold = max(1, (usable.count() or 0) // max_hot_keys)
    hot = counts.filter(F.col("_w") >= F.lit(threshold)).select(
        *keys, F.least(F.lit(salts), F.ceil(F.col("_w") / F.lit(threshold))).cast("int").alias("_n_salts"))
    spread = F.col(salt_source) if salt_source else F.xxhash64(*fact.columns)
    tagged = (usable.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.when(F.col("_n_salts").isNotNull(),
                                          F.pmod(F.xxhash64(spread), F.col("_n_salts")))
                          .otherwise(F.lit(0)).cast("int"))
              .drop("_n_salts"))
    salted_dim = (dim.join(F.broadcast(hot), keys, "left")
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n_salts", F.lit(1)) - F.lit(1))))
                  .select(*keys, "_salt", *payload))
    out = tagged.join(salted_dim, keys + ["_salt"], how).drop("_salt")
    if how == "left":
        out = out.unionByName(fact.filter(~known), allowMissingColumns=True)
    return out
