"""Share-statistics replies: one JSON text per (article, network).

Two reply styles exist: an array of objects (the count is a field of element
0) and a plain object. This binding derives replies from ``events``: article =
``user_id``, news source = ``user_id % 3``, network = ``event_type``; the reply text
wraps ``props`` as an array for the first network. The study compares two networks;
``networks`` restricts the replies to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed values of the binding: the two networks and their reply style, the field.
ARRAY_NETWORK = "click"
OBJECT_NETWORK = "view"
NETWORKS = (ARRAY_NETWORK, OBJECT_NETWORK)
COUNT_FIELD = "k"
N_SOURCES = 3


def share_replies(spark: SparkSession, sf_dir: str,
                  networks: tuple[str, ...] | None = None) -> DataFrame:
    """event_id, article_id, source, network, reply — of all networks, or of ``networks``."""
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    if networks is not None:
        ev = ev.filter(F.col("event_type").isin(*networks))
    reply = F.when(F.col("event_type") == F.lit(ARRAY_NETWORK),
                   F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    return ev.select("event_id", F.col("user_id").alias("article_id"),
                     F.pmod(F.col("user_id"), F.lit(N_SOURCES)).alias("source"),
                     F.col("event_type").alias("network"), reply.alias("reply"))


def metadata_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, record — JSON object texts used as page metadata records."""
    return table(spark, sf_dir, "events", "event_id", "props").select(
        "event_id", F.col("props").alias("record"))


def checked_counts(replies: DataFrame, field: str = COUNT_FIELD) -> tuple[DataFrame, DataFrame]:
    """Replies (reply: an object or an array of one) with their ``share_count``, and those
    without one: the reply as it is and the reason. The text is parsed once, permissively;
    what does not parse is kept as it came."""
    from .articles import BAD_REPLY, NO_FIELD

    body = F.regexp_replace("reply", r"(?s)^\s*\[(.*)\]\s*$", "$1")
    parsed = F.from_json(body, f"`{field}` bigint, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    read = replies.withColumn("_r", parsed)
    reason = (F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), BAD_REPLY)
              .when(F.col(f"_r.{field}").isNull(), NO_FIELD))
    judged = read.withColumn("reason", reason)
    return (judged.filter("reason is null").select(*replies.columns, F.col(f"_r.{field}").alias("share_count")),
            judged.filter("reason is not null").select(*replies.columns, "reason"))
