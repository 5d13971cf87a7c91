"""Binding of the article table to the given TPC-H-like tables.

The article file the analysed workload reads is not available, so an article
table of the same shape is derived from ``orders ⋈ customer ⋈ nation`` plus the
line count of each order:

  article_id  o_orderkey
  url         'article/<o_orderkey>'
  timedelta   days from the order date to the as-of date (double)
  shares      o_totalprice / 20
  f0..f6      order priority, market segment, nation, order status,
              line count, month, year — all as strings (categories)
  f7          the order date as text (optional; it has values unseen in training)

This module only shapes rows; all model work happens in ``operators``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import bounded_broadcast
from .tables import table

# Fixed values of the binding.
AS_OF_DATE = "2001-08-09"
SHARES_DIVISOR = 20.0
PREDICTORS = ["f0", "f1", "f2", "f3", "f4", "f5", "f6"]
PREDICTORS_WITH_DATE = PREDICTORS + ["f7"]


def predictors(with_date: bool = False) -> list[str]:
    return list(PREDICTORS_WITH_DATE if with_date else PREDICTORS)


def articles(spark: SparkSession, sf_dir: str, with_date: bool = False) -> DataFrame:
    """article_id, url, timedelta, shares, f0..f6[, f7] — one row per order."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus",
                   "o_totalprice", "o_orderdate", "o_orderpriority")
    customer = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    # Line counts are aggregated before the join (partial aggregation map-side),
    # so the join input is one row per order, already hash-partitioned by key.
    lines = (table(spark, sf_dir, "lineitem", "l_orderkey")
             .groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines")))
    odate = F.col("o_orderdate").cast("date")
    joined = (orders
              .join(customer, F.col("o_custkey") == F.col("c_custkey"))
              .join(bounded_broadcast(nation, 10_000),
                    F.col("c_nationkey") == F.col("n_nationkey"))
              .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    cols = [
        F.col("o_orderkey").alias("article_id"),
        F.concat(F.lit("article/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.datediff(F.lit(AS_OF_DATE).cast("date"), odate).cast("double").alias("timedelta"),
        (F.col("o_totalprice") / F.lit(SHARES_DIVISOR)).alias("shares"),
        F.col("o_orderpriority").alias("f0"),
        F.col("c_mktsegment").alias("f1"),
        F.col("n_name").alias("f2"),
        F.col("o_orderstatus").alias("f3"),
        F.coalesce(F.col("n_lines"), F.lit(0)).cast("string").alias("f4"),
        F.month(odate).cast("string").alias("f5"),
        F.year(odate).cast("string").alias("f6"),
    ]
    if with_date:
        cols.append(F.date_format(odate, "yyyy-MM-dd").alias("f7"))
    return joined.select(*cols)


def article_columns(with_date: bool = False) -> list[str]:
    """Column order of the article file: url, timedelta, predictors, shares."""
    return ["url", "timedelta"] + predictors(with_date) + ["shares"]


#: Why a line or reply is turned away.
BAD_FIELDS, BAD_AGE, BAD_SHARES, BAD_REPLY, NO_FIELD = "field count", "age", "shares", "no json", "no count"


def articles_from_file(spark: SparkSession, path: str) -> DataFrame:
    """The 61-column article file (comma + space separated, header line on top).

    Read as the study reads it: text lines, every line equal to the header
    dropped, fields split on ', ' and taken by position; the names come from
    the header. Predictors stay strings; age and shares become doubles (an
    unparsable number raises under ANSI, like ``float()``; see
    :func:`checked_articles` for a reader that sets such lines apart).

    ``article_id`` is the line's number in the input (:func:`files.numbered_lines`), so
    ties follow the input's order and repeated lines are rows of their own.
    Split on ``url`` (:func:`hash_split` with ``key='url'``) for a split that
    repeats across runs.
    """
    from .files import first_line, numbered_lines

    header = first_line(spark, path)
    return _article_fields(numbered_lines(spark, path, skip=header), header)


def _article_fields(lines: DataFrame, header: str) -> DataFrame:
    from ..operators.features import split_line
    from ..schema import LINE_SEPARATOR

    names = [n.strip() for n in header.split(LINE_SEPARATOR)]
    parts = split_line("value")
    cols = []
    for i, name in enumerate(names):
        c = F.get(parts, i)
        if i in (1, len(names) - 1):
            c = c.cast("double")
        cols.append(c.alias(name))
    return lines.select(*cols, F.col("line_no").alias("article_id"))


def checked_articles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The articles of a file (as :func:`articles_from_file`) and the lines that are none:
    article_id, value (the line as it is) and reason. Every line is in one of the two;
    the first reason counts: a wrong number of fields, an age that is no number, shares
    that are none."""
    from ..operators.features import split_line
    from ..schema import LINE_SEPARATOR
    from .files import first_line, numbered_lines

    header = first_line(spark, path)
    lines = numbered_lines(spark, path, skip=header)
    parts, n = split_line("value"), len(header.split(LINE_SEPARATOR))
    reason = (F.when(F.size(parts) != n, BAD_FIELDS)
              .when(F.get(parts, 1).try_cast("double").isNull(), BAD_AGE)
              .when(F.get(parts, n - 1).try_cast("double").isNull(), BAD_SHARES))
    judged = lines.withColumn("reason", reason)
    return (_article_fields(judged.filter("reason is null"), header),
            judged.filter("reason is not null").select(F.col("line_no").alias("article_id"), "value", "reason"))
