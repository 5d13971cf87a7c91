"""Exploration operators: share counts by network and source, sort by shares,
scatter data, one-feature least squares, page metadata, article age."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ranks import global_rank


def reply_counts(replies: DataFrame, array_network: str, field: str) -> DataFrame:
    """Parse each reply: array style for ``array_network``, object style otherwise."""
    count = F.when(F.col("network") == F.lit(array_network),
                   text.json_array_field("reply", field)).otherwise(
        text.json_object_field("reply", field))
    return replies.select("event_id", "article_id", "source", "network",
                          count.alias("share_count"))


def network_totals(counts: DataFrame) -> DataFrame:
    """article_id, source, network, shares, n_replies (partial aggregation)."""
    return (counts.groupBy("article_id", "source", "network")
            .agg(F.sum("share_count").alias("shares"),
                 F.count(F.lit(1)).alias("n_replies")))


def paired_networks(totals: DataFrame, first: str, second: str) -> DataFrame:
    """Both networks' totals of an article in a source side by side (equi-join on both)."""
    a = totals.filter(F.col("network") == F.lit(first)).select(
        "article_id", "source", F.col("shares").alias(f"{first}_shares"))
    b = totals.filter(F.col("network") == F.lit(second)).select(
        "article_id", "source", F.col("shares").alias(f"{second}_shares"))
    return a.join(b, ["article_id", "source"])


def pivot_networks(counts: DataFrame, networks: tuple[str, ...]) -> DataFrame:
    """Chart data: one row per article, one column per network.

    Same result as ``groupBy(...).pivot('network', networks).sum(...)`` (a
    network without replies gives NULL) but as one conditional aggregate: one
    shuffle instead of the pivot's two.
    """
    return counts.groupBy("article_id", "source").agg(*[
        F.sum(F.when(F.col("network") == F.lit(n), F.col("share_count"))).alias(n)
        for n in networks])


def stacked_networks(totals: DataFrame, first: str, second: str) -> DataFrame:
    """The two networks' totals one after the other (UNION ALL)."""
    a = totals.filter(F.col("network") == F.lit(first))
    b = totals.filter(F.col("network") == F.lit(second))
    return a.select("article_id", "network", "shares").unionByName(
        b.select("article_id", "network", "shares"))


def network_by_source(totals: DataFrame) -> DataFrame:
    """Per (source, network): total, mean per article, articles, best article."""
    return (totals.groupBy("source", "network")
            .agg(F.sum("shares").alias("total_shares"),
                 F.avg("shares").alias("mean_shares"),
                 F.count(F.lit(1)).alias("n_articles"),
                 F.max_by("article_id", F.struct(F.col("shares"), -F.col("article_id")))
                 .alias("top_article")))


def ranked_by(df: DataFrame, value: str, key: str, start: int = 0) -> DataFrame:
    """Position of every row when sorted by ``value`` descending (ties by key)."""
    return global_rank(df, [F.col(value).desc(), F.col(key).asc()],
                       rank_col="position", start=start)


def scatter_points(df: DataFrame, x: str, y: str, x_range: tuple[float, float],
                   y_range: tuple[float, float]) -> DataFrame:
    """Points inside the plot window (filters reach the parquet scan)."""
    return df.filter(F.col(x).between(*x_range) & F.col(y).between(*y_range))


def least_squares(df: DataFrame, x: str, y: str) -> DataFrame:
    """Slope and intercept of y on x — one hash aggregate."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_count(F.col(y), F.col(x)).alias("n_points"))


def least_squares_ml(df: DataFrame, x: str, y: str) -> DataFrame:
    """The same fit with ``pyspark.ml`` (normal equations aggregated on executors)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    data = VectorAssembler(inputCols=[x], outputCol="features").transform(
        df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias("label")))
    model = LinearRegression(solver="normal", regParam=0.0, standardization=True).fit(data)
    spark = df.sparkSession
    return spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))],
                                 "slope double, intercept double")


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, script, statement, record_text, record_value, is_mapping."""
    script = text.first_script("html")
    stmt = text.first_statement(script)
    rec = text.strip_indent(text.assigned_text(stmt))
    return pages.select("page_id", script.alias("script"), stmt.alias("statement"),
                        rec.alias("record_text")).select(
        "*", text.scalar_value("record_text").alias("record_value"),
        text.record_map("record_text").isNotNull().alias("is_mapping"))


def record_fields(records: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of each metadata record and the values of selected keys."""
    m = text.record_map("record")
    out = records.select("event_id", m.alias("_m"))
    return out.select("event_id",
                      F.array_join(F.array_sort(F.map_keys("_m")), ",").alias("keys"),
                      F.size(F.map_keys("_m")).cast("bigint").alias("n_keys"),
                      *[F.element_at("_m", F.lit(k)).alias(f"value_{k}") for k in keys])


def nested_fields(records: DataFrame, paths: dict[str, tuple[str, str]], *, keep: list[str],
                  record: str = "record") -> DataFrame:
    """``keep``, ``is_nested`` (the record is an object or list) and, per name of ``paths``
    ({name: (path, type)}), the value there; NULL if the path is missing or of another type."""
    v = records.select(*keep, text.record_variant(record).alias("_v"))
    return v.select(*keep, F.col("_v").isNotNull().alias("is_nested"),
                    *[F.try_variant_get("_v", path, kind).alias(name) for name, (path, kind) in paths.items()])


def record_schema(records: DataFrame, record: str = "record") -> DataFrame:
    """One row, ``schema``: the merged type of all records, nested ones included."""
    return records.agg(F.schema_of_variant_agg(text.record_variant(record)).alias("schema"))


def article_age(orders: DataFrame, as_of: str) -> DataFrame:
    """Publication date as 'MM/dd/yyyy' text and the age in days at ``as_of``."""
    pub = text.pub_date_text("o_orderdate")
    return orders.select(F.col("o_orderkey").alias("article_id"), pub.alias("pub_date")) \
        .withColumn("age", text.age_days("pub_date", as_of))
