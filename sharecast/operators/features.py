"""Categorical features: parse, long form, dictionary, one-hot encoding.

Every predictor value is a category and the feature key is (idx, value), idx
being the predictor's position among the predictors. The dictionary is fitted
on the training split only; values never seen there get no feature id. A NULL
value is no category: it is in no dictionary and activates no feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import LINE_SEPARATOR
from .joins import lookup_join
from .ranks import global_rank


def feature_pairs(predictors: list[str]) -> Column:
    """array<struct<idx:int, value:string>> of the predictor columns."""
    return F.array(*[F.struct(F.lit(i).cast("int").alias("idx"),
                              F.col(c).cast("string").alias("value"))
                     for i, c in enumerate(predictors)])


def feature_long(df: DataFrame, predictors: list[str], keep: list[str]) -> DataFrame:
    """One row per (row, predictor): ``keep`` columns plus idx, value (narrow)."""
    return df.select(*keep, F.inline(feature_pairs(predictors)))


def split_line(line, sep: str = LINE_SEPARATOR) -> Column:
    """Fields of a text line (``sep`` is literal text, not a pattern)."""
    col = F.col(line) if isinstance(line, str) else line
    return F.split(col, _literal_pattern(sep))


def _literal_pattern(sep: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in sep)


def parse_line(line, sep: str = LINE_SEPARATOR) -> Column:
    """Fields 2 .. n-2 of a line as (idx, value) pairs, idx counted from 0.

    Field 0 (url), field 1 (age) and the last field (shares) are not predictors.
    """
    parts = split_line(line, sep)
    n = F.size(parts)
    preds = F.when(n >= F.lit(3), F.slice(parts, 3, n - F.lit(3))).otherwise(
        F.array().cast("array<string>"))
    return F.transform(preds, lambda v, i: F.struct(i.cast("int").alias("idx"),
                                                    v.alias("value")))


def drop_header(lines: DataFrame, header: str, col: str = "value") -> DataFrame:
    """Remove every line equal to the header (not only the first one)."""
    return lines.filter(F.col(col) != F.lit(header))


def distinct_features(long_train: DataFrame) -> DataFrame:
    """Distinct (idx, value) with the number of rows carrying it (hash aggregate,
    partial before the shuffle, so a frequent value costs one row per task)."""
    return (long_train.filter(F.col("value").isNotNull())
            .groupBy("idx", "value").agg(F.count(F.lit(1)).alias("n_rows")))


def dictionary_size_estimate(long_train: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Approximate distinct values per predictor (HyperLogLog++, one pass,
    fixed-size state per task) — sizes the dictionary before fitting it."""
    return long_train.groupBy("idx").agg(
        F.approx_count_distinct("value", rsd).alias("approx_values"))


def dictionary_sketches(long: DataFrame, by: list[str], lg_k: int = 12) -> DataFrame:
    """A HyperLogLog sketch of the distinct values per predictor and ``by`` (binary, a few
    KB), to be stored: sketches of new data merge with old ones without a rescan."""
    return (long.filter(F.col("value").isNotNull()).groupBy("idx", *by)
            .agg(F.hll_sketch_agg("value", lg_k).alias("sketch"), F.count(F.lit(1)).alias("n_rows")))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of any parts (days, splits, sources) merged per predictor and ``by``, with
    the estimated number of distinct values."""
    return (sketches.groupBy("idx", *by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_rows").alias("n_rows"))
            .withColumn("estimate", F.hll_sketch_estimate("sketch")))


def fit_dictionary(long_train: DataFrame) -> DataFrame:
    """idx, value, n_rows, feature_id — ids 0..n-1 in (idx, value) order.

    Ids come from :func:`ranks.global_rank`, so no task ever holds the whole
    dictionary; the result is written as a table in the shared folder.
    """
    from ..sources.files import pin_table

    distinct = distinct_features(long_train)
    ranked = global_rank(distinct, [F.col("idx").asc(), F.col("value").asc()],
                         rank_col="feature_id", start=0)
    return pin_table(ranked.select("idx", "value", "n_rows", "feature_id"), "dictionary")


def encode_long(long: DataFrame, dictionary: DataFrame, how: str = "inner") -> DataFrame:
    """Attach feature ids; ``how='inner'`` drops values unseen in training,
    ``'left'`` keeps them with a NULL id."""
    dim = dictionary.select("idx", "value", "feature_id")
    return lookup_join(long, dim, ["idx", "value"], how=how, salt_source="article_id")


def encode_arrays(long: DataFrame, dictionary: DataFrame, keep: list[str]) -> DataFrame:
    """One row per article: sorted active feature ids and their count.

    Articles whose values are all unseen keep an empty list.
    """
    enc = encode_long(long, dictionary, how="left")
    return (enc.groupBy(*keep)
            .agg(F.array_sort(F.collect_list("feature_id")).alias("feature_ids"))
            .withColumn("n_active", F.size("feature_ids").cast("bigint")))


def sparse_vector_parts(ids: str, size: Column) -> Column:
    """(size, indices, values) of the binary sparse vector of sorted ids."""
    return F.struct(size.cast("bigint").alias("size"), F.col(ids).alias("indices"),
                    F.array_repeat(F.lit(1.0), F.size(ids)).alias("values"))


#: Names of features that a vector model keeps on the driver at most.
VECTOR_NAMES = 500_000


def vector_model(dictionary: DataFrame, max_names: int = VECTOR_NAMES):
    """A ``CountVectorizerModel`` of the dictionary: its index of a feature is the feature's
    id. The names (``idx=value``) are kept by the driver, so there may be ``max_names``."""
    from pyspark.ml.feature import CountVectorizerModel

    if dictionary.limit(max_names + 1).count() > max_names:
        raise ValueError(f"more than {max_names} features; use encode_arrays for models of that size")
    names = dictionary.orderBy("feature_id").select(_feature_name().alias("name")).toArrow()["name"].to_pylist()
    model = CountVectorizerModel.from_vocabulary(names, "names", "features")
    return model.setBinary(True)


def _feature_name() -> Column:
    return F.concat(F.col("idx").cast("string"), F.lit("="), F.col("value"))


def feature_vectors(long: DataFrame, dictionary: DataFrame, keep: list[str], max_names: int = VECTOR_NAMES) -> DataFrame:
    """``keep`` and ``features``, the one-hot vector of each article as the vector column
    that ``pyspark.ml`` estimators take. Values that are not in the dictionary add nothing."""
    rows = long.groupBy(*keep).agg(F.collect_list(F.when(F.col("value").isNotNull(), _feature_name())).alias("names"))
    return vector_model(dictionary, max_names).transform(rows).select(*keep, "features")
