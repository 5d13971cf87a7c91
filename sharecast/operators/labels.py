"""Popularity label (shares per day above a threshold) and its profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import shares_per_day, threshold_label
from ..schema import POPULARITY_THRESHOLD


def with_label(df: DataFrame, shares: str = "shares", age: str = "timedelta",
               threshold: float = POPULARITY_THRESHOLD, on_zero: str = "raise") -> DataFrame:
    """Add ``rate`` = shares / age and ``label`` = 1.0 if rate > threshold else 0.0.

    ``on_zero='raise'`` fails on a zero age (ANSI division); ``'drop'`` removes
    such rows instead.
    """
    if on_zero not in ("raise", "drop"):
        raise ValueError("on_zero must be 'raise' or 'drop'")
    rate = shares_per_day(shares, age, "raise" if on_zero == "raise" else "null")
    out = df.withColumn("rate", rate)
    if on_zero == "drop":
        out = out.filter(F.col("rate").isNotNull())
    return out.withColumn("label", threshold_label("rate", threshold))


def positive_fraction(labeled: DataFrame) -> DataFrame:
    """One row: rows, positives and their ratio over all splits."""
    return labeled.agg(F.count(F.lit(1)).alias("n_rows"),
                       F.count_if(F.col("label") == F.lit(1.0)).alias("n_positive"),
                       F.avg("label").alias("positive_fraction"))


def label_mean(labeled: DataFrame, split: str = "train") -> DataFrame:
    return (labeled.filter(F.col("split") == F.lit(split))
            .agg(F.avg("label").alias("label_mean")))


def rate_profile(labeled: DataFrame, threshold: float = POPULARITY_THRESHOLD) -> DataFrame:
    """Range, moments and skew of shares per day, the share above the threshold
    and the oldest age — one hash aggregate, no sort."""
    return labeled.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min("rate").alias("min_rate"),
        F.max("rate").alias("max_rate"),
        F.avg("rate").alias("mean_rate"),
        F.stddev_pop("rate").alias("stddev_rate"),
        F.skewness("rate").alias("skewness_rate"),
        F.count_if(F.col("rate") > F.lit(threshold)).alias("n_above"),
        F.avg((F.col("rate") > F.lit(threshold)).cast("double")).alias("fraction_above"),
        F.max("timedelta").alias("max_timedelta"),
    )


def rate_quantiles(labeled: DataFrame, probs: tuple[float, ...] = (0.25, 0.5, 0.75, 0.93),
                   accuracy: int = 10_000) -> DataFrame:
    """Approximate quantiles of shares per day (Greenwald-Khanna summaries merged
    across tasks; relative rank error ~1/accuracy). The 0.93 quantile is where
    the 7 % popular share starts."""
    q = F.percentile_approx("rate", list(probs), accuracy)
    return labeled.agg(q.alias("q")).select(
        *[F.col("q")[i].alias(f"q{int(round(p * 100)):02d}") for i, p in enumerate(probs)])
