"""Three-way train / validation / test split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import md5_bucket

# Split names and weights (80 / 10 / 10), seed of the random split.
SPLIT_NAMES = ("train", "val", "test")
SPLIT_WEIGHTS = (0.8, 0.1, 0.1)
SPLIT_SEED = 42
HASH_BUCKETS = 10


def hash_split(df: DataFrame, key: str = "article_id",
               weights: tuple[float, ...] = SPLIT_WEIGHTS,
               names: tuple[str, ...] = SPLIT_NAMES,
               buckets: int = HASH_BUCKETS) -> DataFrame:
    """Add ``bucket`` (md5 of the key mod ``buckets``) and ``split``.

    A narrow projection: reproducible across engines, partitionings and reruns.
    Weights are turned into whole-bucket cut points (0.8/0.1/0.1 → 8/1/1 of 10).
    """
    counts = [round(w * buckets) for w in weights]
    if sum(counts) != buckets:
        raise ValueError("weights must split the buckets exactly")
    b = md5_bucket(key, buckets)
    expr, upper = None, 0
    for name, n in zip(names, counts):
        upper += n
        cond = b < F.lit(upper)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return df.withColumn("bucket", b).withColumn("split", expr)


def random_split(df: DataFrame, weights: tuple[float, ...] = SPLIT_WEIGHTS,
                 seed: int = SPLIT_SEED, names: tuple[str, ...] = SPLIT_NAMES) -> DataFrame:
    """Random disjoint and complete split, tagged with ``split``: the parts of
    ``DataFrame.randomSplit`` one after the other. The draw depends on the input
    partitioning; use :func:`hash_split` when results must repeat across runs."""
    parts = df.randomSplit(list(weights), seed)
    out = None
    for name, part in zip(names, parts, strict=True):
        tagged = part.withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def split_counts(df: DataFrame, label: str | None = None) -> DataFrame:
    """Rows per split plus an ``all`` row (rollup); with ``label``, positives too."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    if label:
        aggs.append(F.count_if(F.col(label) == F.lit(1.0)).alias("n_positive"))
    rolled = df.rollup("split").agg(*aggs)
    return rolled.select(F.coalesce(F.col("split"), F.lit("all")).alias("split"),
                         *[c for c in rolled.columns if c != "split"])
