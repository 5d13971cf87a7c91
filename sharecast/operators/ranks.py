"""Global ranks and running sums without a single-task window.

A window with no ``partitionBy`` (or with a partition key that holds a whole
split) moves every row into one task. Here the rows are range-partitioned on
the full sort key (ties are split across partitions because the key is total)
and sorted inside each partition; in that same pass every row records its
partition id and its position inside the partition as columns, and the result
is written once to the shared folder. The order is thus data: any later read
split, retry or lost executor sees the same ids. Each (partition, group)
chunk is then summarised into a table with one row per chunk — at most
``#partitions + #groups`` rows — whose exclusive prefix sums give every row its
global offset. That small table is the only thing broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PID = "_pid"
POS = "_pos"


def freeze_order(df: DataFrame, group_cols: list[str], order: list[Column]) -> DataFrame:
    """Sort by ``group_cols`` then ``order`` (must be a total order) and pin it.

    Returns the rows with ``_pid`` (partition) and ``_pos`` (an id increasing
    along the sort order inside each partition).
    """
    from ..sources.files import pin_table

    keys = [F.col(c).asc() for c in group_cols] + list(order)
    tagged = (df.orderBy(*keys).withColumn(PID, F.spark_partition_id())
              .withColumn(POS, F.monotonically_increasing_id()))
    return pin_table(tagged, "ordered")


def _chunks(frozen: DataFrame, group_cols: list[str], sums: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n"), F.min(POS).alias("_first")]
    aggs += [F.sum(c).alias(f"_s_{c}") for c in sums]
    chunks = frozen.groupBy(PID, *group_cols).agg(*aggs)
    before = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(
        Window.unboundedPreceding, -1)
    cols = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before")]
    cols += [F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}")
             for c in sums]
    return chunks.select(PID, *group_cols, "_first", *cols)


def rank_and_accumulate(frozen: DataFrame, group_cols: list[str], *,
                        rank_col: str = "rn", sums: list[str] | None = None,
                        prefix: str = "cum_") -> DataFrame:
    """Add the 1-based position inside each group and inclusive running sums.

    ``frozen`` comes from :func:`freeze_order`. Group columns must be non-null.
    """
    sums = sums or []
    chunks = _chunks(frozen, group_cols, sums)
    out = frozen.join(F.broadcast(chunks), [PID, *group_cols])
    out = out.withColumn(rank_col, (F.col("_n_before") + (F.col(POS) - F.col("_first"))
                                    + F.lit(1)).cast("bigint"))
    if sums:
        local = Window.partitionBy(PID, *group_cols).orderBy(POS).rowsBetween(
            Window.unboundedPreceding, Window.currentRow)
        for c in sums:
            out = out.withColumn(prefix + c, F.col(f"_b_{c}") + F.sum(c).over(local))
    drop = ["_first", "_n_before"] + [f"_b_{c}" for c in sums]
    return out.drop(*drop)


def global_rank(df: DataFrame, order: list[Column], *, group_cols: list[str] | None = None,
                rank_col: str = "rn", start: int = 1) -> DataFrame:
    """Position of each row in the sort order (per group), starting at ``start``."""
    group_cols = group_cols or []
    frozen = freeze_order(df, group_cols, order)
    ranked = rank_and_accumulate(frozen, group_cols, rank_col=rank_col)
    if start != 1:
        ranked = ranked.withColumn(rank_col, F.col(rank_col) + F.lit(start - 1))
    return ranked.drop(PID, POS)
