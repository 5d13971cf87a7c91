"""Model evaluation: log loss, ROC points, AUC, top-k reports, selection.

ROC follows the analysed workload: rows are ordered by score (descending),
every row is one step of the curve (tied scores are not merged), the curve
starts at the first row. Scores are compared exactly (a score adds its weights
in one fixed order, so equal rows score equally) and ties are broken by
``article_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_loss
from .ranks import PID, POS, freeze_order, rank_and_accumulate

GROUP = ["model", "split"]


def log_loss_table(scores: DataFrame, group_cols: list[str] = GROUP) -> DataFrame:
    """Mean row log loss per group — one aggregate, nothing collected."""
    return (scores.groupBy(*group_cols)
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.avg(log_loss("score", "label")).alias("log_loss")))


def baseline_log_loss(labeled: DataFrame, train_split: str = "train") -> DataFrame:
    """Log loss per split of the constant predictor p = mean training label."""
    p = (labeled.filter(F.col("split") == F.lit(train_split))
         .agg(F.avg("label")).first()[0])
    return (labeled.groupBy("split")
            .agg(F.avg(log_loss(F.lit(p), F.col("label"))).alias("baseline_log_loss")))


def ranked_scores(scores: DataFrame, group_cols: list[str] = GROUP) -> DataFrame:
    """Rows with their rank ``rn`` by score (highest first) and the positives up to there
    (``cum_label``) per group. The order is written once; :func:`roc_points` and
    :func:`auc` of one evaluation share it."""
    base = scores.select(*group_cols, "article_id", "label", "score")
    frozen = freeze_order(base, group_cols, [F.col("score").desc(), F.col("article_id").asc()])
    return rank_and_accumulate(frozen, group_cols, rank_col="rn", sums=["label"])


def roc_points(scores: DataFrame, group_cols: list[str] = GROUP,
               ranked: DataFrame | None = None) -> DataFrame:
    """One point per scored row: rn, tp, fp, tpr = tp / P, fpr = fp / N.

    P or N of zero gives NULL rates (the reference divides by zero).
    """
    ranked = ranked if ranked is not None else ranked_scores(scores, group_cols)
    totals = scores.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"),
                                             F.sum("label").alias("_p"))
    out = ranked.join(F.broadcast(totals), group_cols)
    tp = F.col("cum_label")
    fp = F.col("rn").cast("double") - tp
    return out.select(*group_cols, "rn", "article_id", "label", "score",
                      tp.alias("tp"), fp.alias("fp"),
                      F.try_divide(tp, F.col("_p")).alias("tpr"),
                      F.try_divide(fp, F.col("_n") - F.col("_p")).alias("fpr"))


def auc(scores: DataFrame, group_cols: list[str] = GROUP,
        ranked: DataFrame | None = None) -> DataFrame:
    """Area under the step-per-row ROC curve of each group.

    The trapezoid sum equals ``sum over negatives of tp / (P*N)`` (only
    negative rows move the x coordinate), i.e. with ranks rn:
    ``(P*N - sum_{positives} rn + P(P+1)/2) / (P*N)`` — needs only global ranks.
    """
    ranked = ranked if ranked is not None else ranked_scores(scores, group_cols)
    agg = ranked.groupBy(*group_cols).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.sum("label").alias("_p"),
        F.sum(F.when(F.col("label") == F.lit(1.0), F.col("rn").cast("double"))
              .otherwise(F.lit(0.0))).alias("_s"))
    pn = F.col("_p") * (F.col("_n") - F.col("_p"))
    area = pn - F.col("_s") + F.col("_p") * (F.col("_p") + F.lit(1.0)) / F.lit(2.0)
    return agg.select(*group_cols, F.try_divide(area, pn).alias("auc"))


def roc_steps(scores: DataFrame, group_cols: list[str] = GROUP,
              ranked: DataFrame | None = None) -> DataFrame:
    """A row per step of the curve, from each point to the next: rn (of the point), dx
    (next fpr - fpr), y (mean of both tpr) and area = dx * y; their sum is the AUC.

    The points lie in range partitions. Inside one, ``lead`` finds the next point; the
    last point of a partition takes the first one of the next partition that has rows of
    its group, from a table with a row per (partition, group)."""
    ranked = ranked if ranked is not None else ranked_scores(scores, group_cols)
    first = (ranked.groupBy(PID, *group_cols)
             .agg(F.min_by("cum_label", "rn").alias("_c"), F.min("rn").alias("_r")))
    after = Window.partitionBy(*group_cols).orderBy(PID)
    heads = first.select(PID, *group_cols, F.lead("_c").over(after).alias("_next_c"), F.lead("_r").over(after).alias("_next_r"))
    inside = Window.partitionBy(PID, *group_cols).orderBy(POS)
    points = ranked.select(PID, *group_cols, "rn", "cum_label", F.lead("cum_label").over(inside).alias("_tp"),
                           F.lead("rn").over(inside).alias("_rn"))
    totals = scores.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p"))
    both = points.join(F.broadcast(heads), [PID, *group_cols]).join(F.broadcast(totals), group_cols)
    tp, rn = F.coalesce("_tp", "_next_c"), F.coalesce("_rn", "_next_r")
    negatives = F.col("_n") - F.col("_p")
    fpr = F.try_divide(F.col("rn").cast("double") - F.col("cum_label"), negatives)
    dx = F.try_divide(rn.cast("double") - tp, negatives) - fpr
    y = (F.try_divide(tp, F.col("_p")) + F.try_divide(F.col("cum_label"), F.col("_p"))) / F.lit(2.0)
    return both.filter(rn.isNotNull()).select(*group_cols, "rn", dx.alias("dx"), y.alias("y"), (dx * y).alias("area"))


def auc_from_roc(roc: DataFrame, group_cols: list[str] = GROUP) -> DataFrame:
    """AUC from ROC points (same value as :func:`auc`): sum over negatives of tpr / N."""
    return (roc.groupBy(*group_cols)
            .agg(F.sum(F.when(F.col("label") == F.lit(0.0), F.col("tp")).otherwise(F.lit(0.0)))
                 .alias("_u"), F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_p"))
            .select(*group_cols, F.try_divide(F.col("_u"), F.col("_p") * (F.col("_n") - F.col("_p")))
                    .alias("auc")))


def top_positive_scores(scores: DataFrame, group_cols: list[str] = GROUP,
                        k: int = 5) -> DataFrame:
    """The k highest-scored positives per group (a top-k report).

    ``row_number() <= k`` lets Spark insert a partial per-task limit before the
    shuffle (WindowGroupLimit), so each group ships at most k rows per task.
    """
    w = Window.partitionBy(*group_cols).orderBy(F.col("score").desc(),
                                                F.col("article_id").asc())
    return (scores.filter(F.col("label") == F.lit(1.0))
            .withColumn("pos", F.row_number().over(w).cast("bigint"))
            .filter(F.col("pos") <= F.lit(k))
            .select(*group_cols, "pos", "article_id", "score"))


def smallest_weights(weights: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest coefficients per model (intercept excluded), plus the intercept."""
    coefs = weights.filter(F.col("feature_id") != F.lit(-1))
    w = Window.partitionBy("model").orderBy(F.col("weight").asc(),
                                            F.col("feature_id").asc())
    low = (coefs.withColumn("pos", F.row_number().over(w).cast("bigint"))
           .filter(F.col("pos") <= F.lit(k)))
    icpt = (weights.filter(F.col("feature_id") == F.lit(-1))
            .select("model", F.col("weight").alias("intercept")))
    return low.join(F.broadcast(icpt), "model").select(
        "model", "pos", "feature_id", "weight", "intercept")


def model_selection(auc_table: DataFrame, loss_table: DataFrame,
                    select_split: str = "val", final_split: str = "test") -> DataFrame:
    """Model with the highest AUC on ``select_split`` and its ``final_split`` figures."""
    best = (auc_table.filter(F.col("split") == F.lit(select_split))
            .agg(F.max_by("model", F.struct(F.col("auc"), F.col("model"))).alias("model"),
                 F.max("auc").alias("selection_auc")))
    final_auc = (auc_table.filter(F.col("split") == F.lit(final_split))
                 .select("model", F.col("auc").alias("final_auc")))
    final_loss = (loss_table.filter(F.col("split") == F.lit(final_split))
                  .select("model", F.col("log_loss").alias("final_log_loss")))
    return best.join(final_auc, "model").join(final_loss, "model")


def metrics_long(loss_table: DataFrame, auc_table: DataFrame,
                 baseline: DataFrame) -> DataFrame:
    """model, split, metric, value, text (value with three decimals)."""
    ll = loss_table.select("model", "split", F.lit("log_loss").alias("metric"),
                           F.col("log_loss").alias("value"))
    au = auc_table.select("model", "split", F.lit("auc").alias("metric"),
                          F.col("auc").alias("value"))
    bl = baseline.select(F.lit("baseline").alias("model"), "split",
                         F.lit("log_loss").alias("metric"),
                         F.col("baseline_log_loss").alias("value"))
    out = ll.unionByName(au).unionByName(bl)
    return out.withColumn("text", F.format_string("%.3f", F.col("value")))
