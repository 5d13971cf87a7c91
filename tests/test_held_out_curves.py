"""Curves of the held-out rows."""

from pyspark.sql import functions as F

from sharecast.operators import evaluate as E
from sharecast.plans.popularity import Evaluation


def test_held_out_curves_sort_no_training_rows(spark):
    scores = spark.createDataFrame(
        [("lr", s, i, float(i % 3 == 0), (i * 37 % 11) / 11) for i in range(60) for s in [("train", "val", "test")[i % 4 % 3]]],
        "model string, split string, article_id long, label double, score double")
    ev = Evaluation(scores, scores)
    assert ev.held_out_ranked.filter("split = 'train'").count() == 0
    got = E.roc_points(ev.held_out, ranked=ev.held_out_ranked)
    assert sorted(got.collect()) == sorted(ev.roc.filter(F.col("split") != "train").collect())
