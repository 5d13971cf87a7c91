"""Property checks: AUC equals the reference's trapezoid procedure
on random inputs with ties, the ROC curve is monotone and ends at (1, 1), the
log loss of a constant predictor is the entropy, the split partitions its
input."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sharecast.functions import columns as C
from sharecast.operators import evaluate as E
from sharecast.operators.split import hash_split

from .conftest import SF_SMALL

PAIRS = st.lists(st.tuples(st.booleans(), st.integers(0, 6)), min_size=2, max_size=60).filter(
    lambda xs: 0 < sum(x[0] for x in xs) < len(xs))


def _trapezoids(rows):
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    y = np.array([r[1] for r in rows], dtype=float)
    tp = y.cumsum()
    p = tp[-1]
    fp = np.arange(1.0, len(y) + 1) - tp
    tpr, fpr = tp / p, fp / (len(y) - p)
    return float(np.sum((np.roll(fpr, -1) - fpr)[:-1] * ((np.roll(tpr, -1) + tpr)[:-1] / 2)))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(PAIRS)
def test_auc_property(spark, pairs):
    rows = [(i, float(lab), s / 10.0) for i, (lab, s) in enumerate(pairs)]
    df = spark.createDataFrame([("m", "val", i, y, s) for i, y, s in rows],
                               "model string, split string, article_id long, label double, score double")
    got = E.auc(df).first()["auc"]
    assert 0.0 <= got <= 1.0
    assert got == pytest.approx(_trapezoids(rows), abs=1e-12)
    roc = E.roc_points(df).orderBy("rn").collect()
    tprs, fprs = [r.tpr for r in roc], [r.fpr for r in roc]
    assert all(a <= b for a, b in zip(tprs, tprs[1:])) and all(a <= b for a, b in zip(fprs, fprs[1:]))
    assert (tprs[-1], fprs[-1]) == (1.0, 1.0)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.floats(0.01, 0.99), st.integers(5, 40), st.integers(5, 40))
def test_constant_predictor_log_loss_is_entropy(spark, p, n_pos, n_neg):
    df = spark.createDataFrame([(1.0,)] * n_pos + [(0.0,)] * n_neg, "label double")
    got = df.agg(F.avg(C.log_loss(F.lit(p), F.col("label")))).first()[0]
    q = n_pos / (n_pos + n_neg)
    assert got == pytest.approx(-(q * math.log(p) + (1 - q) * math.log(1 - p)))


def test_hash_split_partitions_input(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(F.col("o_orderkey").alias("article_id"))
    out = hash_split(orders)
    assert out.count() == orders.count()
    assert out.select("article_id").distinct().count() == orders.count()
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    frac = out.filter("split = 'train'").count() / orders.count()
    assert 0.75 < frac < 0.85
