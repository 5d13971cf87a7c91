"""Margins added slot by slot."""

import numpy as np

from sharecast.operators import models as M


def test_unrolled_margins_give_the_same_sums(spark):
    rows = [([-1], 1.0), ([-1, 0, 3], 0.0), ([-1, 2], 1.0), ([-1, 0, 1, 2, 3, 9], 0.0), ([], 1.0)]
    design = spark.createDataFrame(rows, "slots array<long>, label double")
    vectors = {"a": np.array([0.3, -0.1, 0.7, 1 / 3, -2.5]), "b": np.array([1.0, 0.1, 0.2, 0.3, 0.4])}
    losses = {"a": "logistic", "b": "hinge"}
    width = M.most_slots(design)
    assert width == 6 and M.most_slots(design.limit(0)) == 0
    one, other = (M.vector_gradients(design, vectors, losses, w) for w in (None, width))
    assert sorted(one.collect()) == sorted(other.collect())
    assert "lambda" not in other._jdf.queryExecution().optimizedPlan().toString().lower()
    wide = M.vector_gradients(design, vectors, losses, M.UNROLLED_SLOTS + 1)
    assert sorted(wide.collect()) == sorted(one.collect())
