"""The reference trainers themselves, for parity checks on small data.

``pyspark.mllib``'s ``LogisticRegressionWithSGD`` / ``SVMWithSGD`` keep the
weight vector on the driver and broadcast it every iteration, so they do not
scale to very large dictionaries; :mod:`models` is the distributed trainer.
These helpers build the RDD of ``LabeledPoint`` (the MLlib API boundary) from
the encoded arrays and return the fitted weights as plain lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def labeled_point_rdd(arrays: DataFrame, size: int):
    """RDD[LabeledPoint] from rows (label, feature_ids sorted array)."""
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.regression import LabeledPoint

    def to_point(row):
        ids = list(row["feature_ids"])
        return LabeledPoint(row["label"], SparseVector(size, ids, [1.0] * len(ids)))

    return arrays.select("label", "feature_ids").rdd.map(to_point)


def train_mllib(points, loss: str, iterations: int = 50, reg: float = 1e-6):
    """(weights list, intercept) from the MLlib SGD trainer with the
    reference's settings: L2, intercept, step 1.0, full batch."""
    from pyspark.mllib.classification import LogisticRegressionWithSGD, SVMWithSGD

    trainer = LogisticRegressionWithSGD if loss == "logistic" else SVMWithSGD
    model = trainer.train(points, iterations, regParam=reg, regType="l2", intercept=True)
    return list(model.weights.toArray()), float(model.intercept)
