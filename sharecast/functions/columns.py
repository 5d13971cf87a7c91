"""Scalar expressions of the popularity workload.

All are built from ``pyspark.sql.functions``; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: clamp of the row log loss.
LOG_LOSS_EPSILON = 10e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_bucket(key, buckets: int = 10) -> Column:
    """Reproducible bucket of a key: first 32 bits of md5(key text) mod ``buckets``."""
    head = F.substring(F.md5(_c(key).cast("string")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("bigint"), F.lit(buckets))


def shares_per_day(shares, age, on_zero: str = "raise") -> Column:
    """shares / age in days. ``on_zero='raise'`` keeps ANSI division (error on a
    zero age, as the reference's float division does); ``'null'`` yields NULL."""
    if on_zero == "raise":
        return _c(shares).cast("double") / _c(age).cast("double")
    return F.try_divide(_c(shares).cast("double"), _c(age).cast("double"))


def threshold_label(rate, threshold: float) -> Column:
    """1.0 when rate is strictly above the threshold, else 0.0."""
    return F.when(_c(rate) > F.lit(threshold), F.lit(1.0)).otherwise(F.lit(0.0))


def sigmoid(margin) -> Column:
    """Logistic function 1 / (1 + e^-m); a huge negative margin gives 0.0."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(margin)))


def clamp_probability(p, eps: float = LOG_LOSS_EPSILON) -> Column:
    """Exact 0 becomes eps and exact 1 becomes 1 - eps; other values pass."""
    p = _c(p)
    return (F.when(p == F.lit(0.0), F.lit(eps))
            .when(p == F.lit(1.0), p - F.lit(eps))
            .otherwise(p))


def log_loss(p, y, eps: float = LOG_LOSS_EPSILON) -> Column:
    """Row log loss: -ln(p) for y = 1, -ln(1 - p) for y = 0 (after the clamp)."""
    pc = clamp_probability(p, eps)
    return F.when(_c(y) == F.lit(1.0), -F.ln(pc)).otherwise(-F.ln(F.lit(1.0) - pc))


def signed_label(y) -> Column:
    """0/1 label as -1/+1 (hinge loss)."""
    return F.lit(2.0) * _c(y) - F.lit(1.0)
