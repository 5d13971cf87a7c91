"""Schema, line parsing and scalar expressions against recorded golden values."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from sharecast import schema
from sharecast.functions import columns as C
from sharecast.operators import features as FT
from sharecast.operators import labels as L

# First data row of the article file as recorded in the notebook output.
GOLDEN_ROW = [
    "http://example.org/2013/01/07/first-article/", "731.0", "12.0",
    "219.0", "0.663594466988", "0.999999992308", "0.815384609112", "4.0", "2.0", "1.0",
    "0.0", "4.6803652968", "5.0", "0.0", "1.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0",
    "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "496.0", "496.0", "496.0", "1.0",
    "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.500331204081", "0.378278929586",
    "0.0400046751006", "0.0412626477296", "0.0401225435029", "0.521617145481",
    "0.0925619834711", "0.0456621004566", "0.013698630137", "0.769230769231",
    "0.230769230769", "0.378636363636", "0.1", "0.7", "-0.35", "-0.6", "-0.2", "0.5",
    "-0.1875", "0.0", "0.1875", "593",
]


def test_header_layout():
    cols = schema.ARTICLE_COLUMNS
    assert len(cols) == 61
    assert len(schema.predictor_names()) == 58
    assert cols[60] == "shares" and cols[0] == "url" and cols[1] == "timedelta"
    st = schema.article_schema()
    assert st["n_tokens_title"].dataType.simpleString() == "string"
    assert st["shares"].dataType.simpleString() == "double"


def test_header_split_on_whitespace_keeps_commas(spark):
    header = schema.header_line()
    names = spark.range(1).select(F.split(F.lit(header), r"\s+").alias("n")).first()["n"]
    assert len(names) == 61 and names[0] == "url," and names[-1] == "shares"


def test_parse_golden_line(spark):
    line = ", ".join(GOLDEN_ROW)
    pairs = spark.range(1).select(FT.parse_line(F.lit(line)).alias("p")).first()["p"]
    assert len(pairs) == 58
    assert [p["idx"] for p in pairs] == list(range(58))
    assert (pairs[0]["idx"], pairs[0]["value"]) == (0, "12.0")
    assert (pairs[50]["idx"], pairs[50]["value"]) == (50, "0.7")
    assert pairs[57]["value"] == "0.1875"


def test_golden_label_is_zero(spark):
    df = spark.createDataFrame([(593.0, 731.0), (50.0 * 731, 731.0), (50.0 * 731 + 1, 731.0)],
                               "shares double, timedelta double")
    got = [r["label"] for r in L.with_label(df).collect()]
    assert got == [0.0, 0.0, 1.0]      # 593/731 < 50; exactly 50 is not popular


def test_zero_age_raises_or_drops(spark):
    df = spark.createDataFrame([(10.0, 0.0), (10.0, 1.0)], "shares double, timedelta double")
    with pytest.raises(Exception):
        L.with_label(df).collect()
    assert L.with_label(df, on_zero="drop").count() == 1


def test_log_loss_clamp_and_entropy(spark):
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.25, 1.0)],
                               "p double, y double")
    got = [r[0] for r in df.select(C.log_loss("p", "y")).collect()]
    assert got[0] == pytest.approx(-math.log(1e-11))
    assert got[1] == pytest.approx(-math.log(1 - 1e-11))
    assert got[2] == pytest.approx(-math.log(1e-11), rel=1e-4)
    assert got[3] == pytest.approx(1e-11, rel=1e-3)
    assert got[4] == pytest.approx(-math.log(0.25))
    # constant predictor at the recorded training mean has log loss 0.253
    p = 0.0698767
    entropy = -(p * math.log(p) + (1 - p) * math.log(1 - p))
    assert round(entropy, 3) == 0.253


def test_sigmoid_extremes(spark):
    df = spark.createDataFrame([(0.0,), (-1000.0,), (1000.0,)], "m double")
    got = [r[0] for r in df.select(C.sigmoid("m")).collect()]
    assert got[0] == 0.5 and got[1] == 0.0 and got[2] == 1.0


def test_md5_bucket_matches_python(spark):
    keys = list(range(0, 2000, 37))
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["b"] for r in df.select("k", C.md5_bucket("k").alias("b")).collect()}
    for k in keys:
        want = int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 10
        assert got[k] == want


def test_rate_quantiles_close_to_exact(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    rates = rng.lognormal(2.0, 1.0, 20000)
    df = spark.createDataFrame([(float(r),) for r in rates], "rate double")
    got = L.rate_quantiles(df).first()
    for p, name in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75")):
        exact = float(np.quantile(rates, p))
        assert abs(got[name] - exact) / exact < 0.01
