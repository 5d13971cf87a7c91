"""Features, dictionary, encoding; distributed ranks; skew-safe lookup join."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from sharecast.operators import features as FT
from sharecast.operators import joins as J
from sharecast.operators import ranks as R


def _articles(spark):
    rows = [
        (1, "train", 0.0, "a", "x"),
        (2, "train", 1.0, "a", "y"),
        (3, "train", 0.0, "b", "x"),
        (4, "val", 0.0, "a", "z"),     # 'z' unseen in training
        (5, "test", 1.0, "c", "w"),    # both values unseen: empty feature list
    ]
    return spark.createDataFrame(rows, "article_id long, split string, label double, p0 string, p1 string")


def test_dictionary_from_train_only(spark):
    df = _articles(spark)
    long = FT.feature_long(df, ["p0", "p1"], ["article_id", "split", "label"])
    d = FT.fit_dictionary(long.filter("split = 'train'"))
    got = [(r.idx, r.value, r.feature_id, r.n_rows) for r in d.orderBy("feature_id").collect()]
    assert got == [(0, "a", 0, 2), (0, "b", 1, 1), (1, "x", 2, 2), (1, "y", 3, 1)]


def test_encode_drops_unseen_keeps_empty(spark):
    df = _articles(spark)
    long = FT.feature_long(df, ["p0", "p1"], ["article_id", "split", "label"])
    d = FT.fit_dictionary(long.filter("split = 'train'"))
    arr = {r.article_id: (list(r.feature_ids), r.n_active)
           for r in FT.encode_arrays(long, d, ["article_id"]).collect()}
    assert arr[1] == ([0, 2], 2)
    assert arr[2] == ([0, 3], 2)
    assert arr[4] == ([0], 1)
    assert arr[5] == ([], 0)
    # train rows keep every predictor
    assert all(arr[i][1] == 2 for i in (1, 2, 3))


def test_same_text_in_two_columns_is_two_features(spark):
    df = spark.createDataFrame([(1, "train", 0.0, "0.0", "0.0")],
                               "article_id long, split string, label double, p0 string, p1 string")
    long = FT.feature_long(df, ["p0", "p1"], ["article_id", "split", "label"])
    assert FT.fit_dictionary(long).count() == 2


def test_drop_header_removes_every_copy(spark):
    lines = spark.createDataFrame([("h",), ("a",), ("h",), ("b",)], "value string")
    assert sorted(r.value for r in FT.drop_header(lines, "h").collect()) == ["a", "b"]


def test_global_rank_matches_window(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice(["g1", "g2", "g3"]), float(rnd.randint(0, 20)), float(rnd.randint(0, 1)))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, g string, score double, label double").repartition(7)
    order = [F.col("score").desc(), F.col("id").asc()]
    frozen = R.freeze_order(df, ["g"], order)
    got = R.rank_and_accumulate(frozen, ["g"], sums=["label"]).select("id", "rn", "cum_label")
    w = Window.partitionBy("g").orderBy(*order)
    want = df.select("id", F.row_number().over(w).cast("bigint").alias("rn"),
                     F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_label"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_global_rank_without_groups(spark):
    df = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5000).alias("v"))
    got = R.global_rank(df, [F.col("v").asc()], start=0).select("v", "rn").collect()
    assert all(r.v == r.rn for r in got)


def test_lookup_join_salted_path_equals_plain_join(spark):
    rnd = random.Random(3)
    # key 0 holds about a third of all fact rows
    fact = spark.createDataFrame([(i, 0 if rnd.random() < 0.35 else rnd.randint(1, 300)) for i in range(6000)],
                                 "article_id long, k long")
    dim = spark.createDataFrame([(k, k * 10, 1) for k in range(0, 290)], "k long, v long, n long")
    counts = fact.groupBy("k").agg(F.count(F.lit(1)).alias("cnt"))
    dim = dim.join(counts, "k", "left").select("k", "v", F.coalesce("cnt", F.lit(0)).alias("cnt"))
    for how in ("inner", "left"):
        salted = J.lookup_join(fact, dim, ["k"], how=how, broadcast_rows=0,
                               max_hot_keys=5, salts=4, salt_source="article_id")
        plain = fact.join(dim.select("k", "v"), "k", how)
        a = sorted(map(tuple, salted.select("article_id", "k", "v").collect()), key=str)
        b = sorted(map(tuple, plain.select("article_id", "k", "v").collect()), key=str)
        assert a == b


def test_bounded_broadcast_checks_size(spark):
    small = spark.range(10)
    big = spark.range(100)
    assert "broadcast" in str(J.bounded_broadcast(small, 50)._jdf.queryExecution().analyzed()).lower() \
        or J.bounded_broadcast(small, 50) is not small
    assert J.bounded_broadcast(big, 50) is big


def test_random_split_disjoint_complete_and_weighted(spark):
    from sharecast.operators.split import random_split
    df = spark.range(0, 20000, 1, 6).withColumnRenamed("id", "article_id")
    out = random_split(df)
    assert out.count() == 20000
    assert out.select("article_id").distinct().count() == 20000
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert abs(counts["train"] / 20000 - 0.8) < 0.02
    assert abs(counts["val"] / 20000 - 0.1) < 0.02
    again = {r.article_id: r.split for r in random_split(df).collect()}
    assert again == {r.article_id: r.split for r in out.collect()}


def test_dictionary_size_estimate_close_to_exact(spark):
    df = spark.range(0, 30000, 1, 4).select(
        F.col("id").alias("article_id"), F.lit("train").alias("split"), F.lit(0.0).alias("label"),
        (F.col("id") % 5000).cast("string").alias("p0"), (F.col("id") % 7).cast("string").alias("p1"))
    long = FT.feature_long(df, ["p0", "p1"], ["article_id", "split", "label"])
    est = {r.idx: r.approx_values for r in FT.dictionary_size_estimate(long).collect()}
    assert abs(est[0] - 5000) / 5000 < 0.05 and est[1] == 7
