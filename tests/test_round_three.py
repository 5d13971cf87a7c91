"""Input order, rejected input, curve steps, nested records, vectors, sketches, Bloom filters."""

import random

import pytest
from pyspark.sql import functions as F

from sharecast import schema
from sharecast.functions import text as TX
from sharecast.operators import evaluate as E
from sharecast.operators import explore as X
from sharecast.operators import features as FT
from sharecast.operators import joins as J
from sharecast.plans import popularity as P
from sharecast.session import staging_path
from sharecast.sources import articles as A
from sharecast.sources import files as FS
from sharecast.sources import shares as SH


def write_files(spark, files):
    path = staging_path(spark, "given")
    for name, lines in files.items():
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{name}")
    return path + "/*"


# input order -------------------------------------------------------------------

@pytest.mark.parametrize("split", ["200b", "1k", "128m"])
def test_line_numbers_do_not_depend_on_splits(spark, split):
    files = {"a": ["head"] + [f"a{i}" for i in range(300)], "b": ["head"] + [f"b{i % 7}" for i in range(200)] + ["head", ""], "c": ["head"]}
    path = write_files(spark, files)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "50b")
    try:
        got = FS.numbered_lines(spark, path, skip="head").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [x for f in "abc" for x in files[f] if x != "head"]
    assert [r.value for r in sorted(got, key=lambda r: r.line_no)] == want
    assert sorted(r.line_no for r in got) == list(range(len(want)))


def article_lines(n, distinct, seed=3):
    """n lines; with ``distinct`` every repeated one has its own url."""
    rnd, out = random.Random(seed), []
    for i in range(n):
        preds = [rnd.choice(["0.0", "1.0"]) for _ in range(58)]
        rest = [str(float(rnd.randint(1, 700))), *preds, str(rnd.randint(1, 60_000))]
        out.append([f"http://example.org/{i}", *rest])
    again = [[f"{x[0]}{'/again' if distinct else ''}", *x[1:]] for x in out]
    return [", ".join(x) for x in out + again]


def test_repeated_lines_train_as_lines_of_their_own(spark):
    weights = []
    for distinct in (False, True):
        path = write_files(spark, {"a": [schema.header_line(), *article_lines(40, distinct)]})
        arts = A.articles_from_file(spark, path)
        assert arts.count() == arts.select("article_id").distinct().count() == 80
        # the split by url differs between the files: train on all lines
        labeled = P.with_label(arts).withColumn("split", F.lit("train"))
        prep = P.prepare_table(labeled, schema.predictor_names())
        design = prep.design_train().collect()
        assert prep.n_train == len(design) == 80 and {len(r.slots) for r in design} == {59}
        fitted = P.fit_both(prep, 4)
        weights.append([{r.feature_id: r.weight for r in m.weights.collect()} for m in fitted])
        cells = P.fit_model(prep, "logistic", 4, "cells", broadcast_rows=2)
        assert {r.feature_id: r.weight for r in cells.weights.collect()} == weights[-1][0]
        ev = P.evaluate_models(prep, fitted)
        assert {r.n_rows for r in ev.log_loss.collect()} == {80}
        assert FT.encode_arrays(prep.long, prep.dictionary, ["article_id"]).agg(F.max("n_active"), F.count("*")).first() == (58, 80)
    assert weights[0] == weights[1]


# rejected input ------------------------------------------------------------------

def test_good_and_rejected_lines_are_the_input(spark):
    good = article_lines(20, False)
    few, age, shares = ", ".join(good[0].split(", ")[:-2]), good[1].split(", "), good[2].split(", ")
    age[1], shares[-1] = "old", "1 000"
    bad = [few, ", ".join(age), ", ".join(shares), "", "x" * 100_000, good[3] + ", more"]
    path = write_files(spark, {"a": [schema.header_line(), *good[:20], *bad, *good[20:]]})
    ok, no = A.checked_articles(spark, path)
    rows = {r.article_id: (r.value, r.reason) for r in no.collect()}
    assert rows == {20: (few, "field count"), 21: (bad[1], "age"), 22: (bad[2], "shares"), 23: ("", "field count"),
                    24: (bad[4], "field count"), 25: (bad[5], "field count")}
    ids = [r.article_id for r in ok.collect()]
    assert sorted(ids + list(rows)) == list(range(46)) and ok.schema == A.articles_from_file(spark, path).schema


def test_good_and_rejected_replies_are_the_input(spark):
    replies = ['{"k": 3}', '[{"k": 4, "x": 1}]', '{"k": 5', "<html>", "", None, '{"x": 1}', "[]", '{"k": "many"}', '{"k": null}', " [ {\"k\": 6} ] "]
    df = spark.createDataFrame(list(enumerate(replies)), "event_id long, reply string")
    ok, no = SH.checked_counts(df)
    assert {r.event_id: r.share_count for r in ok.collect()} == {0: 3, 1: 4, 10: 6}
    assert {r.event_id: (r.reply, r.reason) for r in no.collect()} == {
        i: (replies[i], "no count" if i in (6, 9) else "no json") for i in range(11) if i not in (0, 1, 10)}


# curve steps -----------------------------------------------------------------------

def test_steps_add_up_to_the_area_without_a_single_task(spark):
    rnd = random.Random(6)
    rows = [(m, s, i, float(rnd.random() < 0.3), round(rnd.random(), 1)) for m in "ab" for s in ("val", "test") for i in range(300)]
    rows += [("one", "val", 1, 1.0, 0.5), ("flat", "val", 1, 0.0, 0.5), ("flat", "val", 2, 0.0, 0.4)]
    scores = spark.createDataFrame(rows, "model string, split string, article_id long, label double, score double").repartition(9)
    steps = E.roc_steps(scores)
    got = steps.collect()
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    area = {}
    for r in got:
        if r.area is not None:
            area[r.model, r.split] = area.get((r.model, r.split), 0.0) + r.area
    want = {(r.model, r.split): r.auc for r in E.auc(scores).collect() if r.auc is not None}
    assert area.keys() == want.keys() and all(abs(area[k] - want[k]) < 1e-12 for k in want)
    assert len([r for r in got if r.model in "ab"]) == 4 * 299 and not [r for r in got if r.model == "one"]
    points = {(r.model, r.split, r.rn): r for r in E.roc_points(scores).collect()}
    for r in got:
        a, b = points[r.model, r.split, r.rn], points[r.model, r.split, r.rn + 1]
        assert r.dx is None or (abs(r.dx - (b.fpr - a.fpr)) < 1e-12)
        assert r.y is None or abs(r.y - (a.tpr + b.tpr) / 2) < 1e-12


# nested records -----------------------------------------------------------------------

def test_records_with_nested_values(spark):
    records = ["{topics: [a, b]}", '{"topics": ["a, b", {"deep": [1, 2]}], "n": 1.5}', "{'topics': ['it', \"x: 'y'\"], ok: true, none: null}",
               "{url: http, topics: [new york, -3e2]}", "topics: a", "", None, "{topics: [a", "[a, b]", '"text"', "7"]
    df = spark.createDataFrame(list(enumerate(records)), "id long, record string")
    got = {r.id: r for r in X.nested_fields(df, {"first": ("$.topics[0]", "string"), "second": ("$.topics[1]", "string"),
                                                 "deep": ("$.topics[1].deep[1]", "int"), "ok": ("$.ok", "boolean")}, keep=["id"]).collect()}
    assert [got[i].is_nested for i in range(11)] == [True, True, True, True, False, False, False, False, True, False, False]
    assert (got[0].first, got[0].second) == ("a", "b") and (got[1].first, got[1].deep) == ("a, b", 2)
    assert (got[2].first, got[2].second, got[2].ok) == ("it", "x: 'y'", True)
    assert (got[3].first, got[3].second) == ("new york", "-300.0")
    assert got[4].first is None and got[8].first is None
    shape = X.record_schema(df.filter("id in (0, 2)")).first().schema
    assert "topics: ARRAY<STRING>" in shape and "ok: BOOLEAN" in shape


def test_indent_is_found_once_per_record(spark):
    lines = "\n".join(f"    name{i}: {i}" for i in range(3000))
    df = spark.createDataFrame([(lines,), ("  a\n    b\n\n  c",), ("",)], "t string")
    got = [r[0] for r in df.select(TX.strip_indent("t")).collect()]
    assert got == [lines.replace("    name", "name"), "a\n  b\n\nc", ""]


# vectors and sketches --------------------------------------------------------------------

def small_articles(spark, n=400):
    rnd = random.Random(12)
    rows = [(i, "train" if i % 4 else "val", float(rnd.random() < 0.4), rnd.choice("abc"), None if i % 9 == 0 else f"v{i % 50}") for i in range(n)]
    df = spark.createDataFrame(rows, "article_id long, split string, label double, p0 string, p1 string")
    long = FT.feature_long(df, ["p0", "p1"], ["article_id", "split", "label"])
    return df, long, FT.fit_dictionary(long.filter("split = 'train'"))


def test_vector_column_feeds_an_estimator(spark):
    from pyspark.ml.classification import LogisticRegression

    df, long, d = small_articles(spark)
    vectors = FT.feature_vectors(long, d, ["article_id", "split", "label"])
    model = LogisticRegression(maxIter=3).fit(vectors)
    assert model.numFeatures == d.count() and vectors.count() == 400
    ids = {r.article_id: r.feature_ids for r in FT.encode_arrays(long, d, ["article_id"]).collect()}
    for r in vectors.collect():
        assert r.features.size == d.count() and r.features.indices.tolist() == ids[r.article_id]
        assert set(r.features.values.tolist()) <= {1.0}
    with pytest.raises(ValueError):
        FT.vector_model(d, max_names=3)


def test_stored_sketches_merge_to_the_sketch_of_all(spark):
    _, long, _ = small_articles(spark)
    parts = FS.pin_table(FT.dictionary_sketches(long, ["split"]), "sketch-test")
    merged = {r.idx: (r.estimate, r.n_rows) for r in FT.merged_sketches(parts, []).collect()}
    once = {r.idx: (r.estimate, r.n_rows) for r in FT.merged_sketches(FT.dictionary_sketches(long, []), []).collect()}
    exact = {r.idx: r.n for r in long.groupBy("idx").agg(F.count_distinct("value").alias("n")).collect()}
    assert merged == once and all(abs(merged[i][0] - exact[i]) <= 1 for i in exact)


# Bloom filter --------------------------------------------------------------------------

def test_rows_without_a_partner_do_not_reach_the_exchange(spark):
    dim = spark.range(20_000).select((F.col("id") * 7).alias("k"), F.col("id").alias("v"))
    fact = spark.range(100_000).select(F.when(F.col("id") % 100 != 0, F.col("id")).alias("k"), F.col("id").alias("x"))
    passed = J.bloom_prefilter(fact, dim, ["k"])
    assert passed.columns == fact.columns
    n, hits = passed.count(), fact.join(dim, "k").count()
    assert hits <= n < hits + 0.05 * 100_000 and passed.join(dim, "k").count() == hits
    joined = J.lookup_join(fact, dim, ["k"], broadcast_rows=1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "_bits" in plan and joined.count() == hits
    assert J.bloom_prefilter(fact, dim, ["k"], max_words=8) is fact
    left = J.lookup_join(fact, dim, ["k"], broadcast_rows=1, how="left")
    assert left.count() == 100_000 and left.filter("v is not null").count() == hits
    assert J.bloom_prefilter(fact, dim.limit(0), ["k"]).count() == 0
