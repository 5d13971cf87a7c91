"""Named queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the given tables (or tables Spark derives from them) in
full. Floating outputs that are sums (whose order differs between engines and
partitionings) are rounded — 6 digits, weights 9; values from a single
operation (rates, counts ratios, tpr/fpr, minima and maxima) are exact and
left unrounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate as E
from ..operators import explore as X
from ..operators import features as FT
from ..operators import labels as L
from ..operators import split as S
from ..schema import header_line, LINE_SEPARATOR
from ..session import ensure_checkpoint_dir
from ..sources import articles as A
from ..sources import files as FS
from ..sources import shares as SH
from ..sources.tables import table
from . import popularity as P

# Fixed values of the registered queries.
SHORT_ITERATIONS = 3         # the fits of the *_fit_3_steps keys
FULL_ITERATIONS = 50         # the analysed workload's fits, evaluated by all other keys
TOP_K = 5
SPLIT_TOLERANCE = 0.05
LOOKUP_KEY = (0, "1-URGENT")
SCATTER_X = (0.0, 40.0)
SCATTER_Y = (0.0, 300000.0)

_memo: dict = {}


def clear_cache(spark: SparkSession | None = None) -> None:
    """Forget memoised preparations and release their cached design tables; with
    ``spark``, also delete the tables staged by this application."""
    for v in _memo.values():
        if isinstance(v, P.Prepared):
            v.release()
    _memo.clear()
    if spark is not None:
        FS.release_staged(spark)


def _key(spark, name, sf, *parts):
    """Memo key: the application, the folder, and the state (names, sizes and times) of
    the files there, so changed data is never answered from an older preparation."""
    return (spark.sparkContext.applicationId, name, sf, FS.folder_state(spark, sf), *parts)


def _prep(spark: SparkSession, sf: str, with_date: bool = False) -> P.Prepared:
    k = _key(spark, "prep", sf, with_date)
    if k not in _memo:
        _memo[k] = P.prepare(spark, sf, with_date)
    return _memo[k]


def _fits(spark: SparkSession, sf: str, iterations: int = FULL_ITERATIONS):
    k = _key(spark, "fits", sf, iterations)
    if k not in _memo:
        _memo[k] = P.fit_both(_prep(spark, sf), iterations)
    return _memo[k]


def _eval(spark: SparkSession, sf: str) -> P.Evaluation:
    k = _key(spark, "eval", sf)
    if k not in _memo:
        _memo[k] = P.evaluate_models(_prep(spark, sf), _fits(spark, sf))
    return _memo[k]


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def r9(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 9)


def _labeled(spark, sf):
    return P.labeled_articles(spark, sf)


# --- split and label -------------------------------------------------------

def q_hash_split(spark, sf):
    return S.hash_split(A.articles(spark, sf)).select("article_id", "bucket", "split")


def q_random_split(spark, sf):
    """What must hold of a random split, whatever it draws: every id in one part, the
    names, and shares within ``SPLIT_TOLERANCE`` of the weights."""
    parts = S.random_split(A.articles(spark, sf).select("article_id"))
    near = [F.abs(F.avg((F.col("split") == F.lit(n)).cast("double")) - F.lit(w)) <= F.lit(SPLIT_TOLERANCE)
            for n, w in zip(S.SPLIT_NAMES, S.SPLIT_WEIGHTS, strict=True)]
    return parts.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("article_id").alias("n_articles"),
                     F.array_join(F.array_sort(F.collect_set("split")), ",").alias("names"),
                     *[c.alias(f"{n}_share_ok") for n, c in zip(S.SPLIT_NAMES, near, strict=True)])


def q_ordered_peek(spark, sf):
    """The first rows in a stated order (a report of ``TOP_K`` rows)."""
    return (_labeled(spark, sf).orderBy("article_id").limit(TOP_K)
            .select("article_id", "split", "label"))


def q_popularity_label(spark, sf):
    return _labeled(spark, sf).select("article_id", "split", "rate", "label")


def q_split_counts(spark, sf):
    return S.split_counts(_labeled(spark, sf))


def q_split_positive_counts(spark, sf):
    return (_labeled(spark, sf).groupBy("split")
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(F.col("label") == F.lit(1.0)).alias("n_positive")))


def q_positive_fraction(spark, sf):
    return L.positive_fraction(_labeled(spark, sf))


def q_label_mean(spark, sf):
    return L.label_mean(_labeled(spark, sf))


def q_shares_per_day_profile(spark, sf):
    prof = L.rate_profile(_labeled(spark, sf))
    summed = ("mean_rate", "stddev_rate", "skewness_rate", "fraction_above")
    return prof.select(*[r6(c).alias(c) if c in summed else F.col(c) for c in prof.columns])


# --- text lines, header, schema ---------------------------------------------

def _lines(spark, sf):
    arts = A.articles(spark, sf)
    return FS.as_lines(arts, A.article_columns())


def q_parse_line_features(spark, sf):
    lines = _lines(spark, sf)
    url = F.get(FT.split_line("value"), 0)
    return lines.select(url.alias("url"), F.inline(FT.parse_line("value")))


def q_drop_header(spark, sf):
    header = header_line(A.article_columns())
    head = spark.range(1).select(F.lit(header).alias("value"))
    return FT.drop_header(head.unionByName(_lines(spark, sf)), header)


def q_schema_columns(spark, sf):
    header = header_line(A.article_columns())
    raw = spark.range(1).select(F.posexplode(F.split(F.lit(header), r"\s+")).alias("pos", "raw_name"))
    n_cols = len(A.article_columns())
    role = (F.when(F.col("pos") == F.lit(0), F.lit("identifier"))
            .when(F.col("pos") == F.lit(1), F.lit("age"))
            .when(F.col("pos") == F.lit(n_cols - 1), F.lit("shares"))
            .otherwise(F.lit("predictor")))
    cols = raw.select(F.col("pos").cast("bigint").alias("position"), "raw_name",
                      F.regexp_replace("raw_name", ",$", "").alias("name"), role.alias("role"))
    # feature_index -1 and n_values 0 for the columns that are not predictors
    cols = cols.withColumn("feature_index",
                           F.when(F.col("role") == F.lit("predictor"),
                                  (F.col("position") - F.lit(2)).cast("int"))
                           .otherwise(F.lit(-1)))
    prep = _prep(spark, sf)
    per_idx = prep.dictionary.groupBy("idx").agg(F.count(F.lit(1)).alias("n_values"))
    out = cols.join(F.broadcast(per_idx), cols.feature_index == per_idx.idx, "left").drop("idx")
    return out.withColumn("n_values", F.coalesce("n_values", F.lit(0)).cast("bigint"))


def q_scan_text_lines(spark, sf):
    ensure_checkpoint_dir(spark)
    cols = A.article_columns()
    path = FS.write_article_files(A.articles(spark, sf), cols, "lines")
    header = FS.first_line(spark, path)
    return FT.drop_header(FS.scan_text_lines(spark, path), header)


def q_scan_csv(spark, sf):
    ensure_checkpoint_dir(spark)
    cols = A.article_columns()
    path = FS.write_article_files(A.articles(spark, sf), cols, "csv")
    return FS.scan_csv(spark, path, infer=True)


def q_sink_parquet_roundtrip(spark, sf):
    ensure_checkpoint_dir(spark)
    lab = _labeled(spark, sf).select("article_id", "label", "rate", "split")
    return FS.parquet_roundtrip(lab, "labeled", ["split"]).select(
        "article_id", "split", "label", "rate")


def _ordered_file(spark, sf, name):
    """The articles as files in the order of their ids, a header on top of each."""
    ensure_checkpoint_dir(spark)
    arts = A.articles(spark, sf).orderBy("article_id")
    return FS.write_article_files(arts, A.article_columns(), name)


def q_input_order(spark, sf):
    """The number of every article line in its files, and the url there."""
    path = _ordered_file(spark, sf, "input-order")
    lines = FS.numbered_lines(spark, path, skip=FS.first_line(spark, path))
    return lines.select("line_no", F.get(FT.split_line("value"), 0).alias("url"))


def _damaged_lines(spark, sf):
    """Article lines of which some lack their last field or have no number as age or shares."""
    ensure_checkpoint_dir(spark)
    cols = A.article_columns()
    arts = A.articles(spark, sf)
    age = F.when(F.col("article_id") % 7 == 0, "n/a").otherwise(F.col("timedelta").cast("string"))
    shares = F.when(F.col("article_id") % 11 == 0, "many").otherwise(F.col("shares").cast("string"))
    lines = FS.as_lines(arts.withColumns({"timedelta": age, "shares": shares}), cols)
    lines = lines.select(F.when(F.col("value").rlike("^article/[0-9]*9,"), F.regexp_extract("value", "^(.*), ", 1)).otherwise(F.col("value")))
    return FS.write_lines(lines, "damaged", header_line(cols))


def q_rejected_lines(spark, sf):
    """Lines per reason, the good ones (with the sum of their ages) among them."""
    good, bad = A.checked_articles(spark, _damaged_lines(spark, sf))
    counts = bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n_lines"), F.lit(None).cast("double").alias("sum_age"))
    return counts.unionByName(good.agg(F.lit("good").alias("reason"), F.count(F.lit(1)).alias("n_lines"),
                                       F.sum("timedelta").alias("sum_age")))


def q_rejected_replies(spark, sf):
    """Replies of which some are cut off or lack the count: the reason, or the count read."""
    r = SH.share_replies(spark, sf)
    cut = F.when(F.col("event_id") % 5 == 0, F.substring("reply", 1, 4)).when(F.col("event_id") % 7 == 0, F.lit('{"other": 1}'))
    good, bad = SH.checked_counts(r.withColumn("reply", F.coalesce(cut, F.col("reply"))))
    return good.select("event_id", "share_count", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("event_id", F.lit(None).cast("long").alias("share_count"), "reason"))


# --- features and dictionary -------------------------------------------------

def q_feature_long(spark, sf):
    return FT.feature_long(_labeled(spark, sf), A.predictors(), ["article_id", "split"])


def q_distinct_features(spark, sf):
    return FT.distinct_features(_prep(spark, sf).long_train())


def q_dictionary_size(spark, sf):
    """Values per predictor index plus the total (idx -1)."""
    d = _prep(spark, sf).dictionary
    out = d.rollup("idx").agg(F.count(F.lit(1)).alias("n_values"))
    return out.select(F.coalesce("idx", F.lit(-1)).alias("idx"), "n_values")


def q_feature_dictionary(spark, sf):
    return _prep(spark, sf).dictionary.select("idx", "value", "feature_id")


def q_dictionary_lookup(spark, sf):
    idx, value = LOOKUP_KEY
    d = _prep(spark, sf).dictionary
    return d.filter((F.col("idx") == F.lit(idx)) & (F.col("value") == F.lit(value))).select(
        "idx", "value", "feature_id")


def _encoded_arrays(spark, sf, keep):
    prep = _prep(spark, sf, with_date=True)
    size = prep.dictionary.count()
    arr = FT.encode_arrays(prep.long, prep.dictionary, keep)
    vector = FT.sparse_vector_parts("feature_ids", F.lit(size))
    return arr.select(*keep, "n_active", vector.alias("v")).select(
        *keep, "n_active", F.array_join("v.indices", ",").alias("feature_ids"),
        F.array_join("v.values", ",").alias("values"), F.col("v.size").alias("size"))


def q_one_hot_encode(spark, sf):
    return _encoded_arrays(spark, sf, ["article_id", "split"])


def q_feature_vectors(spark, sf):
    """The vector column of the articles, read back: size, indices and values."""
    prep = _prep(spark, sf, with_date=True)
    v = FT.feature_vectors(prep.long, prep.dictionary, ["article_id", "split"])
    json = F.from_json(F.call_function("to_json", F.struct(F.col("features"))), "features struct<size:bigint, indices:array<bigint>, values:array<double>>")
    return v.select("article_id", "split", json["features"].alias("f")).select(
        "article_id", "split", F.col("f.size").alias("size"), F.array_join("f.indices", ",").alias("feature_ids"),
        F.array_join("f.values", ",").alias("values"))


def q_dictionary_sketches(spark, sf):
    """Per predictor: distinct values, and whether the merged sketches of the three splits
    estimate them within four standard errors (1.04 / 64 each)."""
    prep = _prep(spark, sf, with_date=True)
    stored = FS.pin_table(FT.dictionary_sketches(prep.long, ["split"]), "sketches")
    est = FT.merged_sketches(stored, [])
    exact = prep.long.groupBy("idx").agg(F.count_distinct("value").alias("n_values"))
    near = F.abs(F.col("estimate") - F.col("n_values")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 64 * F.col("n_values"))
    return est.join(F.broadcast(exact), "idx").select("idx", "n_rows", "n_values", near.alias("within_error"))


def q_labeled_points(spark, sf):
    return _encoded_arrays(spark, sf, ["article_id", "split", "label"]).drop("size", "values")


# --- training ------------------------------------------------------------------

def _weights(model) -> DataFrame:
    return model.weights.select("feature_id", r9("weight").alias("weight"))


def _one_step(spark, sf, loss):
    from ..operators import models as M
    prep = _prep(spark, sf)
    new = M.gradient_step(prep.design_train(), prep.dictionary, prep.n_train, M.GDConfig(loss=loss))
    return new.select(
        "feature_id", r9(F.col("grad_sum") / F.lit(float(prep.n_train))).alias("mean_gradient"),
        r9("weight").alias("weight"))


def q_lr_gradient_step(spark, sf):
    return _one_step(spark, sf, "logistic")


def q_svm_gradient_step(spark, sf):
    return _one_step(spark, sf, "hinge")


def q_lr_fit_cells(spark, sf):
    """The short fit with the design cut into cells, as above the bound of weights."""
    prep = _prep(spark, sf)
    return _weights(P.fit_model(prep, "logistic", SHORT_ITERATIONS, "lr_cells", broadcast_rows=2))


def q_lr_fit_3_steps(spark, sf):
    return _weights(_fits(spark, sf, SHORT_ITERATIONS)[0])


def q_svm_fit_3_steps(spark, sf):
    return _weights(_fits(spark, sf, SHORT_ITERATIONS)[1])


def _named_weights(model) -> DataFrame:
    return model.weights.select(F.lit(model.name).alias("model"), "feature_id", r9("weight").alias("weight"))


def _one_fit(spark, sf, loss):
    """The 50-step model of one loss; fitted alone unless both are there already."""
    both = _memo.get(_key(spark, "fits", sf, FULL_ITERATIONS))
    if both is not None:
        return both[0 if loss == "logistic" else 1]
    k = _key(spark, "fit", sf, loss)
    if k not in _memo:
        _memo[k] = P.fit_model(_prep(spark, sf), loss, FULL_ITERATIONS)
    return _memo[k]


def q_lr_fit(spark, sf):
    return _named_weights(_one_fit(spark, sf, "logistic"))


def q_svm_fit(spark, sf):
    return _named_weights(_one_fit(spark, sf, "hinge"))


# --- scoring -------------------------------------------------------------------

def _scores(spark, sf):
    return _eval(spark, sf).scores


def q_sigmoid(spark, sf):
    s = _scores(spark, sf).filter(F.col("model") == F.lit("lr"))
    return s.select("article_id", "split", r6("margin").alias("margin"),
                    r6(C.sigmoid("margin")).alias("probability"))


def q_predict_proba(spark, sf):
    s = _scores(spark, sf).filter(F.col("model") == F.lit("lr"))
    return s.select("split", "article_id", "label", r6("score").alias("score"))


def q_svm_scores(spark, sf):
    s = _scores(spark, sf).filter(F.col("model") == F.lit("svm"))
    return s.select("split", "article_id", "label", r6("margin").alias("margin"),
                    r6("score").alias("score"))


def q_score_label_pairs(spark, sf):
    return _scores(spark, sf).select("model", "split", "article_id", "label",
                                     r6("score").alias("score"))


def q_log_loss_rows(spark, sf):
    s = _scores(spark, sf).filter(F.col("model") == F.lit("lr"))
    return s.select("article_id", "split", "label", r6("score").alias("score"),
                    r6(C.log_loss("score", "label")).alias("loss"))


def q_smallest_weights(spark, sf):
    w = P.model_weights(_fits(spark, sf))
    out = E.smallest_weights(w, TOP_K)
    return out.select("model", "pos", "feature_id", r9("weight").alias("weight"),
                      r9("intercept").alias("intercept"))


def q_top5_positive_scores(spark, sf):
    out = E.top_positive_scores(_scores(spark, sf), k=TOP_K)
    return out.select("model", "split", "pos", "article_id", r6("score").alias("score"))


# --- evaluation ----------------------------------------------------------------

def q_baseline_log_loss(spark, sf):
    b = E.baseline_log_loss(_prep(spark, sf).labeled)
    return b.select("split", r6("baseline_log_loss").alias("baseline_log_loss"))


def q_log_loss_eval(spark, sf):
    return _eval(spark, sf).log_loss.select("model", "split", "n_rows",
                                            r6("log_loss").alias("log_loss"))


def q_roc_points(spark, sf):
    ev = _eval(spark, sf)
    roc = E.roc_points(ev.held_out, ranked=ev.held_out_ranked)
    return roc.select("model", "split", "rn", "article_id", "label", "tpr", "fpr")


def q_roc_steps(spark, sf):
    ev = _eval(spark, sf)
    steps = E.roc_steps(ev.held_out, ranked=ev.held_out_ranked)
    return steps.select("model", "split", "rn", r9("dx").alias("dx"), r9("y").alias("y"), r9("area").alias("area"))


def q_auc(spark, sf):
    return _eval(spark, sf).auc.select("model", "split", r6("auc").alias("auc"))


def q_model_split_metrics(spark, sf):
    ev = _eval(spark, sf)
    out = (ev.log_loss.join(ev.auc, ["model", "split"])
           .join(ev.baseline, "split"))
    return out.select("model", "split", "n_rows", r6("log_loss").alias("log_loss"),
                      r6("baseline_log_loss").alias("baseline_log_loss"), r6("auc").alias("auc"))


def q_model_selection(spark, sf):
    ev = _eval(spark, sf)
    out = E.model_selection(ev.auc, ev.log_loss)
    return out.select("model", r6("selection_auc").alias("selection_auc"),
                      r6("final_auc").alias("final_auc"),
                      r6("final_log_loss").alias("final_log_loss"))


def q_metrics_report(spark, sf):
    ev = _eval(spark, sf)
    out = E.metrics_long(ev.log_loss, ev.auc, ev.baseline)
    return out.select("model", "split", "metric", r6("value").alias("value"), "text")


# --- exploration -----------------------------------------------------------------

def _orders_by_shares(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(
        F.col("o_orderkey").alias("article_id"), F.col("o_totalprice").alias("shares"))


def q_sorted_by_shares_rank(spark, sf):
    return X.ranked_by(_orders_by_shares(spark, sf), "shares", "article_id").select(
        "position", "article_id", "shares")


def q_sorted_feature_columns(spark, sf):
    arts = A.articles(spark, sf).select("article_id", "shares", "f0", "f4")
    return X.ranked_by(arts, "shares", "article_id").select(
        "position", "article_id", F.col("f0").alias("priority"), F.col("f4").alias("n_lines"))


def q_scatter_points(spark, sf):
    li = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
               "l_extendedprice")
    pts = X.scatter_points(li, "l_quantity", "l_extendedprice", SCATTER_X, SCATTER_Y)
    return pts.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"),
                      F.col("l_extendedprice").alias("y"))


def q_ols_slope_intercept(spark, sf):
    li = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    out = X.least_squares(li, "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 4).alias("slope"),
                      F.round("intercept", 4).alias("intercept"), "n_points")


def q_ols_ml_fit(spark, sf):
    """pyspark.ml fit; rounded like ``ols_slope_intercept`` (the two solvers
    agree to ~1e-9 relative)."""
    li = table(spark, sf, "lineitem", "l_quantity", "l_extendedprice")
    out = X.least_squares_ml(li, "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


def _reply_counts(spark, sf, networks=None):
    return X.reply_counts(SH.share_replies(spark, sf, networks), SH.ARRAY_NETWORK, SH.COUNT_FIELD)


def q_json_share_counts(spark, sf):
    return _reply_counts(spark, sf)


def q_share_counts_paired(spark, sf):
    tot = X.network_totals(_reply_counts(spark, sf, SH.NETWORKS))
    return X.paired_networks(tot, *SH.NETWORKS)


def q_share_counts_union(spark, sf):
    tot = X.network_totals(_reply_counts(spark, sf, SH.NETWORKS))
    return X.stacked_networks(tot, *SH.NETWORKS)


def q_shares_by_article_network(spark, sf):
    return X.pivot_networks(_reply_counts(spark, sf, SH.NETWORKS), SH.NETWORKS)


def q_network_by_source(spark, sf):
    out = X.network_by_source(X.network_totals(_reply_counts(spark, sf)))
    return out.select("source", "network", "total_shares", r6("mean_shares").alias("mean_shares"),
                      "n_articles", "top_article")


def q_page_script_meta(spark, sf):
    return X.page_records(table(spark, sf, "pages", "page_id", "html"))


def q_page_meta_map(spark, sf):
    return X.record_fields(SH.metadata_records(spark, sf), [SH.COUNT_FIELD])


def _customer_records(spark, sf):
    """Records with a nested list and object, as a page would write them (bare names)."""
    c = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal")
    n = table(spark, sf, "nation", "n_nationkey", "n_name")
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.select("c_custkey", F.concat(F.lit("{name: "), "c_name", F.lit(", topics: ["), "c_mktsegment", F.lit(", 'of "), "n_name",
                                          F.lit("'], place: {nation: "), "n_name", F.lit(", key: "), F.col("c_nationkey").cast("string"),
                                          F.lit(', "in debt": '), (F.col("c_acctbal") < 0).cast("string"), F.lit("}}")).alias("record"))


def q_nested_records(spark, sf):
    paths = {"first_topic": ("$.topics[0]", "string"), "second_topic": ("$.topics[1]", "string"), "nation": ("$.place.nation", "string"),
             "nation_key": ("$.place.key", "bigint"), "in_debt": ("$.place['in debt']", "boolean"), "missing": ("$.place.city", "string")}
    return X.nested_fields(_customer_records(spark, sf), paths, keep=["c_custkey"])


def q_record_schema(spark, sf):
    return X.record_schema(_customer_records(spark, sf))


def q_article_age_days(spark, sf):
    orders = table(spark, sf, "orders", "o_orderkey", "o_orderdate")
    return X.article_age(orders, A.AS_OF_DATE)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

# Keys checked only by row count: none.
ROWS_ONLY: set[str] = set()
