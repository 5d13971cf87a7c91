"""DuckDB SQL for each query key (the correctness oracle).

Written independently of the Spark code: plain CTEs over the registered
views, window functions where the Spark side uses distributed ranks, and the
gradient steps unrolled one (materialized) CTE group per iteration. The unrolled
steps are all run; on the given data the stopping rule does not stop earlier (tested).
"""

from __future__ import annotations

import math

from ..schema import header_line
from ..sources import articles as A
from . import queries as Q

AS_OF = A.AS_OF_DATE

# Weights are added exactly, as whole numbers of 2^-26 and 2^-52.
_U = "67108864.0::DOUBLE"
MARGIN = (f"(sum(floor(w.weight * {_U})) + sum(floor((w.weight * {_U} - floor(w.weight * {_U})) * {_U})) / {_U}) / {_U}")


def _articles(with_date: bool) -> str:
    date_col = ",\n         strftime(o.o_orderdate, '%Y-%m-%d') AS f7" if with_date else ""
    return f"""articles AS (
  SELECT o.o_orderkey AS article_id,
         'article/' || CAST(o.o_orderkey AS VARCHAR) AS url,
         CAST(date_diff('day', CAST(o.o_orderdate AS DATE), DATE '{AS_OF}') AS DOUBLE) AS timedelta,
         o.o_totalprice / CAST(20 AS DOUBLE) AS shares,
         o.o_orderpriority AS f0, c.c_mktsegment AS f1, n.n_name AS f2, o.o_orderstatus AS f3,
         CAST(COALESCE(l.n_lines, 0) AS VARCHAR) AS f4,
         CAST(month(o.o_orderdate) AS VARCHAR) AS f5,
         CAST(year(o.o_orderdate) AS VARCHAR) AS f6{date_col}
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) l
    ON o.o_orderkey = l.l_orderkey
)"""


LABELED = """bucketed AS (
  SELECT *, ('0x' || substr(md5(CAST(article_id AS VARCHAR)), 1, 8))::BIGINT % 10 AS bucket
  FROM articles
),
labeled AS (
  SELECT *,
         CASE WHEN bucket < 8 THEN 'train' WHEN bucket < 9 THEN 'val' ELSE 'test' END AS split,
         shares / timedelta AS rate,
         CAST(CASE WHEN shares / timedelta > 50 THEN 1 ELSE 0 END AS DOUBLE) AS label
  FROM bucketed
)"""


def _long(with_date: bool) -> str:
    names = A.predictors(with_date)
    parts = [f"SELECT article_id, split, label, {i} AS idx, {c} AS value FROM labeled"
             for i, c in enumerate(names)]
    return "long AS MATERIALIZED (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


DICT = """dict AS MATERIALIZED (
  SELECT idx, value, count(*) AS n_rows,
         row_number() OVER (ORDER BY idx, value) - 1 AS feature_id
  FROM long WHERE split = 'train' GROUP BY idx, value
)"""

DESIGN = """design_all AS (
  SELECT l.article_id, l.split, l.label, d.feature_id
  FROM long l JOIN dict d ON l.idx = d.idx AND l.value = d.value
  UNION ALL
  SELECT article_id, split, label, -1 AS feature_id FROM labeled
),
design_train AS MATERIALIZED (SELECT * FROM design_all WHERE split = 'train'),
ntrain AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM labeled WHERE split = 'train')"""


def _dbl(x: float) -> str:
    return f"CAST('{x!r}' AS DOUBLE)"


def _residual(loss: str) -> str:
    if loss == "logistic":
        return "1.0 / (1.0 + exp(-m.margin)) - m.label"
    return ("CASE WHEN 1.0 > (2.0 * m.label - 1.0) * m.margin "
            "THEN -(2.0 * m.label - 1.0) ELSE 0.0 END")


def _gd(prefix: str, loss: str, k: int, step: float = 1.0, reg: float = 1e-6) -> str:
    ctes = [f"""{prefix}_w0 AS (
  SELECT feature_id, CAST(0 AS DOUBLE) AS weight FROM dict
  UNION ALL SELECT -1 AS feature_id, CAST(1 AS DOUBLE) AS weight
)"""]
    for t in range(1, k + 1):
        s = step / math.sqrt(t)
        shrink = 1.0 - s * reg
        ctes.append(f"""{prefix}_m{t} AS MATERIALIZED (
  SELECT d.article_id, d.label, {MARGIN} AS margin
  FROM design_train d JOIN {prefix}_w{t-1} w ON d.feature_id = w.feature_id
  GROUP BY d.article_id, d.label
),
{prefix}_g{t} AS MATERIALIZED (
  SELECT d.feature_id, sum({_residual(loss)}) AS grad_sum
  FROM design_train d JOIN {prefix}_m{t} m ON d.article_id = m.article_id
  GROUP BY d.feature_id
),
{prefix}_w{t} AS MATERIALIZED (
  SELECT w.feature_id,
         w.weight * {_dbl(shrink)} - {_dbl(s)} * (COALESCE(g.grad_sum, 0.0) / (SELECT n FROM ntrain)) AS weight
  FROM {prefix}_w{t-1} w LEFT JOIN {prefix}_g{t} g ON w.feature_id = g.feature_id
)""")
    return ",\n".join(ctes)


def _model_ctes(k: int = Q.FULL_ITERATIONS) -> str:
    return ",\n".join([_gd("lr", "logistic", k), _gd("svm", "hinge", k)])


def _scores(k: int = Q.FULL_ITERATIONS) -> str:
    return f"""scores AS MATERIALIZED (
  SELECT 'lr' AS model, d.article_id, d.split, d.label, {MARGIN} AS margin
  FROM design_all d JOIN lr_w{k} w ON d.feature_id = w.feature_id
  GROUP BY d.article_id, d.split, d.label
  UNION ALL
  SELECT 'svm' AS model, d.article_id, d.split, d.label, {MARGIN} AS margin
  FROM design_all d JOIN svm_w{k} w ON d.feature_id = w.feature_id
  GROUP BY d.article_id, d.split, d.label
),
scored AS (SELECT *, 1.0 / (1.0 + exp(-margin)) AS score FROM scores)"""


LOSS = """(CASE WHEN label = 1.0 THEN -ln(CASE WHEN score = 0.0 THEN 1e-11 WHEN score = 1.0 THEN score - 1e-11 ELSE score END)
      ELSE -ln(1.0 - (CASE WHEN score = 0.0 THEN 1e-11 WHEN score = 1.0 THEN score - 1e-11 ELSE score END)) END)"""

ROC = """roc AS (
  SELECT model, split, article_id, label, score,
         row_number() OVER w AS rn,
         sum(label) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
         sum(label) OVER (PARTITION BY model, split) AS p,
         count(*) OVER (PARTITION BY model, split) AS n
  FROM scored
  WINDOW w AS (PARTITION BY model, split ORDER BY score DESC, article_id)
),
curve AS (
  SELECT *, tp / p AS tpr, (rn - tp) / (n - p) AS fpr FROM roc
),
auc_t AS (
  SELECT model, split, sum(dx * y) AS auc FROM (
    SELECT model, split,
           lead(fpr) OVER w2 - fpr AS dx,
           (lead(tpr) OVER w2 + tpr) / 2 AS y
    FROM curve WINDOW w2 AS (PARTITION BY model, split ORDER BY rn)
  ) WHERE dx IS NOT NULL GROUP BY model, split
),
loss_t AS (
  SELECT model, split, count(*) AS n_rows, avg(""" + LOSS + """) AS log_loss
  FROM scored GROUP BY model, split
),
base_t AS (
  SELECT split, avg(CASE WHEN label = 1.0 THEN -ln(p) ELSE -ln(1.0 - p) END) AS baseline_log_loss
  FROM labeled, (SELECT avg(label) AS p FROM labeled WHERE split = 'train') GROUP BY split
)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _base(with_date=False):
    return [_articles(with_date), LABELED]


def _feat(with_date=False):
    return _base(with_date) + [_long(with_date), DICT]


def _model(k=Q.FULL_ITERATIONS):
    return _feat() + [DESIGN, _model_ctes(k), _scores(k)]


def _eval():
    return _model() + [ROC]


def _lines_cte() -> str:
    cols = A.article_columns()
    texts = [f"CAST({c} AS VARCHAR)" if c in ("timedelta", "shares") else c for c in cols]
    return f"lines AS (SELECT concat_ws(', ', {', '.join(texts)}) AS value FROM articles)"


def _replies(where: str = "") -> str:
    return f"""replies AS (
  SELECT event_id, user_id AS article_id, user_id % 3 AS source, event_type AS network,
         CASE WHEN event_type = 'click' THEN '[' || props || ']' ELSE props END AS reply
  FROM events {where}
),
counts AS (
  SELECT event_id, article_id, source, network,
         CASE WHEN network = 'click' THEN CAST(json_extract(reply, '$[0].k') AS BIGINT)
              ELSE CAST(json_extract(reply, '$.k') AS BIGINT) END AS share_count
  FROM replies
),
totals AS (
  SELECT article_id, source, network, CAST(sum(share_count) AS BIGINT) AS shares, count(*) AS n_replies
  FROM counts GROUP BY article_id, source, network
)"""


REPLIES = _replies()
TWO_NETWORKS = _replies("WHERE event_type IN ('click', 'view')")


def oracle_sql() -> dict[str, str]:
    header = header_line(A.article_columns())
    n_cols = len(A.article_columns())
    lk_idx, lk_val = Q.LOOKUP_KEY
    sx, sy = Q.SCATTER_X, Q.SCATTER_Y
    k = Q.FULL_ITERATIONS
    sql = {}

    sql["hash_split"] = _with(*_base()) + "SELECT article_id, bucket, split FROM labeled"
    sql["random_split"] = """SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_articles,
  'test,train,val' AS names, true AS train_share_ok, true AS val_share_ok, true AS test_share_ok FROM orders"""
    sql["ordered_peek"] = _with(*_base()) + \
        f"SELECT article_id, split, label FROM labeled ORDER BY article_id LIMIT {Q.TOP_K}"
    sql["popularity_label"] = _with(*_base()) + \
        "SELECT article_id, split, rate, label FROM labeled"
    sql["split_counts"] = _with(*_base()) + \
        "SELECT COALESCE(split, 'all') AS split, count(*) AS n_rows FROM labeled GROUP BY ROLLUP (split)"
    sql["split_positive_counts"] = _with(*_base()) + \
        "SELECT split, count(*) AS n_rows, count(*) FILTER (WHERE label = 1.0) AS n_positive FROM labeled GROUP BY split"
    sql["positive_fraction"] = _with(*_base()) + \
        "SELECT count(*) AS n_rows, count(*) FILTER (WHERE label = 1.0) AS n_positive, avg(label) AS positive_fraction FROM labeled"
    sql["label_mean"] = _with(*_base()) + \
        "SELECT avg(label) AS label_mean FROM labeled WHERE split = 'train'"
    sql["shares_per_day_profile"] = _with(*_base()) + """SELECT count(*) AS n_rows,
  min(rate) AS min_rate, max(rate) AS max_rate,
  round(avg(rate), 6) AS mean_rate, round(stddev_pop(rate), 6) AS stddev_rate,
  round(avg(power(rate - m, 3)) / power(avg(power(rate - m, 2)), 1.5), 6) AS skewness_rate,
  count(*) FILTER (WHERE rate > 50) AS n_above,
  round(avg(CASE WHEN rate > 50 THEN 1.0 ELSE 0.0 END), 6) AS fraction_above,
  max(timedelta) AS max_timedelta
FROM labeled, (SELECT avg(rate) AS m FROM labeled)"""

    sql["parse_line_features"] = _with(_articles(False), _lines_cte()) + """SELECT parts[1] AS url,
  CAST(i - 3 AS INTEGER) AS idx, parts[i] AS value
FROM (SELECT string_split(value, ', ') AS parts FROM lines) t,
     range(3, len(parts)) r(i)"""
    sql["drop_header"] = _with(_articles(False), _lines_cte()) + \
        f"SELECT value FROM (SELECT '{header}' AS value UNION ALL SELECT value FROM lines) WHERE value <> '{header}'"
    # files written by Spark and read back: the data lines, and the inferred types
    sql["scan_text_lines"] = _with(_articles(False), _lines_cte()) + "SELECT value FROM lines"
    sql["input_order"] = """SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS line_no,
  'article/' || CAST(o_orderkey AS VARCHAR) AS url FROM orders"""
    sql["rejected_lines"] = _with(_articles(False)) + """SELECT CASE WHEN url LIKE '%9' THEN 'field count'
    WHEN article_id % 7 = 0 THEN 'age' WHEN article_id % 11 = 0 THEN 'shares' ELSE 'good' END AS reason, count(*) AS n_lines,
  sum(timedelta) FILTER (WHERE url NOT LIKE '%9' AND article_id % 7 <> 0 AND article_id % 11 <> 0) AS sum_age
FROM articles GROUP BY 1"""
    sql["rejected_replies"] = _with(REPLIES) + """SELECT event_id,
  CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN share_count END AS share_count,
  CASE WHEN event_id % 5 = 0 THEN 'no json' WHEN event_id % 7 = 0 THEN 'no count' END AS reason FROM counts"""
    sql["scan_csv"] = _with(_articles(False)) + """SELECT url, timedelta, f0, f1, f2, f3,
  CAST(f4 AS INTEGER) AS f4, CAST(f5 AS INTEGER) AS f5, CAST(f6 AS INTEGER) AS f6, shares
FROM articles"""
    sql["schema_columns"] = _with(*_feat()) + f"""SELECT h.position, h.raw_name, h.name, h.role,
  h.feature_index, COALESCE(c.n_values, 0) AS n_values
FROM (
  SELECT position, raw_name, regexp_replace(raw_name, ',$', '') AS name,
         CASE WHEN position = 0 THEN 'identifier' WHEN position = 1 THEN 'age'
              WHEN position = {n_cols - 1} THEN 'shares' ELSE 'predictor' END AS role,
         CASE WHEN position BETWEEN 2 AND {n_cols - 2} THEN CAST(position - 2 AS INTEGER) ELSE -1 END AS feature_index
  FROM (SELECT CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS position, unnest(p) AS raw_name
        FROM (SELECT string_split_regex('{header}', '\\s+') AS p))
) h LEFT JOIN (SELECT idx, count(*) AS n_values FROM dict GROUP BY idx) c ON h.feature_index = c.idx"""
    sql["sink_parquet_roundtrip"] = _with(*_base()) + \
        "SELECT article_id, split, label, rate FROM labeled"

    sql["feature_long"] = _with(*_feat()) + "SELECT article_id, split, idx, value FROM long"
    sql["distinct_features"] = _with(*_feat()) + \
        "SELECT idx, value, count(*) AS n_rows FROM long WHERE split = 'train' GROUP BY idx, value"
    sql["dictionary_size"] = _with(*_feat()) + \
        "SELECT COALESCE(idx, -1) AS idx, count(*) AS n_values FROM dict GROUP BY ROLLUP (idx)"
    sql["feature_dictionary"] = _with(*_feat()) + "SELECT idx, value, feature_id FROM dict"
    sql["dictionary_lookup"] = _with(*_feat()) + \
        f"SELECT idx, value, feature_id FROM dict WHERE idx = {lk_idx} AND value = '{lk_val}'"
    enc = """enc AS (
  SELECT l.article_id, l.split, l.label, count(d.feature_id) AS n_active,
         COALESCE(string_agg(CAST(d.feature_id AS VARCHAR), ',' ORDER BY d.feature_id), '') AS feature_ids
  FROM long l LEFT JOIN dict d ON l.idx = d.idx AND l.value = d.value
  GROUP BY l.article_id, l.split, l.label
)"""
    sql["one_hot_encode"] = _with(*_feat(True), enc) + \
        "SELECT article_id, split, n_active, feature_ids, repeat('1.0,', n_active - 1) || '1.0' AS \"values\", (SELECT count(*) FROM dict) AS size FROM enc"
    sql["feature_vectors"] = _with(*_feat(True), enc) + \
        "SELECT article_id, split, (SELECT count(*) FROM dict) AS size, feature_ids, repeat('1.0,', n_active - 1) || '1.0' AS \"values\" FROM enc"
    sql["dictionary_sketches"] = _with(*_base(True), _long(True)) + """SELECT idx, count(*) AS n_rows,
  count(DISTINCT value) AS n_values, true AS within_error FROM long GROUP BY idx"""
    sql["labeled_points"] = _with(*_feat(True), enc) + \
        "SELECT article_id, split, label, n_active, feature_ids FROM enc"

    for name, loss, prefix in (("lr", "logistic", "lr"), ("svm", "hinge", "svm")):
        sql[f"{name}_gradient_step"] = _with(*_feat(), DESIGN, _gd(prefix, loss, 1)) + f"""SELECT w.feature_id,
  round(g.grad_sum / (SELECT n FROM ntrain), 9) AS mean_gradient, round(w.weight, 9) AS weight
FROM {prefix}_w1 w LEFT JOIN {prefix}_g1 g ON w.feature_id = g.feature_id"""
        sql[f"{name}_fit_3_steps"] = _with(*_feat(), DESIGN, _gd(prefix, loss, Q.SHORT_ITERATIONS)) + \
            f"SELECT feature_id, round(weight, 9) AS weight FROM {prefix}_w{Q.SHORT_ITERATIONS}"
        sql[f"{name}_fit"] = _with(*_feat(), DESIGN, _gd(prefix, loss, k)) + \
            f"SELECT '{name}' AS model, feature_id, round(weight, 9) AS weight FROM {prefix}_w{k}"

    sql["lr_fit_cells"] = sql["lr_fit_3_steps"]

    sql["sigmoid"] = _with(*_model()) + \
        "SELECT article_id, split, round(margin, 6) AS margin, round(score, 6) AS probability FROM scored WHERE model = 'lr'"
    sql["predict_proba"] = _with(*_model()) + \
        "SELECT split, article_id, label, round(score, 6) AS score FROM scored WHERE model = 'lr'"
    sql["svm_scores"] = _with(*_model()) + \
        "SELECT split, article_id, label, round(margin, 6) AS margin, round(score, 6) AS score FROM scored WHERE model = 'svm'"
    sql["score_label_pairs"] = _with(*_model()) + \
        "SELECT model, split, article_id, label, round(score, 6) AS score FROM scored"
    sql["log_loss_rows"] = _with(*_model()) + \
        f"SELECT article_id, split, label, round(score, 6) AS score, round({LOSS}, 6) AS loss FROM scored WHERE model = 'lr'"
    sql["smallest_weights"] = _with(*_feat(), DESIGN, _model_ctes(k)) + f"""SELECT model, pos, feature_id,
  round(weight, 9) AS weight, round(intercept, 9) AS intercept
FROM (
  SELECT m.model, m.feature_id, m.weight, i.intercept,
         row_number() OVER (PARTITION BY m.model ORDER BY m.weight, m.feature_id) AS pos
  FROM (SELECT 'lr' AS model, * FROM lr_w{k} UNION ALL SELECT 'svm' AS model, * FROM svm_w{k}) m
  JOIN (SELECT 'lr' AS model, weight AS intercept FROM lr_w{k} WHERE feature_id = -1
        UNION ALL SELECT 'svm', weight FROM svm_w{k} WHERE feature_id = -1) i ON m.model = i.model
  WHERE m.feature_id <> -1
) WHERE pos <= {Q.TOP_K}"""
    sql["top5_positive_scores"] = _with(*_model()) + f"""SELECT model, split, pos, article_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY model, split ORDER BY score DESC, article_id) AS pos
      FROM scored WHERE label = 1.0) WHERE pos <= {Q.TOP_K}"""

    sql["baseline_log_loss"] = _with(*_model(), ROC) + \
        "SELECT split, round(baseline_log_loss, 6) AS baseline_log_loss FROM base_t"
    sql["log_loss_eval"] = _with(*_eval()) + \
        "SELECT model, split, n_rows, round(log_loss, 6) AS log_loss FROM loss_t"
    sql["roc_points"] = _with(*_eval()) + \
        "SELECT model, split, rn, article_id, label, tpr, fpr FROM curve WHERE split IN ('val', 'test')"
    sql["roc_steps"] = _with(*_eval()) + """SELECT model, split, rn, round(dx, 9) AS dx, round(y, 9) AS y, round(dx * y, 9) AS area
FROM (SELECT model, split, rn, lead(fpr) OVER w - fpr AS dx, (lead(tpr) OVER w + tpr) / 2 AS y
  FROM curve WINDOW w AS (PARTITION BY model, split ORDER BY rn)) WHERE dx IS NOT NULL AND split IN ('val', 'test')"""
    sql["auc"] = _with(*_eval()) + "SELECT model, split, round(auc, 6) AS auc FROM auc_t"
    sql["model_split_metrics"] = _with(*_eval()) + """SELECT l.model, l.split, l.n_rows, round(l.log_loss, 6) AS log_loss,
  round(b.baseline_log_loss, 6) AS baseline_log_loss, round(a.auc, 6) AS auc
FROM loss_t l JOIN auc_t a ON l.model = a.model AND l.split = a.split JOIN base_t b ON l.split = b.split"""
    sql["model_selection"] = _with(*_eval()) + """SELECT s.model, round(s.auc, 6) AS selection_auc,
  round(t.auc, 6) AS final_auc, round(l.log_loss, 6) AS final_log_loss
FROM (SELECT model, auc FROM auc_t WHERE split = 'val' ORDER BY auc DESC, model DESC LIMIT 1) s
JOIN auc_t t ON t.model = s.model AND t.split = 'test'
JOIN loss_t l ON l.model = s.model AND l.split = 'test'"""
    sql["metrics_report"] = _with(*_eval()) + """SELECT model, split, metric, round(value, 6) AS value, printf('%.3f', value) AS text FROM (
  SELECT model, split, 'log_loss' AS metric, log_loss AS value FROM loss_t
  UNION ALL SELECT model, split, 'auc', auc FROM auc_t
  UNION ALL SELECT 'baseline', split, 'log_loss', baseline_log_loss FROM base_t)"""

    sql["sorted_by_shares_rank"] = """SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS position,
  o_orderkey AS article_id, o_totalprice AS shares FROM orders"""
    sql["sorted_feature_columns"] = _with(_articles(False)) + """SELECT row_number() OVER (ORDER BY shares DESC, article_id) - 1 AS position,
  article_id, f0 AS priority, f4 AS n_lines FROM articles"""
    sql["scatter_points"] = f"""SELECT l_orderkey, l_linenumber, l_quantity AS x, l_extendedprice AS y FROM lineitem
WHERE l_quantity BETWEEN {sx[0]} AND {sx[1]} AND l_extendedprice BETWEEN {sy[0]} AND {sy[1]}"""
    sql["ols_slope_intercept"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n_points FROM lineitem"""
    sql["ols_ml_fit"] = """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem"""
    sql["json_share_counts"] = _with(REPLIES) + \
        "SELECT event_id, article_id, source, network, share_count FROM counts"
    sql["share_counts_paired"] = _with(TWO_NETWORKS) + """SELECT a.article_id, a.source, a.shares AS click_shares, b.shares AS view_shares
FROM totals a JOIN totals b ON a.article_id = b.article_id AND a.source = b.source
WHERE a.network = 'click' AND b.network = 'view'"""
    sql["share_counts_union"] = _with(TWO_NETWORKS) + """SELECT article_id, network, shares FROM totals WHERE network = 'click'
UNION ALL SELECT article_id, network, shares FROM totals WHERE network = 'view'"""
    sql["shares_by_article_network"] = _with(TWO_NETWORKS) + """SELECT article_id, source,
  CAST(sum(share_count) FILTER (WHERE network = 'click') AS BIGINT) AS click,
  CAST(sum(share_count) FILTER (WHERE network = 'view') AS BIGINT) AS "view"
FROM counts GROUP BY article_id, source"""
    sql["network_by_source"] = _with(REPLIES) + """SELECT source, network, CAST(sum(shares) AS BIGINT) AS total_shares,
  round(avg(shares), 6) AS mean_shares, count(*) AS n_articles,
  arg_max(article_id, (shares, -article_id)) AS top_article
FROM totals GROUP BY source, network"""
    sql["page_script_meta"] = r"""WITH s AS (
  SELECT page_id, regexp_extract(html, '(?si)<script\b[^>]*>(.*?)</script>', 1) AS script FROM pages
), t AS (
  SELECT page_id, script, string_split(script, ';')[1] AS statement FROM s
), r AS (
  SELECT page_id, script, statement,
         regexp_replace(CASE WHEN len(string_split(statement, '=')) >= 2 THEN string_split(statement, '=')[2] END,
                        '(?m)^[ \t]+', '', 'g') AS record_text
  FROM t
)
SELECT page_id, script, statement, record_text,
  CASE WHEN regexp_matches(trim(record_text), '^"[^"]*"$') THEN regexp_extract(trim(record_text), '^"([^"]*)"$', 1)
       ELSE trim(record_text) END AS record_value,
  COALESCE(json_valid(record_text) AND json_type(record_text) = 'OBJECT', false) AS is_mapping
FROM r"""
    sql["nested_records"] = """SELECT c_custkey, true AS is_nested, c_mktsegment AS first_topic, 'of ' || n_name AS second_topic,
  n_name AS nation, CAST(c_nationkey AS BIGINT) AS nation_key, c_acctbal < 0 AS in_debt, CAST(NULL AS VARCHAR) AS missing
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
    sql["record_schema"] = """SELECT 'OBJECT<name: STRING, place: OBJECT<`in debt`: BOOLEAN, key: BIGINT, nation: STRING>, topics: ARRAY<STRING>>' AS schema
FROM (SELECT count(*) AS n FROM customer) WHERE n > 0"""
    sql["page_meta_map"] = """SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys,
  CAST(len(json_keys(props)) AS BIGINT) AS n_keys, json_extract_string(props, '$.k') AS value_k FROM events"""
    sql["article_age_days"] = f"""SELECT o_orderkey AS article_id, strftime(o_orderdate, '%m/%d/%Y') AS pub_date,
  CAST(date_diff('day', CAST(strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS DATE), DATE '{AS_OF}') AS BIGINT) AS age
FROM orders"""
    return sql
