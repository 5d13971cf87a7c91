"""Physical-plan checks: the scale properties the operators are built for."""

import re

import pytest

from sharecast.operators import evaluate as E
from sharecast.operators import models as M
from sharecast.plans import popularity as P
from sharecast.plans import queries as Q

from .conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def prep(spark):
    return P.prepare(spark, SF_SMALL)


def test_gradient_pass_has_one_shuffle_and_no_join_or_sort(spark, prep):
    import numpy as np
    start = np.zeros(prep.dictionary.count() + 1)
    p = plan(M.vector_gradients(prep.design_train(), {"lr": start, "svm": start}, {"lr": "logistic", "svm": "hinge"}))
    assert p.count("Exchange hashpartitioning") == 1          # the partial gradient sums only
    assert "hashpartitioning(feature_id" in p and "partial_sum" in p
    assert not any(x in p for x in ("Join", "Sort ", "Window"))


def test_cells_are_never_shuffled(spark, prep):
    """Above the bound the design stays where it is bucketed: what is shuffled are partial
    sums (two longs per cell and article), residuals and weights, never arrays of a row."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells = M.cell_table(prep.design_train(), 4)
        weights = M.initial_weights(prep.dictionary, prep.n_train)
        with M._joins_in_place(spark):
            p = plan(M.cell_gradients(cells, weights, 4, "logistic", M.article_cells(cells)))
            m = M.cell_margins(cells, weights, 4)
            sums = [x for x in plan(m).splitlines() if "partial_sum(m_h" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    reads = [m.end() for m in re.finditer(r"Bucketed: true", p)]
    assert len(reads) >= 2
    assert sums and all(re.search(r"keys=\[article_id#\w+\], functions=\[partial_max\(label#\w+\), "
                                  r"partial_sum\(m_h#\w+\), partial_sum\(m_l#\w+\)\]", x) for x in sums)
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            assert "slots" not in below or "transform" in below or "HashAggregate" in below, (line, below)


def test_scoring_and_arrays_need_no_shuffle(spark, prep):
    import numpy as np
    start = np.zeros(prep.dictionary.count() + 1)
    w = M.initial_weights(prep.dictionary, prep.n_train)
    fitted = [M.LinearModel("lr", w, 0, start), M.LinearModel("svm", w, 0, start)]
    p = plan(M.score_design(prep.design(), fitted, P.KEEP))
    assert "Exchange" not in p and "Join" not in p            # a projection of the written design
    from sharecast.operators import features as FT
    arr = FT.encode_arrays(prep.long, prep.dictionary, ["article_id", "split"])
    assert "Exchange" not in plan(arr).replace("BroadcastExchange", "")


def test_roc_and_auc_share_one_order(spark, prep):
    ev = P.evaluate_models(prep, P.fit_both(prep, 1))
    assert ev.ranked is ev.ranked
    frozen = {f for df in (ev.roc, ev.auc) for f in df.inputFiles() if "ordered" in f}
    assert len({f.rsplit("/", 1)[0] for f in frozen}) == 1


def test_top_k_has_partial_group_limit(spark, prep):
    fitted = P.fit_both(prep, 1)
    ev = P.evaluate_models(prep, fitted)
    p = plan(E.top_positive_scores(ev.scores))
    assert re.search(r"WindowGroupLimit .*Partial", p)


def test_scatter_filters_reach_the_scan(spark):
    p = plan(Q.q_scatter_points(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(l_quantity), IsNotNull(l_extendedprice), GreaterThanOrEqual(l_quantity" in p
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_extendedprice:double>" in p


def test_ranks_single_partition_only_on_chunk_table(spark):
    from pyspark.sql import functions as F
    from sharecast.operators.ranks import global_rank
    df = spark.range(0, 1000, 1, 4).select(F.col("id").alias("v"))
    p = plan(global_rank(df, [F.col("v").desc()]))
    # the one single-partition exchange sits on top of the per-chunk aggregate
    for m in re.finditer(r"Exchange SinglePartition", p):
        below = p[m.end():m.end() + 400]
        assert "HashAggregate" in below
