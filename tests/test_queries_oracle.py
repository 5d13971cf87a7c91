"""Every registered query against its DuckDB oracle on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from sharecast.plans.queries import QUERIES  # noqa: E402
from check_oracle import compare, duck  # noqa: E402

from .conftest import SF_SMALL  # noqa: E402

KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    r = compare(spark, con, SF_SMALL, key, entry.oracle_sql().get(key))
    assert r["spark_rows"] >= 0
    if r.get("oracle", 1) is None:
        return
    assert r["cols_match"], r
    assert r["types_match"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 6
    assert set(df.columns) == {"model", "split", "n_rows", "log_loss", "baseline_log_loss", "auc"}
    assert all(0.0 <= r.auc <= 1.0 for r in rows)


def test_rows_only_keys_are_declared():
    from sharecast.plans.queries import ROWS_ONLY
    assert set(KEYS) - set(entry.oracle_sql()) == ROWS_ONLY
