"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as E
from shiprisk import registry
from shiprisk.checks.compare import compare, duck

from conftest import SF_SMALL

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()
HEAVY_ROWS_ONLY = {"model_comparison", "rf_weighted_metrics", "feature_importance"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle_or_is_model_output():
    missing = set(QUERIES) - set(ORACLES)
    assert missing <= {"logreg_metrics", "rf_metrics", "rf_weighted_metrics", "score_delivery_risk",
                       "feature_importance", "importance_by_source", "model_comparison",
                       "model_roundtrip"}, missing


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    ok, msg = compare(QUERIES[name](spark, SF_SMALL), con, ORACLES[name])
    assert ok, msg


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - HEAVY_ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry_lists_every_query():
    assert set(E.queries()) >= set(QUERIES) and set(E.oracle_sql()) >= set(ORACLES)


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 4 and {r.shipping_mode for r in rows} == {
        "Same Day", "First Class", "Second Class", "Standard Class"}
