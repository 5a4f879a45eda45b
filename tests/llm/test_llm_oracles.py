"""Queries with SQL against DuckDB, and what the entry registers."""

from __future__ import annotations

import pytest

pytest.importorskip("shiprisk.llm")

import __spark_entry__ as E  # noqa: E402

from shiprisk.checks.compare import compare, duck  # noqa: E402
from shiprisk.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_oracle(spark, name):
    ok, msg = compare(registry.queries()[name](spark, SF), duck(SF), registry.oracle_sql()[name])
    assert ok, msg


def test_entry_has_one_query_per_operator_and_the_pipeline():
    names = [n for n in E.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries()
