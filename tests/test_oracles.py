"""Every query with a DuckDB statement gives the same rows; the others run."""

from __future__ import annotations

import pytest

from tempoweave import queries as core
from tests.oracle import rows, want

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, name):
    got = core.queries()[name](spark, FOLDER).toPandas()
    sql = core.oracle_sql().get(name)
    assert len(got)
    if sql:
        expected = want(sql, FOLDER)
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows(got) == rows(expected)
