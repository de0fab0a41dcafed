"""Every query with an oracle gives DuckDB's rows at the smallest size."""

from __future__ import annotations

import pytest

from rillwave.plans.registry import ORACLES, QUERIES

from .oracle import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name], SF)


def test_entry_has_a_query_for_each_name(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 91
