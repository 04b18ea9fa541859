"""Every registered query against its DuckDB twin on the smallest tables."""

from __future__ import annotations

import pytest
from compare import difference, duck

import __spark_entry__ as entry
from plantpulse.plans.queries import QUERIES
from plantpulse.plans.twins import TWINS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(TWINS)
    assert set(QUERIES) <= set(entry.queries()) and set(TWINS) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, con, name):
    assert difference(QUERIES[name](spark, SF), con, TWINS[name]) is None
