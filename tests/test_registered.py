"""Every registered query against its statement, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import pytest
from compare import connect, differences, plan

from __spark_entry__ import TEXT_QUERIES, entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
# Operators that no plan may hold: cross joins, and Python between the columns.
UNWANTED = (
    "CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEval", "BatchEval", "InPandas", "InArrow",
)

# The text operators bring their own tests.
STAR_QUERIES = [name for name in queries() if name not in TEXT_QUERIES]

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="generated tables are not here")


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", STAR_QUERIES)
def test_query_equals_statement(spark, connection, name):
    result = queries()[name](spark, SF_DIR)
    assert differences(result, connection, oracle_sql()[name]) == []
    assert not [operator for operator in UNWANTED if operator in plan(result)]


def test_every_query_has_a_statement():
    assert set(oracle_sql()) >= set(STAR_QUERIES)


def test_entry(spark):
    assert entry(spark).columns[0] == "order_date"
