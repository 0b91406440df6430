"""Every registered query equals its DuckDB oracle on the small driver data
(row count, column names and types, multiset of rows), and its executed plan has no
cartesian / nested-loop join and no Python UDF."""

import pytest

from conftest import SF001
from tools_oracle import compare_one

import __spark_entry__ as E
from stockpilot.plans.oracle import ORACLE
from stockpilot.plans.registry import spark_callables

# the text operators have their own tests
NAMES = sorted(ORACLE)


def test_every_query_has_an_oracle_or_is_declared():
    assert sorted(spark_callables()) == NAMES
    assert set(NAMES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck001, name):
    status, detail = compare_one(spark, duck001, SF001, name)
    assert status == "OK", detail
