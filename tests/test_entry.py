"""The driver contract of __spark_entry__."""

import re

import __spark_entry__ as E
from stockpilot.plans.registry import spark_callables


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"demand_id", "route_type", "action_level"} <= set(df.columns)


def test_queries_and_oracles_align():
    q, o = spark_callables(), E.oracle_sql()
    assert set(q) <= set(o) and set(q) <= set(E.queries())
    assert len(q) >= 90
    for name in q:
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
        assert not re.match(r"op\d+_", name) and "pipeline" not in name
