import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stockpilot.params import DEFAULT  # noqa: E402
from stockpilot.plans.context import Domain  # noqa: E402
from stockpilot.sources.schemas import SCHEMAS  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
T = DEFAULT.as_of


@pytest.fixture(scope="session")
def spark():
    from stockpilot.session import local_session

    s = local_session(cores=4, shuffle_partitions=4, app="stockpilot-tests")
    yield s


def days(n: int) -> dt.date:
    return T + dt.timedelta(days=n)


@pytest.fixture(scope="session")
def make_domain(spark):
    """Domain over hand-made raw tables; tables not given are empty."""

    def build(params=DEFAULT, **tables):
        raw = {}
        for name, schema in SCHEMAS.items():
            rows = tables.get(name, [])
            cols = schema.fieldNames()
            full = [tuple(r.get(c) for c in cols) if isinstance(r, dict) else r for r in rows]
            raw[name] = spark.createDataFrame(full, schema)
        return Domain(raw, params, spark)

    return build


def rows(df, *cols, order=None):
    out = df.select(*cols) if cols else df
    if order:
        out = out.orderBy(*order)
    return [tuple(r) for r in out.collect()]


@pytest.fixture(scope="session")
def duck001():
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from oracle_check import duck

    return duck(SF001)
