"""Query registry: name -> callable(spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockpilot.params import DEFAULT, Params
from stockpilot.plans.context import Domain

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}


def query(name: str):
    def deco(fn: Callable[[Domain], DataFrame]):
        QUERIES[name] = fn
        return fn

    return deco


def _marts_as_queries() -> None:
    from stockpilot.plans.marts import MART_BUILDERS

    for name in MART_BUILDERS:
        if name.startswith("mart_") and name not in QUERIES:
            QUERIES[name] = lambda dom, _n=name: dom.mart(_n)


def load_all() -> dict[str, Callable[[Domain], DataFrame]]:
    import stockpilot.plans.marts  # noqa: F401  (registers marts)
    import stockpilot.plans.queries  # noqa: F401  (registers the other operators)

    _marts_as_queries()
    return QUERIES


_DOMAINS: dict[tuple, Domain] = {}
# cleansed tables are checkpointed once per session (see plans/context.py)
CHECKPOINT_CLEAN = True


def domain_for(spark: SparkSession, sf_dir: str, params: Params = DEFAULT) -> Domain:
    """One Domain per (session, data folder, parameters).  DataFrames are
    immutable, lazy plans, so queries can share the analysed domain and mart
    subtrees instead of rebuilding them on the driver for every call."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), params)
    if key not in _DOMAINS:
        _DOMAINS[key] = Domain.from_driver(spark, sf_dir, params, checkpoint_clean=CHECKPOINT_CLEAN)
    return _DOMAINS[key]


def invalidate(spark: SparkSession, sf_dir: str) -> None:
    """Forget what this session has read and written of a data folder, so that
    the next query sees its present files."""
    from stockpilot.sources.driver import forget_reads

    mine = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    for key in [k for k in _DOMAINS if k[:3] == mine]:
        del _DOMAINS[key]
    forget_reads(mine)
    spark.catalog.refreshByPath(sf_dir)


def run(spark: SparkSession, sf_dir: str, name: str, params: Params = DEFAULT) -> DataFrame:
    return load_all()[name](domain_for(spark, sf_dir, params))


def spark_callables(params: Params = DEFAULT) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: (lambda spark, sf_dir, _n=name: run(spark, sf_dir, _n, params)) for name in load_all()
    }
