"""Materialised layers: write the raw and cleansed tables once as Parquet
and build a Domain over them, so marts read small typed tables instead of
re-deriving them (and every mart plan starts from a short lineage).

Locations live under the session's shared ``spark.checkpoint.dir`` unless
given; nothing is written to a machine-local folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stockpilot.params import DEFAULT, Params
from stockpilot.plans.context import Domain
from stockpilot.sources.driver import LazyTables

# Tables worth materialising: every raw table and every cleansed table.
CLEAN_EXTRA = ("lead_times_base",)


def layer_root(spark: SparkSession) -> str:
    from stockpilot.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/layers-{uuid.uuid4().hex}"


def _write_all(frames: dict[str, DataFrame], folder: str, workers: int) -> dict[str, str]:
    """Write independent tables as concurrent Spark jobs (plans are built
    first, on this thread; only the writes run on the pool)."""
    from concurrent.futures import ThreadPoolExecutor

    def write(item):
        name, df = item
        path = f"{folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return name, path

    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return dict(pool.map(write, frames.items()))


def materialize(dom: Domain, root: str, workers: int = 4) -> dict[str, str]:
    """Write raw/<table>, then build the cleansed tables from the written raw
    layer (lineage cut; the mapping runs once per table) and write
    clean/<table>.  Tables of one layer are independent, so their write jobs
    run concurrently.  Returns "raw/<t>" / "clean/<t>" -> path."""
    spark = dom.spark
    raw_frames = {t: dom.raw[t] for t in dom.raw.keys()}
    paths = {f"raw/{t}": p for t, p in _write_all(raw_frames, f"{root}/raw", workers).items()}
    raw = LazyTables({t: (lambda t=t: spark.read.parquet(f"{root}/raw/{t}")) for t in dom.raw.keys()})
    rdom = Domain(raw, dom.p, spark)
    clean_frames = {t: rdom[t] for t in list(rdom.clean.keys())}
    paths.update({f"clean/{t}": p for t, p in _write_all(clean_frames, f"{root}/clean", workers).items()})
    return paths


def from_layers(spark: SparkSession, root: str, params: Params = DEFAULT) -> Domain:
    """Domain whose raw and cleansed tables are read from ``root``."""
    from stockpilot.sources.schemas import SCHEMAS

    raw_names = list(SCHEMAS) + ["actuals"]
    clean_names = list(SCHEMAS) + list(CLEAN_EXTRA)
    raw = LazyTables({t: (lambda t=t: spark.read.parquet(f"{root}/raw/{t}")) for t in raw_names})
    dom = Domain(raw, params, spark)
    dom.__dict__["clean"] = LazyTables({t: (lambda t=t: spark.read.parquet(f"{root}/clean/{t}")) for t in clean_names})
    return dom
