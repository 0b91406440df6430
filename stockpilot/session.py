"""Session helpers for tests, the bench and local runs.

Cluster jobs get their session from the platform; nothing here overrides a
setting that is already present.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # checkpoint files of DataFrames that are no longer referenced are removed
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(
    cores: int | str = "*", shuffle_partitions: int = 8, app: str = "stockpilot", extra_conf: dict | None = None
) -> SparkSession:
    """Session for tests and the bench.  Under spark-submit the submitted
    master and folders win; the local ones are used only without a submit."""
    b = SparkSession.builder.appName(app)
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    if not submitted:
        b = b.master(f"local[{cores}]").config("spark.driver.memory", "16g")
    for k, v in {**LOCAL_CONF, **(extra_conf or {})}.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if SparkSession.getActiveSession() is None and not submitted:
        # local catalog tables go to a scratch folder, not the working directory
        b = b.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="stockpilot-wh-"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's
    ``spark.checkpoint.dir``, or the checkpoint folder set on the context.
    Only a one-machine ``local`` master may fall back to a scratch folder."""
    sc = spark.sparkContext
    cur = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not cur:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a shared folder on master {sc.master}")
        cur = tempfile.mkdtemp(prefix="stockpilot-ckpt-")
        sc.setCheckpointDir(cur)
    return cur


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``checkpoint()`` usable on this session and return its folder."""
    cur = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(cur)
    return spark.sparkContext.getCheckpointDir() or cur


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cluster_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 8) -> dict[str, str]:
    """Session settings for a large cluster run, sized from the input volume.

    The initial shuffle partition count targets ~1 GB per partition of the
    largest shuffle (the lineitem-sized joins, before AQE), at least three
    waves of the cluster's cores; AQE then coalesces small partitions to ~256 MB and splits
    skewed ones.  Broadcasts happen only when AQE measures a side below the
    threshold at run time (static broadcast from plan estimates is off,
    nothing is hinted)."""
    cores = executors * cores_per_executor
    by_size = int(input_tb * 1024)  # one partition per GB of input
    partitions = max(3 * cores, by_size)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        # broadcast only what AQE has measured (runtime shuffle statistics);
        # no static broadcast from plan-time size estimates
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def apply_cluster_conf(spark: SparkSession, **sizing) -> dict[str, str]:
    """Set the runtime SQL settings of ``cluster_conf`` that the session does
    not already define (a platform's explicit choices win)."""
    applied = {}
    for k, v in cluster_conf(**sizing).items():
        if spark.conf.get(k, None) in (None, ""):
            spark.conf.set(k, v)
            applied[k] = v
    return applied
