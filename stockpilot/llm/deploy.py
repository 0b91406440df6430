"""What a session needs before its Python workers run this package's code."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch unless the session sets them: an executor holds a
#: batch on both sides of each worker's pipe, so Spark's 64 MB cost it hundreds.
BATCH_BYTES = 8 << 20
_BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()


def prepare_workers(spark: SparkSession) -> None:
    """Bound the Arrow batches, and let Spark distribute the package as a zip,
    once per application, so that workers find it without an installation."""
    if _BATCH_KEY not in spark.conf.getAll:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    path = os.path.join(tempfile.mkdtemp(prefix="stockpilot-code-"), "stockpilot_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), top))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
