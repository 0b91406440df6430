"""Folders of a table that is stored by bucket and rewritten bucket by bucket.

Every epoch (a micro-batch, an update) writes folders of its own and publishes
them by one append of one file to ``manifest``; readers take the newest
published folder of each bucket.  An epoch that is lost before its publication
is written again over the same folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "epoch bigint, bucket int, path string"


class BucketFolders:
    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _published(self) -> DataFrame:
        """The manifest; an epoch that touched no bucket has a row without one."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def _has(self, epoch: int) -> bool:
        return not self._published().filter(F.col("epoch") == epoch).isEmpty()

    def _newest(self, before: int | None = None) -> dict[int, str]:
        """The newest folder of each bucket (at most ``buckets`` rows)."""
        m = self._published().filter(F.col("path").isNotNull())
        m = m if before is None else m.filter(F.col("epoch") < before)
        return {r.bucket: r.path for r in m.groupBy("bucket").agg(F.max_by("path", "epoch").alias("path")).collect()}

    def _publish(self, rows: list[tuple]) -> None:
        # one file: it is there as a whole or not at all
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _bucket(self, *key: str):
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, key: list[str], epoch: int, touched: list[int]) -> None:
        """Write the whole rows of the touched buckets and publish them."""
        folder = f"{self.root}/data/epoch={epoch}"
        if not touched:
            self._publish([(epoch, None, None)])
            return
        rows = rows.withColumn("_bucket", self._bucket(*key)).repartition(len(touched), "_bucket")
        rows.write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        # a bucket that lost all its rows has no folder: its path is empty
        schema = rows.schema
        there = {r[0] for r in self.spark.read.schema(schema).parquet(folder).select("_bucket").distinct().collect()}
        self._publish([(epoch, b, f"{folder}/_bucket={b}" if b in there else "") for b in touched])
