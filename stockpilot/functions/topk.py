"""Exact top-k per group that never sorts a whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(
    df: DataFrame, group_cols: list[str], order_cols: list[Column], k: int, salt_cols: list[str], salts: int | None = None
) -> DataFrame:
    """Rows ranked 1..k per group by ``order_cols`` (which must be a total
    order), with the rank in column ``rank``.

    Two rounds: rows are first ranked inside (group, salt) buckets -- the
    salt is a hash of ``salt_cols``, so a hot group is spread over ``salts``
    tasks -- and only the k best of each bucket survive; the global top k is
    always among them.  The second round ranks at most ``salts * k`` rows
    per group."""
    if salts is None:  # as many as a shuffle has tasks
        salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in salt_cols]), F.lit(salts))
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order_cols)
    first = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    w2 = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return (
        first.withColumn("rank", F.row_number().over(w2))
        .filter(F.col("rank") <= k)
        .drop("_salt", "_r")
    )
