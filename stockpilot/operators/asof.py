"""As-of join for arbitrary lookup times: to each left row the nearest right row
of the same key at or before (or at or after) its time.

No key is ordered inside one task.  Both sides are put into one order of (key,
time), range-partitioned into contiguous slices whose numbers a checkpoint
fixes; inside a slice the last right row is carried along the order; the last
right row of each (key, slice) is carried over the key's slices, at most one row
per slice, and joined back to the lookups that found none in theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKWARD, FORWARD = "backward", "forward"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    values: list[str],
    direction: str = BACKWARD,
    exact: bool = True,
    within: Callable[[Column, Column], Column] | None = None,
    slices: int | None = None,
) -> DataFrame:
    """All left rows with ``right_time`` and ``values`` of the right row found
    (null if none; these columns must not be among the left ones).

    ``exact`` off: a right row at the very time does not count.  ``within`` of
    (left time, right time): whether a found row is near enough.  Of right rows
    with equal key and time the one with the greatest values (in their order,
    null least) counts.  A null in the key or time finds nothing and is not
    found; repeated left rows are each looked up."""
    from stockpilot.session import ensure_checkpoint_dir

    if direction not in (BACKWARD, FORWARD):
        raise ValueError(f"direction must be {BACKWARD} or {FORWARD}")
    spark = left.sparkSession
    ensure_checkpoint_dir(spark)
    found = [right_time, *values]
    if clash := set(found) & set(left.columns):
        raise ValueError(f"left has columns {sorted(clash)} too")
    keys = [f"k{i}" for i in range(len(by))]
    whole = lambda cols: F.struct(*(F.col(c) for c in cols))
    asked = left.select(
        *(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(left_time).alias("t"), F.lit(1).alias("lookup"), whole(left.columns).alias("l"),
    )
    given = right.select(
        *(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(right_time).alias("t"), F.lit(0).alias("lookup"), whole(found).alias("r"),
    ).filter(F.col("t").isNotNull())
    known = F.lit(True)
    for k in keys:
        given = given.filter(F.col(k).isNotNull())
        known = known & F.col(k).isNotNull()
    known = known & F.col("t").isNotNull()
    nothing = F.lit(None).cast(given.schema["r"].dataType)
    rows = asked.filter(known).unionByName(given, allowMissingColumns=True)

    time = F.col("t").asc() if direction == BACKWARD else F.col("t").desc()
    # at equal times the right rows come before the lookups, or after them
    first = F.col("lookup").asc() if exact else F.col("lookup").desc()
    order = [time, first, *(F.col("r")[v].asc_nulls_first() for v in values)]
    n = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *keys, *order).withColumn("slice", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("slice", *keys).orderBy(*order)
    rows = rows.withColumns({"seen": F.last("r", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), "at": F.row_number().over(inside)})
    tails = rows.groupBy(*keys, "slice").agg(F.max_by("seen", "at").alias("tail"))
    over = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "slice", F.last("tail", ignorenulls=True).over(over).alias("carried")).filter(F.col("carried").isNotNull())
    hits = rows.filter("lookup = 1").join(carried, [*keys, "slice"], "left").select("l", F.coalesce("seen", "carried").alias("r"))
    out = hits.unionByName(asked.filter(~F.coalesce(known, F.lit(False))).select("l", nothing.alias("r")))
    if within is not None:
        near = F.coalesce(within(F.col("l")[left_time], F.col("r")[right_time]), F.lit(False))
        out = out.withColumn("r", F.when(near, F.col("r")))
    return out.select(*(F.col("l")[c].alias(c) for c in left.columns), *(F.col("r")[c].alias(c) for c in found))
