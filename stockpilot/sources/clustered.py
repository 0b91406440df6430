"""Tables clustered by several columns: files of rows that are near each other
in all of them, with a manifest of each file's least and greatest values that
prunes the files before a scan.

A row's place is its Z-order key: per column the rank of the value among a few
quantiles of the column, the ranks' bits interleaved.  Files are ranges of the
key, so a filter on any of the columns meets a part of the files only; with one
column clustering is a plain range partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a column's rank: so many quantiles, less one, are collected for each column.
BITS = 6
#: Bytes of a string that its place is taken from.
_PREFIX = 6


def _number(df: DataFrame, name: str) -> Column:
    """An order-preserving number of the column (strings: of their first bytes)."""
    kind = df.schema[name].dataType
    col = F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(col, "UTF-8"), 1, _PREFIX)), 2 * _PREFIX, "0"), 16, 10).cast("double")
    return col.cast("double")


def z_key(df: DataFrame, columns: list[str], bits: int = BITS) -> Column:
    """The interleaved ranks of the columns; nulls rank first.  Runs one
    aggregate over ``df`` for the quantiles (2 ** bits - 1 numbers a column)."""
    if not columns or len(columns) * bits > 62:
        raise ValueError("1 to 62 // bits columns")
    shares = [i / 2**bits for i in range(1, 2**bits)]
    numbers = [_number(df, c) for c in columns]
    cuts = df.agg(*(F.percentile_approx(n, shares, 10_000).alias(f"q{i}") for i, n in enumerate(numbers))).first()
    key = F.lit(0).cast("bigint")
    for i, number in enumerate(numbers):
        bounds = sorted(set(cuts[i] or []))
        rank = F.when(number.isNull(), 0).otherwise(_rank(number, bounds)).cast("bigint")
        for b in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(rank, b).bitwiseAND(F.lit(1)), b * len(columns) + i))
    return key


def _rank(number: Column, bounds: list[float]) -> Column:
    """How many of the bounds the number reaches."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda q: q <= number)) if bounds else F.lit(0)


def write_clustered(df: DataFrame, path: str, columns: list[str], files: int, bits: int = BITS) -> None:
    """Write ``df`` as about ``files`` files clustered by ``columns``, and their manifest."""
    spark, path = df.sparkSession, path.rstrip("/")
    place = "_z"
    while place in df.columns:
        place += "_"
    rows = df.withColumn(place, z_key(df, columns, bits))
    rows.repartitionByRange(files, place).sortWithinPartitions(place).drop(place).write.mode("overwrite").parquet(f"{path}/data")
    ends = [f(c).alias(f"{n}_{i}") for i, c in enumerate(columns) for n, f in (("least", F.min), ("greatest", F.max))]
    written = spark.read.schema(df.schema).parquet(f"{path}/data")
    written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *ends).write.mode("overwrite").parquet(f"{path}/manifest")
    # the columns, as the metadata of a one-row table
    spark.createDataFrame([(columns,)], "columns array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/clustering")


def files_of(spark: SparkSession, path: str, ranges: dict[str, tuple]) -> list[str]:
    """The files that may hold rows with every column inside its (least, greatest) range, both included."""
    path = path.rstrip("/")
    columns = list(spark.read.parquet(f"{path}/clustering").first()[0])
    if other := ranges.keys() - set(columns):
        raise ValueError(f"not clustered by {sorted(other)}")
    meets = [
        (F.col(f"greatest_{columns.index(c)}") >= F.lit(lo)) & (F.col(f"least_{columns.index(c)}") <= F.lit(hi))
        for c, (lo, hi) in ranges.items()
    ]
    manifest = spark.read.parquet(f"{path}/manifest")
    return [r.file for r in manifest.filter(reduce(Column.__and__, meets, F.lit(True))).select("file").collect()]


def read_clustered(spark: SparkSession, path: str, ranges: dict[str, tuple] | None = None) -> DataFrame:
    """The rows inside the ranges; files that can't hold any are not read."""
    whole = spark.read.parquet(f"{path.rstrip('/')}/data")
    if not ranges:
        return whole
    found = files_of(spark, path, ranges)
    if not found:
        return whole.limit(0)
    inside = [F.col(c).between(F.lit(lo), F.lit(hi)) for c, (lo, hi) in ranges.items()]
    return spark.read.schema(whole.schema).parquet(*found).filter(reduce(Column.__and__, inside))
