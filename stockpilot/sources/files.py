"""File sources and sinks: typed CSV scan, ingest timestamp, table writes
with comments, presence check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockpilot.sources.schemas import SCHEMAS


def read_csv(spark: SparkSession, path: str, table: str, ingest_ts: bool = True) -> DataFrame:
    """Raw scan of one table's CSV files: header row, UTF-8 (a byte-order
    mark is dropped from the first header), declared schema -- no
    inference pass over the data -- and PERMISSIVE mode so malformed values
    become NULL for the quality rules to judge."""
    df = (
        spark.read.schema(SCHEMAS[table])
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8")
        .option("enforceSchema", True)
        .csv(path)
    )
    return df.withColumn("_ingested_at", F.current_timestamp()) if ingest_ts else df


REJECTS = "table_name string, source_file string, block_start bigint, reason string, record string"
_RECORD = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, table: str, ingest_ts: bool = True) -> tuple[DataFrame, DataFrame]:
    """``read_csv`` for files that may hold bad rows: the rows that parse, and
    the rejects -- rows with too few or too many fields or a value that its
    column's type does not take -- whole, with their file, the start of the
    file block that they were read in, and the reason (SHORT, LONG, MISTYPED).
    Every row of the files is in exactly one of the two."""
    schema = SCHEMAS[table]
    df = (
        spark.read.schema(StructType([*schema.fields]).add(_RECORD, "string"))
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _RECORD)
        .option("escape", "\"")  # a quote inside quotes is doubled
        .option("columnPruning", False)  # a row is judged by all its fields, whatever a query reads
        .option("encoding", "UTF-8")
        .option("enforceSchema", True)
        .csv(path)
    )
    names = schema.fieldNames()
    rows = df.select(*names, _RECORD, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    # always true: a query of the record alone is not allowed, so the filters name all columns
    read = F.pmod(F.xxhash64(*names), F.lit(2)) < 2
    good = rows.filter(F.col(_RECORD).isNull() & read).select(*names)
    # fields of the record: separators outside quotes, and one
    plain = F.regexp_replace(_RECORD, '"([^"]|"")*"', "")
    fields = F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1
    reason = F.when(fields < len(names), "SHORT").when(fields > len(names), "LONG").otherwise("MISTYPED")
    rejects = rows.filter(F.col(_RECORD).isNotNull() & read).select(
        F.lit(table).alias("table_name"), F.col("_file").alias("source_file"), F.col("_start").cast("bigint").alias("block_start"),
        reason.alias("reason"), F.col(_RECORD).alias("record"),
    )
    return (good.withColumn("_ingested_at", F.current_timestamp()) if ingest_ts else good), rejects


def csv_rejects(spark: SparkSession, root: str, tables=tuple(SCHEMAS)) -> DataFrame:
    """The rejects of all tables' CSV files below ``root``."""
    from functools import reduce

    parts = [read_csv_checked(spark, f"{root.rstrip('/')}/{t}.csv", t)[1] for t in tables]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], REJECTS))


def read_raw_csv(spark: SparkSession, root: str, tables=tuple(SCHEMAS), ingest_ts: bool = False) -> dict[str, DataFrame]:
    """All raw tables from ``root/<table>.csv`` (files or folders)."""
    return {t: read_csv(spark, f"{root.rstrip('/')}/{t}.csv", t, ingest_ts) for t in tables}


def with_comments(df: DataFrame, column_comments: dict[str, str]) -> DataFrame:
    """Attach column comments as field metadata (travels with the schema)."""
    cols = []
    for f in df.schema.fields:
        if f.name in column_comments:
            cols.append(F.col(f.name).alias(f.name, metadata={**(f.metadata or {}), "comment": column_comments[f.name]}))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_table(
    df: DataFrame,
    target: str,
    comment: str | None = None,
    column_comments: dict[str, str] | None = None,
    mode: str = "overwrite",
    partition_by: list[str] | None = None,
) -> None:
    """Materialise a table.  ``target`` containing '/' is a Parquet path, which
    keeps column comments in its schema and the table comment as text in the
    folder ``_comment`` beside the data (readers skip it); otherwise a catalog
    table, whose comments are set with SQL DDL.
    Writes never sort the whole table (ordering is a read-time concern)."""
    out = with_comments(df, column_comments or {})
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in target:
        w.parquet(target)
        if comment is not None:
            note = df.sparkSession.createDataFrame([(comment,)], "value string")
            note.coalesce(1).write.mode("overwrite").text(f"{target.rstrip('/')}/_comment")
        return
    w.saveAsTable(target)
    spark = df.sparkSession
    if comment is not None:
        spark.sql(f"COMMENT ON TABLE {target} IS '{comment.replace(chr(39), chr(39) * 2)}'")
    for col, text in (column_comments or {}).items():
        spark.sql(f"ALTER TABLE {target} ALTER COLUMN {col} COMMENT '{text.replace(chr(39), chr(39) * 2)}'")


def column_comments(df: DataFrame) -> dict[str, str]:
    return {f.name: f.metadata["comment"] for f in df.schema.fields if f.metadata and "comment" in f.metadata}


def table_comment(spark: SparkSession, path: str) -> str:
    """The table comment of a Parquet path written by ``write_table``."""
    return spark.read.text(f"{path.rstrip('/')}/_comment").first()[0]


def missing_tables(spark: SparkSession, names: list[str]) -> list[str]:
    """Required-table check: names absent from the catalog."""
    return [n for n in names if not spark.catalog.tableExists(n)]
