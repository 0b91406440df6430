"""Incremental file ingest with Structured Streaming.

``stream_ingest`` reads new files of a source folder with the file source,
applies the typed projection and the drop rules per micro-batch in
``foreachBatch``, and appends the kept rows to a Parquet sink.  The
checkpoint makes the ingest restartable and exactly-once per file; with
``availableNow`` it processes what is there and stops (batch-equivalent).
Locations default to the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stockpilot.operators.quality import Rule, keep, typed
from stockpilot.streaming.upsert import EVENT_RULES, is_single_file


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint location
    (``spark.checkpoint.dir``; only when that is unset, as in local tests,
    a scratch folder is set up)."""
    from stockpilot.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream_ingest(
    spark: SparkSession,
    source: str,
    schema: StructType,
    rules: list[Rule],
    sink: str | None = None,
    checkpoint: str | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    glob: str | None = None,
) -> str:
    """Runs the ingest to completion (availableNow) and returns the sink path."""
    sink = sink or shared_dir(spark, "ingest-sink")
    checkpoint = checkpoint or shared_dir(spark, "ingest-ckpt")
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.load(source)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        # one folder per micro-batch, overwritten on replay: idempotent, so
        # a batch re-run after a lost executor or driver restart adds no
        # duplicates
        kept = keep(typed(batch, schema), rules)
        kept.write.mode("overwrite").parquet(f"{sink}/_batch_id={epoch_id}")

    q = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return sink


def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream the driver's event file through the rules into a sink and
    return the ingested rows (batch read of the sink)."""
    folder = sf_dir.rstrip("/")
    path = f"{folder}/events.parquet"
    events = spark.read.parquet(path)
    if is_single_file(events, "events.parquet"):  # stream its folder, filtered to that file name
        sink = stream_ingest(spark, folder, events.schema, EVENT_RULES, glob="events.parquet")
    else:  # a folder of part files: stream the folder
        sink = stream_ingest(spark, path, events.schema, EVENT_RULES)
    return spark.read.parquet(sink).drop("_batch_id")
