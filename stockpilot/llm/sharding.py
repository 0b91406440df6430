"""Sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters the records uniformly, by a seeded hash, into buckets that
fit in a task's memory.  Pass two applies a seeded Fisher-Yates shuffle (the
built-in ``shuffle``) to each bucket and writes it.  Buckets laid end to end
form one random order of the corpus; it is cut into shards whose row counts
differ by at most one.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stockpilot.session import scratch_path

SHARDS = 24
SEED = 20240229
#: Text bytes of a bucket; one task holds one bucket.
BUCKET_BYTES = 16 << 20
#: Buckets whose offsets (16 bytes each) may be broadcast; beyond, they are joined.
BROADCAST_BUCKETS = 1 << 19


def write_shards(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write doc_id, size, text, slot as Parquet below ``path``, one folder per
    shard, and return the table read back with its column ``shard``.

    Size is the text's UTF-8 bytes (null: none) plus 8.  Every row goes to one
    shard, rows with a null id or text and repeated rows included; slots run
    from 0 without gaps.  The order depends on seed and rows alone.  An empty
    table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8)
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = max(1, math.ceil(total / bucket_bytes))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))

    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    if buckets <= BROADCAST_BUCKETS:
        offsets = F.broadcast(offsets)

    record = F.struct("h", "doc_id", "size", "text")
    whole = rows.repartitionById(buckets, F.col("bucket")).groupBy("bucket")
    whole = whole.agg(F.shuffle(F.sort_array(F.collect_list(record)), seed).alias("records"))
    placed = whole.join(offsets, "bucket").select("first", F.posexplode("records").alias("pos", "r"))
    placed = placed.select(F.expr("first + pos").alias("g"), "r.doc_id", "r.size", "r.text")

    least, more = divmod(n, shards)  # the first `more` shards take one row more
    head, rest = more * (least + 1), max(least, 1)
    in_head = F.col("g") < head
    shard = F.when(in_head, F.expr(f"g div {least + 1}")).otherwise(F.expr(f"{more} + (g - {head}) div {rest}"))
    slot = F.when(in_head, F.col("g") % (least + 1)).otherwise((F.col("g") - head) % rest)
    out = placed.select("doc_id", "size", "text", slot.alias("slot"), shard.cast("int").alias("shard"))
    out.write.partitionBy("shard").parquet(path)
    kinds = (("doc_id", T.LongType()), ("size", T.LongType()), ("text", T.StringType()), ("slot", T.LongType()))
    schema = T.StructType([T.StructField(k, t) for k, t in (*kinds, ("shard", T.IntegerType()))])
    return spark.read.schema(schema).parquet(path)


def op6_shard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = write_shards(docs, scratch_path(spark, "shards"))
    return shards.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
