"""Incremental ingest into keyed tables.

A ``KeyedTable`` takes micro-batches in any split and order and always equals
the batch result over all rows so far.  Rows are dealt over hash buckets of the
key; a batch rewrites only the buckets that it touches.  Which row of a key
stays is decided by a rule that does not depend on arrival:

* ``SMALLEST``: the smallest row by its other columns (the cleansing layer's
  deduplication of master tables);
* ``LATEST``: the row of the latest event time, of equal times the greatest
  row; a late row loses against a newer stored one;
* ``ALL``: every row stays (tables without a key), so batches only add files.

Every batch writes folders of its own and then publishes them by one append of
one file to ``manifest``.  A batch that is replayed after its publication does
nothing; one that was lost before it is computed again from the state before
it, over the same folders.  Readers see published batches only.

Stored rows carry the names of the drop rules that they fail, so the cleansed
rows and the quarantine are filters on one scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockpilot.operators.cleanse import clean_all
from stockpilot.operators.quality import DROP, Rule, rules_for, typed
from stockpilot.params import DEFAULT, Params
from stockpilot.plans.context import Domain
from stockpilot.sources.buckets import BucketFolders
from stockpilot.sources.driver import LazyTables
from stockpilot.sources.schemas import MASTER_KEYS, SCHEMAS

SMALLEST, LATEST, ALL = "smallest", "latest", "all"
FAILED = "_failed_rules"


class KeyedTable(BucketFolders):
    """A stored table below ``root`` (a folder that driver and executors share)."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: StructType,
        key: list[str] | None = None,
        keep: str = ALL,
        time_col: str | None = None,
        rules: list[Rule] | None = None,
        buckets: int = 64,
    ):
        if (keep == ALL) != (not key) or (keep == LATEST) != (time_col is not None):
            raise ValueError("ALL takes no key, the other rules one; LATEST also the column of the event time")
        super().__init__(spark, root, buckets)
        self.schema, self.key, self.keep, self.time_col = schema, list(key or []), keep, time_col
        self.drops = [r for r in rules or [] if r.action == DROP]

    # -- state ---------------------------------------------------------------

    def _paths(self, before: int | None = None) -> dict[int, list[str]]:
        """The folders of each bucket (by ALL: of each epoch, under bucket 0)."""
        if self.keep == ALL:
            rows = self._published().distinct().orderBy("epoch").collect()
            return {0: [r.path for r in rows]} if rows else {}
        return {b: [path] for b, path in self._newest(before).items()}

    def _read(self, paths: list[str]) -> DataFrame:
        stored = StructType([*self.schema.fields]).add(FAILED, "string")
        return self.spark.read.schema(stored).parquet(*paths) if paths else self.spark.createDataFrame([], stored)

    def stored(self) -> DataFrame:
        """The published rows with the rules that they fail."""
        return self._read([p for ps in self._paths().values() for p in ps])

    def rows(self) -> DataFrame:
        """All published rows, before the drop rules."""
        return self.stored().drop(FAILED)

    def clean(self) -> DataFrame:
        return self.stored().filter(F.col(FAILED).isNull()).drop(FAILED)

    def quarantine(self) -> DataFrame:
        return self.stored().filter(F.col(FAILED).isNotNull()).withColumnRenamed(FAILED, "failed_rules")

    # -- batches ---------------------------------------------------------------

    def _winners(self, rows: DataFrame) -> DataFrame:
        """One row per key, by a partial aggregate: a key with many rows is reduced before the shuffle."""
        others = [c for c in self.schema.fieldNames() if c not in self.key]
        if self.keep == SMALLEST:
            best = F.min(F.struct(*others)).alias("r")
        else:  # a null time is the earliest; of equal times the greatest row
            best = F.max(F.struct(F.col(self.time_col).alias("t"), F.struct(*others).alias("v"))).getField("v").alias("r")
        picked = rows.groupBy(*self.key).agg(best)
        return picked.select(*self.key, *(F.col("r")[c].alias(c) for c in others)).select(*self.schema.fieldNames())

    def _judged(self, rows: DataFrame) -> DataFrame:
        failed = F.concat_ws(",", *[F.when(~r.passed(), F.lit(r.name)) for r in self.drops]) if self.drops else F.lit("")
        return rows.withColumn(FAILED, F.nullif(failed, F.lit("")))

    def merge(self, batch: DataFrame, epoch: int) -> None:
        """Take one micro-batch (the body of a ``foreachBatch``)."""
        names = self.schema.fieldNames()
        if self._has(epoch):
            return  # a replay of a published batch
        batch = typed(batch, self.schema).select(*names)
        folder = f"{self.root}/data/epoch={epoch}"
        if self.keep == ALL:
            self._judged(batch).write.mode("overwrite").parquet(folder)
            self._publish([(epoch, 0, folder)])
            return
        # the batch's winners first, written, so that its plan runs once
        incoming = f"{self.root}/incoming/epoch={epoch}"
        self._winners(batch).withColumn("_bucket", self._bucket(*self.key)).write.mode("overwrite").parquet(incoming)
        fresh = self.spark.read.parquet(incoming)
        touched = sorted(r[0] for r in fresh.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
        state = self._paths(before=epoch)
        old = self._read([p for b in touched for p in state.get(b, [])]).drop(FAILED)
        self._write(self._judged(self._winners(old.unionByName(fresh.drop("_bucket")))), self.key, epoch, touched)

    def ingest(self, source: str, fmt: str = "parquet", files_per_batch: int | None = None, glob: str | None = None, options: dict | None = None) -> None:
        """Take the new files of a folder as a stream and stop (``availableNow``);
        a later call goes on where this one ended."""
        reader = self.spark.readStream.schema(self.schema).format(fmt).options(**(options or {}))
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        query = (
            reader.load(source).writeStream.foreachBatch(self.merge)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def domain_table(spark: SparkSession, root: str, table: str, buckets: int = 64) -> KeyedTable:
    """One of the seventeen tables: master tables keep the smallest row of a key, the others all rows."""
    key = [MASTER_KEYS[table]] if table in MASTER_KEYS else None
    return KeyedTable(spark, f"{root.rstrip('/')}/{table}", SCHEMAS[table], key, SMALLEST if key else ALL, None, rules_for(table), buckets)


def ingested_domain(spark: SparkSession, root: str, params: Params = DEFAULT, buckets: int = 64) -> Domain:
    """A domain over ingested tables: its cleansed tables read the rows that
    passed the rules when they were stored; only derived columns are added."""
    table = lambda t: domain_table(spark, root, t, buckets)
    dom = Domain(LazyTables({t: (lambda t=t: table(t).rows()) for t in SCHEMAS}), params, spark)
    dom.__dict__["clean"] = clean_all(LazyTables({t: (lambda t=t: table(t).clean()) for t in SCHEMAS}), params)
    return dom


# Drop rules for the event stream.
EVENT_RULES = [
    Rule("events", "event_id_not_null", "event_id IS NOT NULL", DROP),
    Rule("events", "ts_not_null", "ts IS NOT NULL", DROP),
]


def latest_events(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The latest event of each (user, event type), kept up to date by a stream
    over the events' files."""
    from stockpilot.session import scratch_path

    folder = sf_dir.rstrip("/")
    events = spark.read.parquet(f"{folder}/events.parquet")
    table = KeyedTable(spark, scratch_path(spark, "latest-events"), events.schema, ["user_id", "event_type"], LATEST, "ts", EVENT_RULES)
    if is_single_file(events, "events.parquet"):  # stream its folder, only that file
        table.ingest(folder, files_per_batch=files_per_batch, glob="events.parquet")
    else:
        table.ingest(f"{folder}/events.parquet", files_per_batch=files_per_batch)
    return table.clean()


def is_single_file(df: DataFrame, name: str) -> bool:
    """Whether a table read from ``.../name`` is that one file, not a folder of part files."""
    files = df.inputFiles()
    return len(files) == 1 and files[0].rstrip("/").rsplit("/", 1)[-1] == name
