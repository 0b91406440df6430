"""Domain context: raw and cleansed tables for one data directory.

The context memoises DataFrame objects so that a plan which uses the same
cleansed table twice refers to one logical subtree.  A domain built from
the driver tables can also write each cleansed table on first use (Parquet
in the shared ``spark.checkpoint.dir``): the mapping from the driver tables
then runs once per table and session instead of once per plan branch, and
every mart plan starts from a pruned Parquet scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stockpilot.operators.cleanse import clean_all
from stockpilot.params import DEFAULT, Params
from stockpilot.sources.driver import domain_tables


class Domain:
    def __init__(
        self,
        raw: dict[str, DataFrame],
        params: Params = DEFAULT,
        spark: SparkSession | None = None,
        checkpoint_clean: bool = False,
    ):
        self.raw = raw
        self.p = params
        self._marts: dict[str, DataFrame] = {}
        self._spark = spark
        self.sf_dir: str | None = None
        self.checkpoint_clean = checkpoint_clean
        self._checkpointed: dict[str, DataFrame] = {}
        self.observations: dict = {}

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = self.raw[next(iter(self.raw))].sparkSession
        return self._spark

    @classmethod
    def from_driver(
        cls, spark: SparkSession, sf_dir: str, params: Params = DEFAULT, checkpoint_clean: bool = False
    ) -> "Domain":
        dom = cls(domain_tables(spark, sf_dir, params), params, spark, checkpoint_clean)
        dom.sf_dir = sf_dir
        return dom

    @cached_property
    def clean(self) -> dict[str, DataFrame]:
        # rule counters ride along only when tables are checkpointed: the
        # checkpoint job computes each whole table once, so the counters
        # cost no extra scan and block no predicate pushdown of a mart
        return clean_all(self.raw, self.p, self.observations if self.checkpoint_clean else None)

    def warn_counts(self) -> dict[str, dict]:
        """Rule failure counts (drop and warn rules, over the rows before
        dropping) of the cleansed tables computed so far in this session."""
        done = set(self._checkpointed)
        if "lead_times_base" in done:  # the history's counters live on its base
            done.add("lead_times")
        # only tables whose job has run: Observation.get waits for one
        return {table: obs.get for table, obs in self.observations.items() if table in done}

    def __getitem__(self, table: str) -> DataFrame:
        if not self.checkpoint_clean:
            return self.clean[table]
        if table not in self._checkpointed:
            from stockpilot.session import scratch_path

            # a written table: later reads keep column pruning, filters and statistics
            path, df = scratch_path(self.spark, f"clean-{table}"), self.clean[table]
            df.write.parquet(path)
            self._checkpointed[table] = self.spark.read.schema(df.schema).parquet(path)
        return self._checkpointed[table]

    def mart(self, name: str) -> DataFrame:
        """Memoised mart by registry name (marts feed other marts)."""
        if name not in self._marts:
            from stockpilot.plans.marts import MART_BUILDERS

            self._marts[name] = MART_BUILDERS[name](self)
        return self._marts[name]
