"""Stored table graph: a refresh computes each raw, cleansed and decision table
once, stores it, and whatever reads it reads the stored rows.

The graph is not declared.  A builder asks its domain for the tables that it
reads; the domain of a run stores such a table first if the run has not done so
and answers with the stored rows.  Tables are so computed in topological order,
independent ones concurrently, and the reads that were asked for are the graph.

A table is written to a folder of its run.  When all are written, one append of
one file to ``manifest`` publishes the run: readers follow the newest published
run, and a run that fails or is lost publishes nothing, so the tables before it
stay as they are.  A table whose code, parameters and sources (files by path,
size and time) are those of the published one is not computed again: the new
manifest names the old folder.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import stockpilot
from stockpilot.operators.cleanse import clean_all
from stockpilot.params import DEFAULT, Params
from stockpilot.plans.context import Domain
from stockpilot.sources.driver import LazyTables
from stockpilot.sources.files import write_table


class Node(NamedTuple):
    """A stored table: its folder, the tables that its builder read, and the stamp of all that it depends on."""

    name: str
    path: str
    reads: tuple[str, ...]
    stamp: str


def _stamp(*parts) -> str:
    return hashlib.sha256("\n".join(map(str, parts)).encode()).hexdigest()


def code_stamp() -> str:
    """Changes when a module of the library changes (the text operators are no part of the graph)."""
    top = os.path.dirname(os.path.abspath(stockpilot.__file__))
    h = hashlib.sha256()
    for folder, folders, names in os.walk(top):
        folders[:] = sorted(f for f in folders if f not in ("llm", "__pycache__"))
        for name in sorted(n for n in names if n.endswith(".py")):
            h.update(name.encode())
            with open(os.path.join(folder, name), "rb") as f:
                h.update(f.read())
    return h.hexdigest()


def source_stamps(spark: SparkSession, folder: str) -> dict[str, str]:
    """One stamp per table of a data folder, from its files' paths, sizes and
    times (a listing; no content is read, one row per table is collected)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    table = F.regexp_extract("path", r"/([A-Za-z_0-9]+)\.parquet(/|$)", 1)
    per = files.select(table.alias("t"), "length", F.xxhash64("path", "modificationTime", "length").alias("h"))
    return {r.t: _stamp(r.n, r.size, r.h) for r in per.groupBy("t").agg(F.count("*").alias("n"), F.sum("length").alias("size"), F.expr("bit_xor(h)").alias("h")).collect()}


class MartStore:
    """The published tables below ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str, params: Params = DEFAULT):
        self.spark, self.root, self.params = spark, root.rstrip("/"), params

    def _manifest(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/manifest").filter(F.col("params") == repr(self.params))
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def published(self) -> dict[str, Node]:
        """The tables of the newest published run with these parameters."""
        manifest = self._manifest()
        newest = manifest and manifest.agg(F.max_by("run", F.struct("seq", "run"))).first()[0]
        if not newest:
            return {}
        return {r.name: Node(r.name, r.path, tuple(r.reads), r.stamp) for r in manifest.filter(F.col("run") == newest).collect()}

    def publish(self, run: str, nodes: dict[str, Node]) -> None:
        manifest = self._manifest()
        seq = 1 + (manifest and manifest.agg(F.max("seq")).first()[0] or 0)
        rows = [(repr(self.params), seq, run, n.name, n.path, list(n.reads), n.stamp) for n in nodes.values()]
        schema = "params string, seq bigint, run string, name string, path string, reads array<string>, stamp string"
        # one file: it is there as a whole or not at all
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def domain(self) -> Domain:
        """A domain whose raw, cleansed and decision tables are the published
        rows; decision tables that are not published are built over them."""
        nodes = self.published()
        read = lambda n: lambda: self.spark.read.parquet(n.path)
        layer = lambda head: LazyTables({k.removeprefix(head): read(n) for k, n in nodes.items() if k.startswith(head)})
        dom = Domain(layer("raw/"), self.params, self.spark)
        dom.__dict__["clean"] = layer("clean/")
        dom._marts = LazyTables({k: read(n) for k, n in nodes.items() if "/" not in k})
        return dom


class _Tracked(LazyTables):
    """Tables of a layer; every access goes through ``get`` (a name, its builder)."""

    def __init__(self, builders: dict, get: Callable[[str, Callable], DataFrame]):
        super().__init__(builders)
        self._get = get

    def __getitem__(self, key):
        return self._get(key, self._builders[key])


class RunDomain(Domain):
    """The domain of one run: each table that is asked for is stored first, once."""

    def __init__(self, base: Domain, store: MartStore, comments: Callable[[str], dict] = lambda name: {}):
        super().__init__({}, base.p, base.spark)
        self.sf_dir = base.sf_dir
        self.run = uuid.uuid4().hex
        self.store, self._comments = store, comments
        self._previous = store.published()
        self._code = code_stamp()
        self._sources = source_stamps(base.spark, base.sf_dir) if base.sf_dir else {}
        self._lock, self._here = threading.Lock(), threading.local()
        self._nodes: dict[str, Future] = {}
        self.computed: list[str] = []
        self.raw = _Tracked({t: (lambda t=t: base.raw[t]) for t in base.raw.keys()}, lambda t, b: self._read(f"raw/{t}", b))
        tables = lambda builders: _Tracked(builders, lambda t, b: self._read(f"clean/{t}", b))
        self.__dict__["clean"] = clean_all(self.raw, self.p, tables=tables)

    def mart(self, name: str) -> DataFrame:
        from stockpilot.plans.marts import MART_BUILDERS

        return self._read(name, lambda: MART_BUILDERS[name](self))

    def table(self, name: str, build: Callable[[Domain], DataFrame]) -> Node:
        """Store a registered query's rows (a decision table is stored under its own name only)."""
        from stockpilot.plans.marts import MART_BUILDERS

        return self._node(name, lambda: MART_BUILDERS[name](self) if name in MART_BUILDERS else build(self))

    def _read(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        node = self._node(name, build)
        reads = getattr(self._here, "reads", None)
        if reads is not None:
            reads.add(name)
        return self.spark.read.parquet(node.path)

    def _node(self, name: str, build: Callable[[], DataFrame]) -> Node:
        with self._lock:
            mine = name not in self._nodes
            future = self._nodes.setdefault(name, Future())
        if mine:
            outer, self._here.reads = getattr(self._here, "reads", None), set()
            try:
                future.set_result(self._reused(name) or self._computed(name, build))
            except BaseException as e:
                future.set_exception(e)
            finally:
                self._here.reads = outer
        return future.result()

    def _stamp_of(self, name: str, reads) -> str:
        # a query that asks for no table reads the data folder itself
        on = [f"{r}={self._nodes[r].result().stamp}" for r in sorted(reads)] or [f"{t}={s}" for t, s in sorted(self._sources.items())] or [self.run]
        return _stamp(name, self._code, repr(self.p), *on)

    def _raw_stamp(self, name: str, df: DataFrame) -> str:
        """A raw table depends on the files that it reads; one that reads none (rows of a program) on its run."""
        import re

        used = {m[1] for f in df.inputFiles() if (m := re.search(r"/([A-Za-z_0-9]+)\.parquet(/|$)", f))}
        known = used and used <= self._sources.keys()
        return _stamp(name, self._code, repr(self.p), *([f"{t}={self._sources[t]}" for t in sorted(used)] if known else [self.run]))

    def _reused(self, name: str) -> Node | None:
        """The published table, if everything that it depends on is as it was."""
        old = self._previous.get(name)
        if old is None:
            return None
        if name.startswith("raw/"):
            return old if self.raw._builders.get(name[4:]) and self._raw_stamp(name, self.raw._builders[name[4:]]()) == old.stamp else None
        for r in old.reads:  # these are settled first
            self._settle(r)
        return old if self._stamp_of(name, old.reads) == old.stamp else None

    def _settle(self, name: str) -> None:
        layer, _, table = name.rpartition("/")
        if layer == "raw":
            self._node(name, self.raw._builders[table])
        elif layer == "clean":
            self._node(name, self.clean._builders[table])
        else:
            from stockpilot.plans.marts import MART_BUILDERS

            self._node(name, lambda: MART_BUILDERS[name](self))

    def _computed(self, name: str, build: Callable[[], DataFrame]) -> Node:
        df = build()
        reads = tuple(sorted(self._here.reads))
        stamp = self._raw_stamp(name, df) if name.startswith("raw/") else self._stamp_of(name, reads)
        path = f"{self.store.root}/runs/{self.run}/{name}"
        write_table(df, path, **self._comments(name))
        with self._lock:
            self.computed.append(name)
        return Node(name, path, reads, stamp)

    def nodes(self) -> dict[str, Node]:
        return {k: f.result() for k, f in self._nodes.items()}


def refresh(
    base: Domain,
    store: MartStore,
    queries: dict[str, Callable[[Domain], DataFrame]],
    comments: Callable[[str], dict] = lambda name: {},
    workers: int = 6,
) -> RunDomain:
    """Store the raw and cleansed tables, the decision tables that the queries
    read and the queries' rows, and publish them together.  An error leaves the
    published tables as they are."""
    run = RunDomain(base, store, comments)
    steps = [lambda t=t: run._settle(f"raw/{t}") for t in run.raw.keys()]
    steps += [lambda t=t: run._settle(f"clean/{t}") for t in run.clean.keys()]
    steps += [lambda n=n, q=q: run.table(n, q) for n, q in queries.items()]
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        done = [pool.submit(s) for s in steps]
        try:
            for f in done:
                f.result()
        except BaseException:
            pool.shutdown(wait=True, cancel_futures=True)
            raise
    store.publish(run.run, run.nodes())
    return run
