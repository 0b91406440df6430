"""Decision tables per component, kept up to date from changed rows.

A table whose rows of a component depend on that component's source rows only
(ledger, projection, breaches, options) is stored by hash bucket of the
component.  An update takes the components that changed, computes the table
over their source rows alone and rewrites the buckets that they fall in; the
other buckets are not read.

The ledger goes further.  A change at some event of a component leaves the
balances before it as they are, so only the events from the first changed one
on are computed, beginning with the stored balance before it (the prefix sum
that the change propagates to).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpilot.functions.columns import EV_ON_HAND
from stockpilot.operators import ledger
from stockpilot.params import Params
from stockpilot.plans.context import Domain
from stockpilot.sources.buckets import BucketFolders
from stockpilot.sources.driver import LazyTables

#: The component's column of each table that can be kept up to date.
KEYS = {"mart_timeline": "item_id", "mart_projection": "item_id", "mart_breach": "item_id", "mart_options": "component_id", "mart_order_risk": "component_id"}
#: Source tables with rows of their own for a component, and the date that orders them in the ledger.
BY_COMPONENT = {
    "components": None, "inventory_current": None, "free_inventory": None, "sales_orders": "requested_delivery_date",
    "purchase_orders": "expected_delivery_date", "demand_plan_components": "requested_date", "bom": None,
}


def changed_points(changes: dict[str, DataFrame], bom: DataFrame) -> DataFrame:
    """item, whole, day: the components that changed rows concern.  ``changes``:
    by cleansed table the rows that were added, removed or rewritten (both
    versions).  ``bom``: the old and new recipe rows, through which a changed
    forecast concerns components.  ``day`` is the first day of a changed order
    (null: an order without a day, which stands first); ``whole`` says that the
    component's ledger changed from its beginning."""
    points = []
    for table, rows in changes.items():
        if table == "forecasts":
            used = bom.join(rows.select("product_id").distinct(), "product_id", "left_semi")
            points.append(used.select(F.col("component_id").alias("item"), F.lit(False).alias("whole"), F.lit("9999-12-31").cast("date").alias("day")))
            continue
        day = BY_COMPONENT[table]
        in_ledger = table in ("sales_orders", "purchase_orders")
        points.append(rows.select(
            F.col("component_id").alias("item"), F.lit(table == "inventory_current").alias("whole"),
            (F.col(day) if in_ledger else F.lit("9999-12-31").cast("date")).alias("day"),
        ))
    every = reduce(DataFrame.unionByName, points)
    first = F.min(F.struct(F.col("day").isNotNull().alias("known"), "day")).getField("day")
    return every.groupBy("item").agg(F.max("whole").alias("whole"), first.alias("day"))


class OnlyComponents:
    """A domain's cleansed tables, without the rows of other components."""

    def __init__(self, dom: Domain, items: DataFrame):
        self.dom, self.items, self.p, self.spark = dom, items.select("item").distinct(), dom.p, dom.spark

    def table(self, name: str) -> DataFrame:
        rows = self.dom[name]
        if name in BY_COMPONENT:
            # null-safe: rows without a component are a group like others
            return rows.join(self.items, rows["component_id"].eqNullSafe(self.items["item"]), "left_semi")
        if name == "forecasts":
            return rows.join(self.table("bom").select("product_id").distinct(), "product_id", "left_semi")
        return rows

    def domain(self) -> Domain:
        names = list(self.dom.clean.keys())
        only = Domain(self.dom.raw, self.p, self.spark)
        only.__dict__["clean"] = LazyTables({t: (lambda t=t: self.table(t)) for t in names})
        return only


class IncrementalMart(BucketFolders):
    """One of KEYS, stored below ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str, name: str, buckets: int = 64):
        super().__init__(spark, f"{root.rstrip('/')}/{name}", buckets)
        self.name, self.key = name, KEYS[name]

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The published rows (of some buckets)."""
        state = self._newest(before)
        if not state:
            raise ValueError(f"{self.name} has not been stored")
        wanted = state if buckets is None else {b: state[b] for b in buckets if b in state}
        paths = [p for p in wanted.values() if p]
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def store(self, dom: Domain, epoch: int = 0) -> None:
        """Compute and store the whole table."""
        rows = dom.mart(self.name)
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/schema")
        self._write(rows, [self.key], epoch, list(range(self.buckets)))

    def update(self, dom: Domain, points: DataFrame, epoch: int) -> None:
        """``dom``: the domain with the changes; ``points``: ``changed_points``.
        An epoch that is published already is not applied again."""
        if self._has(epoch):
            return
        points = points.checkpoint()  # read several times
        touched = sorted(r[0] for r in points.select(self._bucket("item")).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            self._write(self.read([]), [self.key], epoch, [])
            return
        old = self.read(touched, before=epoch)
        columns = old.columns
        same = old[self.key].eqNullSafe(points["item"])
        others = old.join(points, same, "left_anti")
        if self.name == "mart_timeline":
            mine = old.join(points, same).select(*columns, "whole", "day")
            before = mine.filter(F.expr(BEFORE)).select(*columns)
            fresh = before.unionByName(self._tail(dom, points, before)).select(*columns)
        else:
            fresh = OnlyComponents(dom, points).domain().mart(self.name).select(*columns)
        self._write(others.unionByName(fresh), [self.key], epoch, touched)

    def _tail(self, dom: Domain, points: DataFrame, before: DataFrame) -> DataFrame:
        """The ledger from the first changed event of each component on."""
        p: Params = dom.p
        only = OnlyComponents(dom, points)
        ev = ledger.events(only.table("inventory_current"), only.table("sales_orders"), only.table("purchase_orders"), p)
        ev = ev.join(points, ev["item_id"].eqNullSafe(points["item"])).filter(~F.expr(BEFORE)).select(*ev.columns)
        start = before.groupBy("item_id").agg(F.sum("quantity").cast("bigint").alias("quantity")).filter(F.col("quantity").isNotNull())
        # an event of its own before all others carries the stored balance
        start = start.select(
            "item_id", F.lit(None).cast("date").alias("event_date"), F.lit("").alias("event_type"), F.lit("").alias("order_no"), "quantity",
            F.lit(False).alias("production_use_flag"), F.lit(False).alias("inbound_flag"), F.lit(-1).alias("event_seq"),
        )
        return ledger.with_balance(ev.unionByName(start), p).filter(F.col("event_type") != "")


#: Whether a ledger event stands before the first changed one: the stock on hand comes first, then the orders by
#: day, those without a day before the others.
BEFORE = f"NOT whole AND (event_type = '{EV_ON_HAND}' OR (day IS NOT NULL AND (event_date IS NULL OR event_date < day)))"
