"""Adapter: the driver's TPC-H-like parquet tables -> the seventeen domain tables.

The mapping is a specification (see FIXTURES.md section 3); the oracle runs
the same mapping as SQL text in DuckDB.  Here it is written with the
DataFrame API so Catalyst can prune columns and push the status and date
predicates into the lineitem scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockpilot.params import Params
from stockpilot.sources.schemas import SCHEMAS

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


class LazyTables(dict):
    """Mapping whose values are built on first access (DataFrame creation
    analyses the plan, so building all tables up front costs seconds)."""

    def __init__(self, builders: dict):
        super().__init__()
        self._builders = builders

    def __missing__(self, key):
        value = self._builders[key]()
        self[key] = value
        return value

    def __contains__(self, key):
        return key in self._builders

    def keys(self):
        return self._builders.keys()

    def __iter__(self):
        return iter(self._builders)


_READS: dict[tuple, DataFrame] = {}


def read_driver(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> LazyTables:
    """Driver tables, read lazily; one scan DataFrame per (session, file) is
    reused so repeated queries do not list and re-read footers."""

    def reader(n: str):
        def build() -> DataFrame:
            key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"), n)
            if key not in _READS:
                _READS[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
            return _READS[key]

        return build

    return LazyTables({n: reader(n) for n in names})


def forget_reads(prefix: tuple) -> None:
    """Drop the cached scans whose key starts with (session, application, folder)."""
    for key in [k for k in _READS if k[:3] == prefix]:
        del _READS[key]


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _ntz(day: dt.date) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{day.isoformat()} 00:00:00'")


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto the table's schema: declared order, declared types,
    NULL literals for columns the mapping does not produce."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SCHEMAS[table].fields
        ]
    )


class DriverAdapter:
    """Builds each domain table lazily from the driver tables."""

    def __init__(self, t: dict[str, DataFrame], params: Params):
        self.t = t
        self.p = params
        self.T = params.as_of

    # -- the shared line view: lineitem with what a table needs of orders and part
    def line(
        self, lineitem_filter: Column | None = None, orders: bool = True, part: bool = True, customer: bool = False
    ) -> DataFrame:
        """Lines with derived columns.  ``orders``, ``part`` and ``customer``
        join those tables; leave out what no column of the result comes from
        (an inner join is never removed by the optimiser).  Customers join the
        orders, not the lines: a shuffle of the orders is a quarter of one of
        the lines."""
        j = self.t["lineitem"]
        if lineitem_filter is not None:
            j = j.filter(lineitem_filter)
        d = F.col("l_shipdate").cast("date")
        line_id = F.concat_ws("-", _s("l_orderkey"), _s("l_linenumber"), _s("l_partkey"), _s("l_suppkey"), _s(d))
        cols = [
            line_id.alias("line_id"),
            _s("l_partkey").alias("component_id"),
            _s("l_suppkey").alias("supplier_id"),
            d.alias("d"),
            F.col("l_quantity").cast("int").alias("q"),
            "l_partkey",
            "l_suppkey",
            "l_linenumber",
            "l_returnflag",
            "l_linestatus",
            "l_discount",
        ]
        if orders:
            o = self.t["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            if customer:
                c = self.t["customer"].select("c_custkey", "c_nationkey")
                o = o.join(c, F.col("o_custkey") == c.c_custkey)
                cols.append("c_nationkey")
            j = j.join(o, F.col("l_orderkey") == o.o_orderkey)
            cols += [
                _s("o_custkey").alias("customer_id"),
                F.col("o_orderdate").cast("date").alias("od"),
                "o_custkey",
                "o_orderpriority",
            ]
        if part:
            p = self.t["part"].select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
            j = j.join(p, F.col("l_partkey") == p.p_partkey)
            cols += [F.concat(F.col("p_brand"), F.lit("|"), F.col("p_type")).alias("product_id"), "p_size", "p_retailprice"]
        return j.select(*cols)

    # -- masters --------------------------------------------------------------
    def suppliers(self) -> DataFrame:
        s, n, r = self.t["supplier"], self.t["nation"], self.t["region"]
        df = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
        return conform(
            df.select(
                _s("s_suppkey").alias("supplier_id"),
                F.col("s_name").alias("supplier_name"),
                F.col("n_name").alias("country"),
                F.col("r_name").alias("region"),
            ),
            "suppliers",
        )

    def customers(self) -> DataFrame:
        c, n = self.t["customer"], self.t["nation"]
        df = c.join(n, c.c_nationkey == n.n_nationkey)
        return conform(
            df.select(
                _s("c_custkey").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("segment"),
                F.col("n_name").alias("location"),
            ),
            "customers",
        )

    def products(self) -> DataFrame:
        df = self.t["part"].groupBy("p_brand", "p_type").agg(
            F.min("p_partkey").alias("min_key"), F.max("p_retailprice").alias("max_price")
        )
        return conform(
            df.select(
                F.concat("p_brand", F.lit("|"), "p_type").alias("product_id"),
                F.concat("p_type", F.lit(" "), "p_brand").alias("product_name"),
                F.col("p_type").alias("product_category"),
                _s(F.col("min_key") % 100).alias("customer_id"),
                F.round(F.col("max_price") * 100).cast("int").alias("unit_price_jpy"),
            ),
            "products",
        )

    def components(self) -> DataFrame:
        # pre-aggregate lineitem to one row per part before the join
        first_sup = self.t["lineitem"].groupBy("l_partkey").agg(F.min("l_suppkey").alias("min_sup"))
        p = self.t["part"]
        df = p.join(first_sup, p.p_partkey == first_sup.l_partkey, "left")
        size = F.col("p_size")
        return conform(
            df.select(
                _s("p_partkey").alias("component_id"),
                F.concat(F.lit("PN-"), _s("p_partkey")).alias("part_number"),
                F.col("p_name").alias("component_name"),
                F.col("p_type").alias("component_category"),
                _s("min_sup").alias("supplier_id"),
                (1 + size % 30).alias("base_lead_time_weeks"),
                F.col("p_retailprice").alias("unit_price_usd"),
                (1 + size % 8).alias("safety_stock_weeks"),
                (10 * (1 + size % 5)).alias("min_order_qty"),
                (5 + size % 20).alias("min_stock"),
                ((5 + size % 20) * 3).alias("max_stock"),
            ),
            "components",
        )

    def warehouses(self) -> DataFrame:
        n, r = self.t["nation"], self.t["region"]
        df = n.join(r, n.n_regionkey == r.r_regionkey)
        k = F.col("n_nationkey")
        return conform(
            df.select(
                _s(k).alias("warehouse_id"),
                F.col("n_name").alias("warehouse_name"),
                F.col("r_name").alias("prefecture"),
                F.col("n_name").alias("city"),
                (24 + k).cast("double").alias("latitude"),
                (122 + k).cast("double").alias("longitude"),
                (1000 * (1 + k)).alias("capacity_sqm"),
            ),
            "warehouses",
        )

    def bom(self) -> DataFrame:
        p = self.t["part"]
        qpu = (1 + F.col("p_size") % 4).alias("quantity_per_unit")
        own = p.select(
            F.concat("p_brand", F.lit("|"), "p_type").alias("product_id"), _s("p_partkey").alias("component_id"), qpu
        )
        shared = p.select(
            F.concat(F.lit("Brand#"), _s(1 + F.col("p_partkey") % 25), F.lit("|"), "p_type").alias("product_id"),
            _s("p_partkey").alias("component_id"),
            qpu,
        )
        return conform(own.unionByName(shared).distinct(), "bom")

    # -- stock ------------------------------------------------------------------
    def inventory_current(self) -> DataFrame:
        li = self.t["lineitem"].filter(
            (F.col("l_linestatus") == "F") & (F.col("l_shipdate") < _ntz(self.T))
        )
        s = self.t["supplier"].select("s_suppkey", "s_nationkey")
        df = li.join(s, li.l_suppkey == s.s_suppkey).groupBy("l_partkey", "s_nationkey").agg(
            F.sum(F.col("l_quantity").cast("int")).alias("qty"), F.count(F.lit(1)).alias("n")
        )
        return conform(
            df.select(
                F.concat(_s("l_partkey"), F.lit("-"), _s("s_nationkey")).alias("snapshot_id"),
                _s("l_partkey").alias("component_id"),
                _s("s_nationkey").alias("warehouse_id"),
                F.trunc(F.lit(self.T), "MM").alias("snapshot_month"),
                F.col("qty").alias("stock_qty"),
                F.lit(2).alias("safety_stock_qty"),
                F.lit(0).alias("replenishment_qty"),
                F.col("n").alias("demand_qty"),
            ),
            "inventory_current",
        )

    def inventory(self) -> DataFrame:
        shipped = (F.col("l_linestatus") == "F") & (F.col("l_shipdate") < _ntz(self.T))
        line = self.line(shipped, orders=False, part=False)
        s = self.t["supplier"].select("s_suppkey", "s_nationkey")
        line = line.withColumn("mon", F.trunc("d", "MM"))
        df = line.join(s, line.l_suppkey == s.s_suppkey).groupBy("component_id", "s_nationkey", "mon").agg(
            F.sum("q").alias("qty")
        )
        return conform(
            df.select(
                F.concat("component_id", F.lit("-"), _s("s_nationkey"), F.lit("-"), _s("mon")).alias("snapshot_id"),
                "component_id",
                _s("s_nationkey").alias("warehouse_id"),
                F.col("mon").alias("snapshot_month"),
                F.col("qty").alias("stock_qty"),
                F.lit(2).alias("safety_stock_qty"),
                F.lit(0).alias("replenishment_qty"),
                F.col("qty").alias("demand_qty"),
            ),
            "inventory",
        )

    def warehouse_components(self) -> DataFrame:
        ic = self.inventory_current()
        return conform(
            ic.select(
                "component_id",
                "warehouse_id",
                (F.col("warehouse_id").cast("int") % 2 == 0).alias("is_primary"),
                F.lit(0.5).alias("allocation_pct"),
            ),
            "warehouse_components",
        )

    def shipment_routes(self) -> DataFrame:
        s = self.t["supplier"]
        inbound = s.select(
            F.lit("inbound").alias("route_type"),
            _s("s_suppkey").alias("from_id"),
            F.col("s_name").alias("from_name"),
            (24 + F.col("s_nationkey")).cast("double").alias("from_lat"),
            (122 + F.col("s_nationkey")).cast("double").alias("from_lon"),
            F.lit("0").alias("to_id"),
            F.lit("HUB").alias("to_name"),
            F.lit(24.0).alias("to_lat"),
            F.lit(122.0).alias("to_lon"),
            (1 + F.col("s_suppkey") % 14).cast("int").alias("avg_transit_days"),
            (5 + F.col("s_suppkey") % 25).cast("int").alias("monthly_shipments"),
        )
        c = self.t["customer"]
        outbound = c.select(
            F.lit("outbound").alias("route_type"),
            F.lit("0").alias("from_id"),
            F.lit("HUB").alias("from_name"),
            F.lit(24.0).alias("from_lat"),
            F.lit(122.0).alias("from_lon"),
            _s("c_custkey").alias("to_id"),
            F.col("c_name").alias("to_name"),
            (24 + F.col("c_nationkey")).cast("double").alias("to_lat"),
            (122 + F.col("c_nationkey")).cast("double").alias("to_lon"),
            (1 + F.col("c_custkey") % 3).cast("int").alias("avg_transit_days"),
            (10 + F.col("c_custkey") % 40).cast("int").alias("monthly_shipments"),
        )
        return conform(inbound.unionByName(outbound), "shipment_routes")

    # -- plans and history --------------------------------------------------------
    def forecasts(self) -> DataFrame:
        line = self.line(orders=False).withColumn("mon", F.trunc("d", "MM"))
        df = line.groupBy("product_id", "mon").agg(F.sum("q").alias("qty"))
        qty = F.col("qty")
        return conform(
            df.select(
                F.concat("product_id", F.lit("-"), _s("mon")).alias("forecast_id"),
                "product_id",
                F.col("mon").alias("forecast_month"),
                qty.alias("forecast_qty"),
                F.round((50 + qty % 50).cast("double") / 100, 2).alias("forecast_accuracy"),
            ),
            "forecasts",
        )

    def lead_times(self) -> DataFrame:
        # grouped by the key of the join with part, not by its text: the lines are shuffled once
        # and the rows of a component lie in one file
        df = self.line(orders=False).groupBy("l_partkey", "d").agg(
            F.min("l_suppkey").cast("string").alias("supplier_id"), F.max(F.col("q") + F.col("p_size")).alias("lt")
        )
        df = df.withColumn("component_id", _s("l_partkey"))
        return conform(
            df.select(
                F.concat("component_id", F.lit("-"), _s("d")).alias("lead_time_id"),
                "component_id",
                "supplier_id",
                F.col("d").alias("effective_date"),
                F.col("lt").alias("lead_time_weeks"),
                F.col("d").alias("recorded_at"),
            ),
            "lead_times",
        )

    def sales_orders(self) -> DataFrame:
        f = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "N")
        line = self.line(f)
        ln = F.col("l_linenumber")
        status = (
            F.when(ln % 5 == 0, "confirmed")
            .when(ln % 5 == 1, "picking")
            .when(ln % 5 == 2, "shipped_partial")
            .when(ln % 5 == 3, "backorder")
            .otherwise("in_production")
        )
        so = line.select(
            F.col("line_id").alias("sales_order_id"),
            "customer_id",
            "product_id",
            "component_id",
            F.col("od").alias("order_date"),
            F.col("d").alias("requested_delivery_date"),
            F.date_add("d", ln - 4).alias("response_date"),
            F.date_sub("d", F.col("p_size") % 10).alias("earliest_ship_date"),
            F.date_add("d", F.col("p_size") % 12).alias("deadline_date"),
            F.col("q").alias("order_qty"),
            F.lit(0).alias("shipped_qty"),
            F.col("q").alias("remaining_qty"),
            F.col("q").alias("component_required_qty"),
            (F.col("q") % 5).alias("partial_available_qty"),
            status.alias("status"),
            (F.col("d") <= F.date_add(F.lit(self.T), 7)).alias("priority_flag"),
        )
        cust = self.customers().select("customer_id", "customer_name")
        prod = self.products().select("product_id", "product_name")
        so = so.join(cust, "customer_id", "left").join(prod, "product_id", "left")
        return conform(so, "sales_orders")

    def purchase_orders(self) -> DataFrame:
        f = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R")
        line = self.line(f)
        ln = F.col("l_linenumber")
        status = (
            F.when(ln % 6 == 0, "placed")
            .when(ln % 6 == 1, "acknowledged")
            .when(ln % 6 == 2, "in_production")
            .when(ln % 6 == 3, "shipped")
            .when(ln % 6 == 4, "partial_received")
            .otherwise("fully_received")
        )
        return conform(
            line.select(
                F.col("line_id").alias("purchase_order_id"),
                "component_id",
                "supplier_id",
                F.col("od").alias("order_date"),
                F.col("d").alias("expected_delivery_date"),
                F.col("q").alias("quantity"),
                F.lit(0).alias("received_qty"),
                F.col("q").alias("outstanding_qty"),
                status.alias("status"),
                (F.col("l_discount") > 0.08).alias("is_delayed"),
                (F.col("p_size") % 9).alias("delay_days"),
                F.col("p_retailprice").alias("unit_cost_usd"),
                (F.col("p_retailprice") * F.col("q")).alias("total_cost_usd"),
            ),
            "purchase_orders",
        )

    def logistics(self) -> DataFrame:
        df = self.line(customer=True)
        ln = F.col("l_linenumber")
        done = F.col("l_linestatus") == "F"
        status = (
            F.when(done, "delivered")
            .when(F.col("l_returnflag") == "N", "in_transit")
            .when(F.col("l_returnflag") == "R", "delayed")
            .otherwise("ordered")
        )
        return conform(
            df.select(
                F.col("line_id").alias("shipment_id"),
                "component_id",
                "supplier_id",
                _s("c_nationkey").alias("destination_warehouse_id"),
                F.col("od").alias("order_date"),
                F.col("d").alias("expected_arrival_date"),
                F.when(done, F.date_add("d", ln - 3)).alias("actual_arrival_date"),
                F.col("q").alias("quantity"),
                status.alias("status"),
                F.greatest(F.lit(0), ln - 3).alias("delay_days"),
                F.when(ln > 3, F.lit("weather")).alias("delay_cause"),
                F.col("p_retailprice").alias("unit_cost_usd"),
            ),
            "logistics",
        )

    def free_inventory(self) -> DataFrame:
        p = self.t["part"]
        return conform(
            p.select(
                F.concat(F.lit("FI-"), _s("p_partkey")).alias("free_inventory_id"),
                _s("p_partkey").alias("component_id"),
                F.lit("HUB").alias("warehouse_id"),
                (F.col("p_size") % 12).alias("qty_available"),
                F.lit(self.T).alias("as_of_date"),
                _s(F.col("p_partkey") % 100).alias("allocated_to"),
            ),
            "free_inventory",
        )

    def demand_plan_components(self) -> DataFrame:
        f = (F.col("l_linestatus") == "O") & (F.col("l_returnflag") != "N")
        line = self.line(f)
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return conform(
            line.select(
                F.col("line_id").alias("demand_id"),
                "component_id",
                F.col("d").alias("requested_date"),
                (F.col("q") - 1).alias("requested_qty"),
                F.when(urgent, "EMERGENCY_MANUAL").otherwise("FCST_AUTO").alias("source_type"),
                F.when(urgent, F.lit(None)).otherwise(F.col("product_id")).alias("product_id"),
                "customer_id",
                F.col("od").alias("created_at"),
            ),
            "demand_plan_components",
        )

    def actuals(self) -> DataFrame:
        """Shipped quantity per (product, month): the actuals that forecast
        accuracy is measured against."""
        line = self.line(F.col("l_linestatus") == "F", orders=False).withColumn("month", F.trunc("d", "MM"))
        return line.groupBy("product_id", "month").agg(F.sum("q").cast("bigint").alias("actual_qty"))

    def all(self) -> LazyTables:
        tables = {name: getattr(self, name) for name in SCHEMAS}
        tables["actuals"] = self.actuals
        return LazyTables(tables)


def domain_tables(spark: SparkSession, sf_dir: str, params: Params) -> LazyTables:
    """The seventeen raw domain tables mapped from the driver parquet files
    (each built on first use)."""
    return DriverAdapter(read_driver(spark, sf_dir), params).all()
