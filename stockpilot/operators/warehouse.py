"""Warehouse health, logistics and distributor free-stock operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockpilot.functions.columns import d
from stockpilot.params import Params

L = "bigint"
# Shipment statuses that count as not yet arrived.
OPEN_SHIPMENT_STATUS = ("in_transit", "delayed", "ordered", "shipped", "placed")


def warehouse_status(
    warehouses: DataFrame, inventory_current: DataFrame, components: DataFrame, logistics: DataFrame, p: Params
) -> DataFrame:
    """Per warehouse: components it holds classed by their stock over *all*
    warehouses, its own stock and value, open inbound shipments, health.

    Plan: inventory rows are summed to (warehouse, component) first, with
    partial aggregates, so that the window below sees at most one row per
    warehouse and component; they join the component master once (shuffle on
    component_id); the all-warehouse total per component is a window on
    that same partitioning (no second shuffle); the (warehouse, component)
    pairs are grouped on the same partitioning, and the last group-by is by
    warehouse (partial aggregates, a handful of rows per task)."""
    comp = components.select("component_id", "min_stock", "max_stock", "unit_price_usd")
    ic = inventory_current.groupBy("warehouse_id", "component_id").agg(F.sum("stock_qty").alias("stock_qty"))
    j = ic.join(comp, "component_id", "left")
    total = F.sum("stock_qty").over(Window.partitionBy("component_id"))
    mn = F.coalesce(F.col("min_stock"), F.lit(p.default_min_stock))
    mx = F.coalesce(F.col("max_stock"), F.lit(p.default_max_stock))
    j = j.withColumn("total", total)
    t = F.col("total")
    has = F.col("component_id").isNotNull()
    j = j.select(
        "warehouse_id",
        "component_id",
        "stock_qty",
        # decimals: the sum does not depend on the order of the tasks
        (F.col("stock_qty").cast("decimal(18,0)") * F.coalesce(F.col("unit_price_usd"), F.lit(0.0)).cast("decimal(13,6)")).alias("value"),
        F.when(has, F.when(t <= 0, 1).otherwise(0)).alias("is_zero"),
        F.when(has, F.when((t > 0) & (t < mn), 1).otherwise(0)).alias("is_under"),
        F.when(has, F.when(t > mx, 1).otherwise(0)).alias("is_over"),
        F.when(has, F.when((t > 0) & (t >= mn) & (t <= mx), 1).otherwise(0)).alias("is_ok"),
    )
    pair = j.groupBy("warehouse_id", "component_id").agg(
        F.sum("stock_qty").alias("stock"),
        F.sum("value").alias("value"),
        F.max("is_zero").alias("is_zero"),
        F.max("is_under").alias("is_under"),
        F.max("is_over").alias("is_over"),
        F.max("is_ok").alias("is_ok"),
    )
    wh = pair.groupBy("warehouse_id").agg(
        F.count("component_id").alias("managed_count"),
        F.sum("is_zero").alias("zero_count"),
        F.sum("is_under").alias("under_count"),
        F.sum("is_over").alias("over_count"),
        F.sum("is_ok").alias("ok_count"),
        F.sum("stock").alias("total_stock_qty"),
        F.sum("value").alias("total_stock_value"),
    )
    inc = (
        logistics.filter(F.col("actual_arrival_date").isNull() & F.col("status").isin(*OPEN_SHIPMENT_STATUS))
        .groupBy(F.col("destination_warehouse_id").alias("warehouse_id"))
        .agg(
            F.count(F.lit(1)).alias("incoming_shipments"),
            F.sum("quantity").alias("incoming_qty"),
            F.count_if(F.col("delay_days") > 0).alias("delayed_shipments"),
        )
    )
    w = warehouses.join(wh, "warehouse_id", "left").join(inc, "warehouse_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    managed = z("managed_count")
    health = F.round(
        F.when(managed == 0, F.lit(50.0)).otherwise(z("ok_count") * 100.0 / F.col("managed_count")), 1
    ).cast("double")
    return w.select(
        d(p.as_of).alias("snapshot_date"),
        "warehouse_id",
        "warehouse_name",
        F.col("latitude").alias("geo_lat"),
        F.col("longitude").alias("geo_lon"),
        "prefecture",
        managed.cast(L).alias("managed_count"),
        z("zero_count").cast(L).alias("zero_count"),
        z("under_count").cast(L).alias("under_count"),
        z("over_count").cast(L).alias("over_count"),
        z("total_stock_qty").cast(L).alias("total_stock_qty"),
        (F.coalesce(F.col("total_stock_value"), F.lit(0)) * p.fx_rate).cast(L).alias("total_stock_value_jpy"),
        z("incoming_shipments").cast(L).alias("incoming_shipments"),
        z("incoming_qty").cast(L).alias("incoming_qty"),
        z("delayed_shipments").cast(L).alias("delayed_shipments"),
        health.alias("health_score"),
        (z("zero_count") + z("under_count")).cast(L).alias("critical_count"),
        F.lit(0).cast(L).alias("high_count"),
    )


def warehouse_rank(status: DataFrame, hub_id: str) -> DataFrame:
    """Customer warehouses (distributor hub excluded) by health, with the map
    colour: red if any critical item or health < 50, amber < 75, else green."""
    h, crit = F.col("health_score"), F.col("critical_count")
    colour = F.when((crit > 0) | (h < 50), F.lit("red")).when(h < 75, F.lit("amber")).otherwise(F.lit("green"))
    return status.filter(F.col("warehouse_id") != hub_id).select(
        "warehouse_id", "warehouse_name", "prefecture", "managed_count", "total_stock_qty", "zero_count",
        "under_count", "incoming_shipments", "delayed_shipments", "health_score", colour.alias("map_colour"),
    )


def shipments_recent(logistics: DataFrame, p: Params, days: int = 30) -> DataFrame:
    """Arrived on or after T - days: count, delayed count, mean delay of the
    delayed ones (0 when none)."""
    r = logistics.filter(F.col("actual_arrival_date") >= F.date_sub(d(p.as_of), days))
    dl = F.coalesce(F.col("delay_days"), F.lit(0))
    return r.agg(
        F.count(F.lit(1)).cast(L).alias("shipments"),
        F.count_if(dl > 0).cast(L).alias("delayed"),
        F.round(F.coalesce(F.avg(F.when(dl > 0, dl)), F.lit(0.0)), 4).alias("avg_delay_days"),
    )


def shipment_delays(logistics: DataFrame, p: Params, days: int = 60, k: int = 20) -> DataFrame:
    dl = F.coalesce(F.col("delay_days"), F.lit(0))
    r = logistics.filter((F.col("actual_arrival_date") >= F.date_sub(d(p.as_of), days)) & (dl > 0))
    return r.select(
        "shipment_id", "component_id", "supplier_id", "destination_warehouse_id", "expected_arrival_date",
        "actual_arrival_date", dl.alias("delay_days"), "delay_cause", "status",
    ).orderBy(F.col("delay_days").desc(), "shipment_id").limit(k)


def routes_by_direction(routes: DataFrame, direction: str) -> DataFrame:
    return routes.filter(F.col("route_type") == direction)


def free_stock_kpi(free_inventory: DataFrame, components: DataFrame, high_value: float = 5000.0) -> DataFrame:
    """Total free quantity, distinct components, total value, rows worth more
    than ``high_value``."""
    price = components.select("component_id", "unit_price_usd")
    j = free_inventory.join(price, "component_id", "left")
    val = F.col("qty_available") * F.coalesce(F.col("unit_price_usd"), F.lit(0.0))
    return j.agg(
        F.coalesce(F.sum("qty_available"), F.lit(0)).cast(L).alias("total_qty"),
        F.count_distinct("component_id").cast(L).alias("n_components"),
        F.round(F.coalesce(F.sum(val), F.lit(0.0)), 2).alias("total_value_usd"),
        F.count_if(val > high_value).cast(L).alias("high_value_items"),
    )


def free_stock_top(free_inventory: DataFrame, components: DataFrame, k: int = 20) -> DataFrame:
    g = free_inventory.groupBy("component_id").agg(F.sum("qty_available").cast(L).alias("free_qty"))
    names = components.select("component_id", "part_number", "component_name")
    top = g.orderBy(F.col("free_qty").desc(), "component_id").limit(k)
    return top.join(names, "component_id", "left")


def free_leverage(free_inventory: DataFrame, stock: DataFrame, components: DataFrame) -> DataFrame:
    """Free stock relative to customer stock per component:
    free / max(customer, 1) rounded to 2 places (0 when no free stock)."""
    free = free_inventory.groupBy("component_id").agg(F.sum("qty_available").cast(L).alias("free_qty"))
    j = free.join(stock, "component_id", "left").join(
        components.select("component_id", "part_number", "component_name", "base_lead_time_weeks"), "component_id",
        "left",
    )
    cust = F.coalesce(F.col("stock"), F.lit(0)).cast(L)
    score = F.when(
        F.col("free_qty") > 0, F.round(F.col("free_qty") / F.greatest(cust, F.lit(1)).cast("double"), 2)
    ).otherwise(F.lit(0.0))
    return j.select(
        "component_id", "part_number", "component_name", "base_lead_time_weeks", "free_qty",
        cust.alias("customer_qty"), (F.col("free_qty") + cust).alias("total_qty"), score.alias("leverage_score"),
    )
