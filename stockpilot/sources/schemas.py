"""Typed schemas of the seventeen domain input tables.

The same map drives the CSV reader (no schema inference) and the typed
projection of the cleansing layer.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

S, I, D, DT, B, TS = StringType(), IntegerType(), DoubleType(), DateType(), BooleanType(), TimestampType()


def _schema(*cols: tuple[str, DataType]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, StructType] = {
    "suppliers": _schema(("supplier_id", S), ("supplier_name", S), ("country", S), ("region", S)),
    "customers": _schema(("customer_id", S), ("customer_name", S), ("segment", S), ("location", S)),
    "products": _schema(
        ("product_id", S), ("product_name", S), ("product_category", S), ("customer_id", S), ("unit_price_jpy", I)
    ),
    "components": _schema(
        ("component_id", S), ("part_number", S), ("component_name", S), ("component_category", S),
        ("supplier_id", S), ("base_lead_time_weeks", I), ("unit_price_usd", D), ("safety_stock_weeks", I),
        ("min_order_qty", I), ("min_stock", I), ("max_stock", I),
    ),
    "warehouses": _schema(
        ("warehouse_id", S), ("warehouse_name", S), ("prefecture", S), ("city", S),
        ("latitude", D), ("longitude", D), ("capacity_sqm", I),
    ),
    "bom": _schema(("product_id", S), ("component_id", S), ("quantity_per_unit", I)),
    "warehouse_components": _schema(
        ("component_id", S), ("warehouse_id", S), ("is_primary", B), ("allocation_pct", D)
    ),
    "shipment_routes": _schema(
        ("route_type", S), ("from_id", S), ("from_name", S), ("from_lat", D), ("from_lon", D),
        ("to_id", S), ("to_name", S), ("to_lat", D), ("to_lon", D),
        ("avg_transit_days", I), ("monthly_shipments", I),
    ),
    "forecasts": _schema(
        ("forecast_id", S), ("product_id", S), ("customer_id", S), ("forecast_month", DT),
        ("forecast_qty", I), ("forecast_accuracy", D), ("created_at", TS),
    ),
    "lead_times": _schema(
        ("lead_time_id", S), ("component_id", S), ("supplier_id", S), ("effective_date", DT),
        ("lead_time_weeks", I), ("change_reason", S), ("recorded_at", DT),
    ),
    "inventory": _schema(
        ("snapshot_id", S), ("component_id", S), ("warehouse_id", S), ("snapshot_month", DT),
        ("stock_qty", I), ("safety_stock_qty", I), ("replenishment_qty", I), ("demand_qty", I),
    ),
    "inventory_current": _schema(
        ("snapshot_id", S), ("component_id", S), ("warehouse_id", S), ("snapshot_month", DT),
        ("stock_qty", I), ("safety_stock_qty", I), ("replenishment_qty", I), ("demand_qty", I),
    ),
    "logistics": _schema(
        ("shipment_id", S), ("component_id", S), ("supplier_id", S), ("destination_warehouse_id", S),
        ("order_date", DT), ("expected_arrival_date", DT), ("actual_arrival_date", DT), ("quantity", I),
        ("status", S), ("delay_days", I), ("delay_cause", S), ("unit_cost_usd", D),
    ),
    "sales_orders": _schema(
        ("sales_order_id", S), ("customer_id", S), ("customer_name", S), ("product_id", S),
        ("product_name", S), ("component_id", S), ("order_date", DT), ("requested_delivery_date", DT),
        ("response_date", DT), ("earliest_ship_date", DT), ("deadline_date", DT), ("order_qty", I),
        ("shipped_qty", I), ("remaining_qty", I), ("component_required_qty", I),
        ("partial_available_qty", I), ("status", S), ("priority_flag", B),
    ),
    "purchase_orders": _schema(
        ("purchase_order_id", S), ("component_id", S), ("supplier_id", S), ("order_date", DT),
        ("expected_delivery_date", DT), ("quantity", I), ("received_qty", I), ("outstanding_qty", I),
        ("status", S), ("is_delayed", B), ("delay_days", I), ("unit_cost_usd", D), ("total_cost_usd", D),
    ),
    "free_inventory": _schema(
        ("free_inventory_id", S), ("component_id", S), ("warehouse_id", S), ("qty_available", I),
        ("as_of_date", DT), ("allocated_to", S), ("note", S),
    ),
    "demand_plan_components": _schema(
        ("demand_id", S), ("component_id", S), ("requested_date", DT), ("requested_qty", I),
        ("source_type", S), ("product_id", S), ("customer_id", S), ("created_at", DT), ("note", S),
    ),
}

TABLES: tuple[str, ...] = tuple(SCHEMAS)

# Primary keys of the master tables that are deduplicated during cleansing.
MASTER_KEYS: dict[str, str] = {
    "suppliers": "supplier_id",
    "customers": "customer_id",
    "products": "product_id",
    "components": "component_id",
    "warehouses": "warehouse_id",
}
