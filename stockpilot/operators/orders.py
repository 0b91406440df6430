"""Sales-order operators: commitment risk of each order line and the
delivery-risk view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.columns import clamp, d
from stockpilot.params import Params

# Order-risk actions and reasons (neutral codes).
EMERGENCY_ORDER, PULL_IN, RECHECK_1W, MONITOR = "EMERGENCY_ORDER", "PULL_IN", "RECHECK_1W", "MONITOR"
REASON_DUE_SOON, REASON_NO_STOCK, REASON_NONE = "due soon", "no customer stock", "none"


def stock_by_component(inventory_current: DataFrame) -> DataFrame:
    """Customer stock summed over warehouses: one row per component.
    Partial aggregation makes a hot component cheap."""
    return inventory_current.groupBy("component_id").agg(F.sum("stock_qty").cast("bigint").alias("stock"))


def priority_rank(days: F.Column) -> F.Column:
    return (
        F.when(days.isNull(), F.lit("Low"))
        .when(days <= 3, F.lit("Critical"))
        .when(days <= 7, F.lit("High"))
        .when(days <= 14, F.lit("Mid"))
        .otherwise(F.lit("Low"))
    )


def order_risk(sales_orders: DataFrame, components: DataFrame, stock: DataFrame, p: Params) -> DataFrame:
    comp = components.select("component_id", "part_number", "component_name", "component_category", "supplier_name")
    j = sales_orders.join(comp, "component_id", "left").join(stock, "component_id", "left")
    days = F.datediff("requested_delivery_date", d(p.as_of))
    stock_c = F.coalesce(F.col("stock"), F.lit(0).cast("bigint"))
    j = j.withColumn("days_to_due", days).withColumn("current_customer_stock", stock_c)
    days, stock_c = F.col("days_to_due"), F.col("current_customer_stock")
    action = (
        F.when((days <= 3) & (stock_c > 0), F.lit(PULL_IN))
        .when(days <= 3, F.lit(EMERGENCY_ORDER))
        .when(days <= 7, F.lit(PULL_IN))
        .when(days <= 14, F.lit(RECHECK_1W))
        .otherwise(F.lit(MONITOR))
    )
    reasons = F.concat_ws(
        "; ",
        F.when(days.isNotNull() & (days <= 7), F.lit(REASON_DUE_SOON)),
        F.when(stock_c <= 0, F.lit(REASON_NO_STOCK)),
    )
    return j.select(
        d(p.as_of).alias("snapshot_date"),
        "sales_order_id",
        "customer_name",
        "product_name",
        "part_number",
        "component_name",
        "component_category",
        "component_id",
        "remaining_qty",
        "requested_delivery_date",
        "response_date",
        "earliest_ship_date",
        "deadline_date",
        "partial_available_qty",
        "current_customer_stock",
        F.lit(0).alias("current_trading_house_stock"),
        "days_to_due",
        priority_rank(days).alias("priority_rank"),
        action.alias("adjustment_action"),
        F.when(reasons == "", F.lit(REASON_NONE)).otherwise(reasons).alias("risk_reason"),
        clamp(100 - F.coalesce(days, F.lit(0)) * 3, 0, 100).cast("int").alias("risk_score"),
        "supplier_name",
        "status",
        # the reference computes this but drops it; downstream logic needs it
        "component_required_qty",
    )


def delivery_risk(sales_orders: DataFrame, p: Params) -> DataFrame:
    """Delivery status from days to delivery and the response-vs-deadline gap.
    Tests are applied in this order: Critical (<=7 days and gap <=3, or
    overdue), High (<=30 and gap <=7), Medium (<=60 or response later than
    requested), Normal.  A missing gap counts as 999 days."""
    days = F.datediff("requested_delivery_date", d(p.as_of))
    gap = F.datediff("deadline_date", "response_date")
    late = F.coalesce(F.col("response_date") > F.col("requested_delivery_date"), F.lit(False))
    g = F.coalesce(gap, F.lit(999))
    status = (
        F.when(days.isNull(), F.lit("Normal"))
        .when((days <= 7) & (g <= 3), F.lit("Critical"))
        .when(days < 0, F.lit("Critical"))
        .when((days <= 30) & (g <= 7), F.lit("High"))
        .when((days <= 60) | late, F.lit("Medium"))
        .otherwise(F.lit("Normal"))
    )
    return sales_orders.select(
        "sales_order_id",
        "customer_id",
        "component_id",
        "requested_delivery_date",
        "response_date",
        "deadline_date",
        days.alias("days_to_delivery"),
        gap.alias("response_deadline_diff"),
        late.alias("response_late"),
        status.alias("delivery_status"),
    )
