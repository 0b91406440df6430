"""Source health, executive summary and the unified action queue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.columns import d
from stockpilot.params import Params

L = "bigint"

# The sources covered by the health table, in report order
# (free stock and demand plan are not covered).
HEALTH_SOURCES = (
    "suppliers",
    "customers",
    "products",
    "components",
    "warehouses",
    "bom",
    "forecasts",
    "lead_times",
    "inventory",
    "inventory_current",
    "logistics",
    "sales_orders",
    "purchase_orders",
    "warehouse_components",
    "shipment_routes",
)

# Action-queue texts (neutral English codes).
RISK_LT = "LT_ESCALATION"
ACTION_LT = "ADVANCE_ORDER_TIMING"
RISK_ZERO = "ZERO_STOCK_FORECAST"
ACTION_ZERO = "EMERGENCY_REPLENISH"


def source_health(raw: dict[str, DataFrame], p: Params) -> DataFrame:
    """Row count, 100/0 quality and success flag per raw source; one global
    count per source, unioned."""
    parts = [
        raw[name].agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(name).alias("source"), "cnt")
        for name in HEALTH_SOURCES
    ]
    u = reduce(DataFrame.unionByName, parts)
    return u.select(
        d(p.as_of).alias("snapshot_date"),
        F.concat(F.lit("ingest_"), "source").alias("pipeline_name"),
        F.concat(F.col("source"), F.lit(".csv")).alias("source_table"),
        F.concat(F.lit("raw_"), "source").alias("target_table"),
        F.col("cnt").cast(L).alias("record_count"),
        F.lit(p.as_of.isoformat()).alias("freshness_ts"),
        F.when(F.col("cnt") > 0, F.lit(100.0)).otherwise(F.lit(0.0)).alias("quality_score"),
        (F.col("cnt") > 0).alias("success_flag"),
        F.lit(None).cast("string").alias("error_message"),
    )


def source_kpi(health: DataFrame) -> DataFrame:
    return health.agg(
        F.count(F.lit(1)).cast(L).alias("sources"),
        F.count_if(F.col("success_flag")).cast(L).alias("ok"),
        F.count_if(~F.col("success_flag")).cast(L).alias("failed"),
        F.coalesce(F.sum("record_count"), F.lit(0)).cast(L).alias("rows"),
        F.round(F.avg("quality_score"), 2).alias("avg_quality"),
    )


def items_by_flag(df: DataFrame, **flags) -> DataFrame:
    """Distinct items per condition: one flag per item and condition on the
    item grouping, then a sum -- no row expansion as several distinct counts need."""
    per_item = df.filter(F.col("item_id").isNotNull()).groupBy("item_id")
    per_item = per_item.agg(*(F.max(F.coalesce(c, F.lit(False)).cast("int")).alias(n) for n, c in flags.items()))
    return per_item.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast(L).alias(n) for n in flags))


def exec_summary(
    order_risk: DataFrame,
    escalation: DataFrame,
    brc: DataFrame,
    warehouse: DataFrame,
    forecasts: DataFrame,
    p: Params,
) -> DataFrame:
    """One row of KPIs.  Five global aggregates (each a partial aggregate
    over its input) are stacked with a union and folded by one more global
    aggregate -- no cross join."""
    rank = F.col("priority_rank")
    bt = F.col("breach_type")
    parts = [
        order_risk.agg(
            F.count_if(rank == "Critical").alias("critical_count"),
            F.count_if(rank == "High").alias("high_count"),
            F.count_if(rank == "Mid").alias("medium_count"),
            F.count_if(rank == "Low").alias("low_count"),
        ),
        escalation.agg(F.count(F.lit(1)).alias("lt_escalation_item_count")),
        items_by_flag(brc, zero_count=bt == "ZERO", under_count=bt == "UNDER", over_count=bt == "OVER"),
        warehouse.agg(F.round(F.avg("health_score"), 1).alias("warehouse_health_score")),
        forecasts.filter(F.col("forecast_month") >= F.add_months(d(p.as_of), -3)).agg(
            F.round(F.avg("forecast_accuracy") * 100, 1).alias("forecast_accuracy_pct")
        ),
    ]
    cols = [c for part in parts for c in part.columns]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = u.agg(*[F.max(c).alias(c) for c in cols])
    counts = ["critical_count", "high_count", "medium_count", "low_count", "lt_escalation_item_count",
              "zero_count", "under_count", "over_count"]
    return one.select(
        d(p.as_of).alias("snapshot_date"),
        *[F.col(c).cast(L).alias(c) for c in counts],
        "warehouse_health_score",
        (F.coalesce(F.col("critical_count"), F.lit(0)) + F.coalesce(F.col("high_count"), F.lit(0)))
        .cast(L)
        .alias("top_risk_order_count"),
        F.coalesce(F.col("forecast_accuracy_pct"), F.lit(0.0)).alias("forecast_accuracy_pct"),
    )


def action_queue(order_risk: DataFrame, escalation: DataFrame, brc: DataFrame, p: Params) -> DataFrame:
    """Three top-k branches (orders, lead-time escalations, first ZERO
    breach per item) stacked.  Each ``orderBy().limit()`` plans as a
    per-partition top-k merged on the driver side of one task
    (TakeOrderedAndProject): bounded, whatever the input size.  Ids break
    score ties so the queue is deterministic."""
    T = d(p.as_of)
    rank = F.col("priority_rank")
    orders = (
        order_risk.filter(rank.isin("Critical", "High"))
        .orderBy(F.col("risk_score").desc(), F.col("sales_order_id").asc())
        .limit(p.queue_orders)
        .select(
            T.alias("snapshot_date"),
            F.lit("order_risk").alias("source"),
            F.col("sales_order_id").alias("target_id"),
            F.col("part_number").alias("item_code"),
            F.col("component_name").alias("item_name"),
            F.concat(F.lit("due "), rank).alias("risk_type"),
            F.col("adjustment_action").alias("recommended_action"),
            F.when(rank == "Critical", 1).otherwise(2).alias("urgency_rank"),
            F.col("requested_delivery_date").cast("string").alias("due_date"),
            F.col("risk_reason").alias("rationale"),
        )
    )
    lt = (
        escalation.orderBy(F.col("delta_vs_n3").desc_nulls_last(), F.col("item_id").asc())
        .limit(p.queue_lead_time)
        .select(
            T.alias("snapshot_date"),
            F.lit("lt_escalation").alias("source"),
            F.col("item_id").alias("target_id"),
            "item_code",
            "item_name",
            F.lit(RISK_LT).alias("risk_type"),
            F.lit(ACTION_LT).alias("recommended_action"),
            F.lit(3).alias("urgency_rank"),
            F.lit("").alias("due_date"),
            F.when(F.col("remark") != "", F.col("remark")).otherwise(F.col("escalation_reason")).alias("rationale"),
        )
    )
    # first ZERO month per item: min_by is a partial aggregate (no sort of
    # an item's rows in one task)
    first = (
        brc.filter(F.col("breach_type") == "ZERO")
        .groupBy("item_id")
        .agg(F.min_by(F.struct("breach_date", "item_code", "product_name", "projected_stock"), "breach_date").alias("b"))
        .select("item_id", "b.*")
    )
    zero = (
        first.orderBy(F.col("breach_date").asc(), F.col("item_id").asc())
        .limit(p.queue_breaches)
        .select(
            T.alias("snapshot_date"),
            F.lit("policy_breach").alias("source"),
            F.col("item_id").alias("target_id"),
            "item_code",
            F.col("product_name").alias("item_name"),
            F.lit(RISK_ZERO).alias("risk_type"),
            F.lit(ACTION_ZERO).alias("recommended_action"),
            F.lit(2).alias("urgency_rank"),
            F.col("breach_date").cast("string").alias("due_date"),
            F.concat(F.lit("projected stock "), F.col("projected_stock").cast("string")).alias("rationale"),
        )
    )
    return orders.unionByName(lt).unionByName(zero)

