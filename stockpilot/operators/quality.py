"""Data-quality rules: typed projection, drop/warn expectations, quarantine,
deterministic dedupe, per-rule failure report, null-rate score, source health.

A rule predicate that evaluates to NULL counts as failed; the complement
of the kept rows (quarantine) therefore uses ``coalesce(p, false)`` so no
row is lost between the two outputs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DROP, WARN = "drop", "warn"


@dataclass(frozen=True)
class Rule:
    table: str
    name: str
    predicate: str  # Spark SQL boolean expression
    action: str  # DROP or WARN

    def passed(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


# The expectations of the cleansed layer (table, name, predicate, action).
RULES: tuple[Rule, ...] = (
    Rule("suppliers", "supplier_id_not_null", "supplier_id IS NOT NULL", DROP),
    Rule("suppliers", "supplier_name_present", "supplier_name IS NOT NULL", WARN),
    Rule("customers", "customer_id_not_null", "customer_id IS NOT NULL", DROP),
    Rule("products", "product_id_not_null", "product_id IS NOT NULL", DROP),
    Rule("components", "component_id_not_null", "component_id IS NOT NULL", DROP),
    Rule("components", "supplier_id_not_null", "supplier_id IS NOT NULL", DROP),
    Rule("components", "min_lt_positive", "base_lead_time_weeks > 0", WARN),
    Rule(
        "components",
        "min_max_stock_sane",
        "min_stock IS NULL OR max_stock IS NULL OR max_stock >= min_stock",
        WARN,
    ),
    Rule("warehouses", "warehouse_id_not_null", "warehouse_id IS NOT NULL", DROP),
    Rule("warehouses", "lat_in_japan", "latitude BETWEEN 24 AND 46", WARN),
    Rule("warehouses", "lon_in_japan", "longitude BETWEEN 122 AND 150", WARN),
    Rule("bom", "bom_keys_present", "product_id IS NOT NULL AND component_id IS NOT NULL", DROP),
    Rule("bom", "bom_qty_positive", "quantity_per_unit > 0", DROP),
    Rule("forecasts", "forecast_qty_non_negative", "forecast_qty >= 0", DROP),
    Rule(
        "forecasts",
        "accuracy_in_range",
        "forecast_accuracy IS NULL OR forecast_accuracy BETWEEN 0 AND 1",
        WARN,
    ),
    Rule("lead_times", "lt_positive", "lead_time_weeks > 0", DROP),
    Rule("lead_times", "effective_date_valid", "effective_date IS NOT NULL", DROP),
    Rule("inventory", "stock_non_negative", "stock_qty >= 0", DROP),
    Rule("inventory_current", "component_id_present", "component_id IS NOT NULL", WARN),
    Rule("sales_orders", "so_id_not_null", "sales_order_id IS NOT NULL", DROP),
    Rule("sales_orders", "so_component_id_not_null", "component_id IS NOT NULL", DROP),
    Rule("purchase_orders", "po_id_not_null", "purchase_order_id IS NOT NULL", DROP),
    Rule("purchase_orders", "outstanding_non_negative", "outstanding_qty >= 0", DROP),
    Rule("free_inventory", "free_inv_id_not_null", "free_inventory_id IS NOT NULL", DROP),
    Rule("free_inventory", "free_inv_qty_positive", "qty_available > 0", DROP),
    Rule("free_inventory", "free_inv_allocated_to_present", "allocated_to IS NOT NULL", WARN),
    Rule("demand_plan_components", "demand_id_not_null", "demand_id IS NOT NULL", DROP),
    Rule("demand_plan_components", "demand_qty_positive", "requested_qty > 0", DROP),
    Rule(
        "demand_plan_components",
        "demand_source_valid",
        "source_type IN ('FCST_AUTO', 'EMERGENCY_MANUAL')",
        WARN,
    ),
)


# Key columns whose null share scores each table (quality_null_rate).
KEY_COLUMNS: dict[str, tuple[str, ...]] = {
    "suppliers": ("supplier_id",),
    "customers": ("customer_id",),
    "products": ("product_id",),
    "components": ("component_id", "supplier_id"),
    "warehouses": ("warehouse_id",),
    "bom": ("product_id", "component_id"),
    "warehouse_components": ("component_id", "warehouse_id"),
    "shipment_routes": ("from_id", "to_id"),
    "forecasts": ("product_id", "forecast_month"),
    "lead_times": ("component_id", "effective_date"),
    "inventory": ("component_id", "warehouse_id"),
    "inventory_current": ("component_id", "warehouse_id"),
    "logistics": ("shipment_id", "component_id"),
    "sales_orders": ("sales_order_id", "component_id"),
    "purchase_orders": ("purchase_order_id", "component_id"),
    "free_inventory": ("free_inventory_id", "component_id"),
    "demand_plan_components": ("demand_id", "component_id"),
}


def rules_for(table: str, action: str | None = None) -> list[Rule]:
    return [r for r in RULES if r.table == table and (action is None or r.action == action)]


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Typed projection: every declared column via ``try_cast`` (bad values
    become NULL and then meet the rules instead of failing the job under ANSI
    mode); extra input columns are kept as they are."""
    declared = {f.name for f in schema.fields}
    have = set(df.columns)
    cols = [
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    extra = [c for c in df.columns if c not in declared]
    return df.select(*cols, *extra)


def _all_pass(rules: list[Rule]) -> Column:
    return reduce(lambda a, b: a & b, [r.passed() for r in rules], F.lit(True))


def keep(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that pass every drop rule."""
    drops = [r for r in rules if r.action == DROP]
    return df.filter(_all_pass(drops)) if drops else df


def quarantine(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that fail at least one drop rule, with the failed rule names."""
    drops = [r for r in rules if r.action == DROP]
    if not drops:
        return df.limit(0).withColumn("failed_rules", F.lit(None).cast("string"))
    failed = F.concat_ws(",", *[F.when(~r.passed(), F.lit(r.name)) for r in drops])
    return df.filter(~_all_pass(drops)).withColumn("failed_rules", failed)


def quarantine_records(df: DataFrame, table: str) -> DataFrame:
    """table_name, failed_rules and the whole rejected row as JSON (nulls
    kept), so that the rejects of tables with different columns make one table."""
    rejected = quarantine(df, rules_for(table))
    record = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return rejected.select(F.lit(table).alias("table_name"), "failed_rules", record.alias("record"))


def rule_report(df: DataFrame, table: str, rules: list[Rule]) -> DataFrame:
    """One row per rule: rows checked and rows failing (single pass; the
    per-rule counts are partial aggregates, so no group is ever collected)."""
    aggs = [F.count(F.lit(1)).alias("rows_checked")] + [
        F.count_if(~r.passed()).alias(f"f{i}") for i, r in enumerate(rules)
    ]
    counts = df.agg(*aggs)
    stack = ", ".join(f"'{r.name}', '{r.action}', f{i}" for i, r in enumerate(rules))
    return counts.selectExpr(
        f"'{table}' AS table_name",
        "rows_checked",
        f"stack({len(rules)}, {stack}) AS (rule_name, action, rows_failed)",
    ).select(
        "table_name",
        "rule_name",
        "action",
        F.col("rows_checked").cast("bigint").alias("rows_checked"),
        F.col("rows_failed").cast("bigint").alias("rows_failed"),
    )


def dedupe(df: DataFrame, key: str) -> DataFrame:
    """One row per key, chosen deterministically: the smallest row by all
    other columns.  ``min(struct)`` is a partial aggregate, so a key that
    holds a large share of the rows is reduced map-side, never sorted in
    one task."""
    others = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.min(F.struct(*others)).alias("_row"))
    return picked.select(key, *[F.col(f"_row.{c}").alias(c) for c in others]).select(*df.columns)


def null_rate(df: DataFrame, table: str, key_cols: list[str]) -> DataFrame:
    """Score = (1 - mean null rate over the key columns) * 100, one row."""
    n = F.count(F.lit(1))
    rates = [F.avg(F.col(c).isNull().cast("double")) for c in key_cols]
    mean_rate = reduce(lambda a, b: a + b, rates) / F.lit(float(len(key_cols)))
    return df.agg(
        F.lit(table).alias("table_name"),
        n.cast("bigint").alias("row_count"),
        F.round(F.coalesce((1 - mean_rate) * 100, F.lit(0.0)), 2).alias("quality_null_rate"),
    )


def observe_rules(df: DataFrame, table: str, rules: list[Rule]):
    """Attach per-rule failure counters to ``df`` as a Spark Observation:
    they are filled by whatever action runs on the returned DataFrame (no
    extra scan).  Returns (observed DataFrame, Observation); read
    ``observation.get`` after the action."""
    from pyspark.sql import Observation

    obs = Observation(f"dq_{table}")
    metrics = [F.count(F.lit(1)).alias("rows_checked")] + [
        F.count_if(~r.passed()).alias(r.name) for r in rules
    ]
    return df.observe(obs, *metrics), obs
