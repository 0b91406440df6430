"""Cleansed layer: typed projection, rules, dedupe and derived columns for
each of the seventeen tables.  Every function is lazy and takes its raw
input(s) as arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockpilot.functions.columns import band, d
from stockpilot.operators.quality import dedupe, keep, observe_rules, rules_for, typed
from stockpilot.params import Params
from stockpilot.sources.schemas import MASTER_KEYS, SCHEMAS


def _base(raw: DataFrame, table: str) -> DataFrame:
    df = typed(raw, SCHEMAS[table]).select(*SCHEMAS[table].fieldNames())
    if table in MASTER_KEYS:
        df = dedupe(df, MASTER_KEYS[table])
    return df


def _keep(df: DataFrame, table: str, obs: dict | None) -> DataFrame:
    """Drop rules; with ``obs``, every rule's failure count over the rows
    before dropping is attached as a Spark Observation (filled by the job
    that first computes the table, no extra scan)."""
    rules = rules_for(table)
    if obs is not None and rules:
        df, obs[table] = observe_rules(df, table, rules)
    return keep(df, rules)


def clean_simple(raw: DataFrame, table: str, obs: dict | None = None) -> DataFrame:
    return _keep(_base(raw, table), table, obs)


def clean_components(raw: DataFrame, suppliers: DataFrame, obs: dict | None = None) -> DataFrame:
    """Dedupe, rules, then the supplier name.  Suppliers are unique per id,
    so the left join neither adds nor drops rows and the name is a function
    of supplier_id: deduping before the join picks the same row as after
    it, and a plan that never reads supplier_name can drop the join."""
    comp = typed(raw, SCHEMAS["components"]).select(*SCHEMAS["components"].fieldNames())
    kept = _keep(dedupe(comp, "component_id"), "components", obs)
    sup = suppliers.select("supplier_id", "supplier_name")
    return kept.join(sup, "supplier_id", "left").select(*comp.columns, "supplier_name")


def enrich_lead_times(lt: DataFrame, components: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Component and supplier names plus the lead-time band."""
    comp = components.select("component_id", "part_number", "component_name", "component_category")
    sup = suppliers.select("supplier_id", "supplier_name")
    return (
        lt.join(comp, "component_id", "left")
        .join(sup, "supplier_id", "left")
        .withColumn("lt_band", band(F.col("lead_time_weeks")))
    )


def clean_lead_times(raw: DataFrame, components: DataFrame, suppliers: DataFrame) -> DataFrame:
    return enrich_lead_times(clean_simple(raw, "lead_times"), components, suppliers)


def clean_sales_orders(raw: DataFrame, p: Params, obs: dict | None = None) -> DataFrame:
    so = clean_simple(raw, "sales_orders", obs)
    return so.withColumn("days_to_due", F.datediff("requested_delivery_date", d(p.as_of))).withColumn(
        "is_overdue", F.col("days_to_due") < 0
    )


def clean_purchase_orders(raw: DataFrame, p: Params, obs: dict | None = None) -> DataFrame:
    po = clean_simple(raw, "purchase_orders", obs)
    return po.withColumn("days_to_expected", F.datediff("expected_delivery_date", d(p.as_of)))


def clean_demand(raw: DataFrame, p: Params, obs: dict | None = None) -> DataFrame:
    # rows that repeat a demand_id stay, each a demand row of its own
    dm = clean_simple(raw, "demand_plan_components", obs)
    return dm.withColumn("days_to_required", F.datediff("requested_date", d(p.as_of))).withColumn(
        "is_emergency", F.col("source_type") == F.lit("EMERGENCY_MANUAL")
    )


def clean_all(raw, p: Params, observations: dict | None = None, tables=None):
    """Cleansed tables, each built on first access.  With ``observations``
    (a dict), the rule counters of each table are attached as Observations
    and stored there by table name.  ``tables`` makes the mapping from the
    builders (default: built lazily and remembered)."""
    from stockpilot.sources.driver import LazyTables

    out: LazyTables
    obs = observations

    def simple(t):
        return lambda: clean_simple(raw[t], t, obs)

    builders = {t: simple(t) for t in SCHEMAS}
    builders["components"] = lambda: clean_components(raw["components"], out["suppliers"], obs)
    builders["lead_times"] = lambda: enrich_lead_times(out["lead_times_base"], out["components"], out["suppliers"])
    # rules applied, not yet enriched: lets marts aggregate before joining
    builders["lead_times_base"] = lambda: clean_simple(raw["lead_times"], "lead_times", obs)
    builders["sales_orders"] = lambda: clean_sales_orders(raw["sales_orders"], p, obs)
    builders["purchase_orders"] = lambda: clean_purchase_orders(raw["purchase_orders"], p, obs)
    builders["demand_plan_components"] = lambda: clean_demand(raw["demand_plan_components"], p, obs)
    out = (tables or LazyTables)(builders)
    return out
