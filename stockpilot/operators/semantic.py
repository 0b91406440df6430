"""Semantic layer: glossary, metric definitions and question examples as
small static tables, plus the question -> SQL library run over the marts.

The library SQL names marts as ``{mart_name}`` placeholders.  Spark binds
them to DataFrames through ``spark.sql(text, **frames)`` (no global temp
views); the oracle substitutes its own CTE names, so one text runs in both
engines.  Every library query reads the marts, i.e. the given tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StringType, StructField, StructType

# Glossary (term_id, term, definition, synonyms, avoid).
GLOSSARY = (
    ("T001", "customer stock", "Stock the customer owns; the main basis of every decision.", "own stock,on-hand", "do not mix with distributor stock"),
    ("T002", "distributor free stock", "Stock the distributor holds for the customer, net of existing allocations.", "free stock,unallocated stock", "not a substitute for customer stock"),
    ("T003", "safety stock", "Buffer of safety-stock weeks times mean weekly demand.", "SS", ""),
    ("T004", "LT", "Time from order to availability.", "lead time", ""),
    ("T005", "LT escalation", "Lead time up (UP) against N-3 or N-6.", "lead-time lengthening", "N-1 is not considered"),
    ("T006", "requested date", "Delivery date the customer asked for.", "CRD", ""),
    ("T007", "response date", "Date confirmed by the distributor or the maker.", "confirmed date", ""),
    ("T008", "deadline", "Internal cut-off to keep the customer date.", "ship-by date", ""),
    ("T009", "earliest ship date", "Earliest date the system deems safe to ship.", "ESD", ""),
    ("T010", "partial quantity", "Quantity that can ship ahead when the full order cannot.", "partial ship qty", ""),
    ("T011", "ZERO", "Projected stock at or below zero.", "stock-out", ""),
    ("T012", "UNDER", "Projected stock below the minimum.", "below min", ""),
    ("T013", "OVER", "Projected stock above the maximum.", "excess", ""),
    ("T014", "FCST", "Demand forecast; drives future balance and month-end projection.", "forecast", ""),
    ("T015", "FCST consumption", "Future stock use implied by the forecast.", "forecast use", ""),
    ("T016", "advance order", "Order to the maker not tied to a customer order.", "speculative order", ""),
    ("T017", "warehouse health", "Items within min/max over managed items, in percent.", "", "do not call healthy without this definition"),
    ("T018", "order priority", "Critical (3 days) / High (7) / Mid (14) / Low (over 14).", "", ""),
    ("T019", "order action", "EMERGENCY_ORDER / PULL_IN / RECHECK_1W / MONITOR / HOLD.", "", "fixed codes, not free text"),
)

# Metric definitions (id, name, formula, unit, source mart, screen).
METRICS = (
    ("M001", "Critical Orders", "order lines due within 3 days", "lines", "mart_order_risk", "executive"),
    ("M002", "High Orders", "order lines due within 7 days", "lines", "mart_order_risk", "executive"),
    ("M003", "LT Escalation Items", "items with LT up vs N-3 or N-6", "items", "mart_lt_escalation", "executive, lead time"),
    ("M004", "3M Policy Breaches", "items ZERO/UNDER/OVER within 3 months", "items", "mart_breach", "executive, inventory"),
    ("M005", "Projected Stockout Parts", "items projected ZERO within 3 months", "items", "mart_breach", "executive"),
    ("M006", "Excess Inventory Parts", "items projected OVER within 3 months", "items", "mart_breach", "executive"),
    ("M007", "Forecast Accuracy", "mean monthly forecast accuracy (%)", "%", "mart_exec_summary", "executive"),
    ("M008", "Warehouse Health", "items within min/max / managed items x 100", "%", "mart_warehouse", "executive, network"),
    ("M009", "Coverage Weeks", "current stock / mean weekly demand", "weeks", "mart_projection", "commit and balance"),
    ("M010", "Risk Score", "100 - 3 x days to due, clamped to 0..100", "points", "mart_order_risk", "commit and balance"),
)

# Example questions (id, text and what answers them).
EXAMPLE_QUESTIONS = (
    ("G001", "How many critical orders are there?", "qlib_g001", "procurement, management", "due within 3 days"),
    ("G002", "Which parts have lengthening lead times?", "qlib_g002", "procurement, planning", "N-3 / N-6"),
    ("G003", "Which parts are projected to run out?", "qlib_g003", "production, procurement", ""),
    ("G004", "How healthy are the matching warehouses?", "qlib_g004", "warehouse", ""),
    ("G005", "Which parts are in excess?", "qlib_g005", "planning, warehouse", "above max"),
    ("G006", "Which actions are due this week?", "qlib_g006", "procurement, planning", ""),
    ("G007", "Show forecast accuracy", "qlib_g007", "planning", "as-of date replaces the missing month column"),
    ("G008", "Which parts have lead times over 16 weeks?", "qlib_g008", "procurement", ""),
)

GLOSSARY_SCHEMA = StructType([StructField(n, StringType()) for n in ("term_id", "term", "definition", "synonyms", "prohibited")])
METRIC_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("metric_id", "metric_name", "formula", "unit", "source_mart", "screen")]
)
EXAMPLE_SCHEMA = StructType(
    [StructField(n, StringType()) for n in ("example_id", "question", "query_name", "role", "notes")]
)


def glossary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(GLOSSARY), GLOSSARY_SCHEMA)


def metric_definitions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(METRICS), METRIC_SCHEMA)


def example_questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXAMPLE_QUESTIONS), EXAMPLE_SCHEMA)


MANUFACTURER = "Supplier#000000001"

# Question -> SQL library.  Ties in ORDER BY ... LIMIT are broken by ids so
# the answer is deterministic; G007 reads the as-of date (the summary has
# no month column); the "one manufacturer's top 5" query filters on the
# manufacturer it names.
# Question ids, output columns and thresholds of the library's answers.
QLIB: dict[str, str] = {
    "qlib_g001": "SELECT COUNT(*) AS critical_count FROM {mart_order_risk} WHERE priority_rank = 'Critical'",
    "qlib_g002": "SELECT item_code, item_name, latest_lt_weeks, trend_arrow_n3, trend_arrow_n6 FROM {mart_lt_snapshot}"
    " WHERE trend_arrow_n3 = 'UP' OR trend_arrow_n6 = 'UP'",
    "qlib_g003": "SELECT DISTINCT item_code, product_name, breach_date FROM {mart_breach} WHERE breach_type = 'ZERO'",
    "qlib_g004": "SELECT warehouse_name, health_score, zero_count, under_count, over_count FROM {mart_warehouse}"
    " WHERE warehouse_name LIKE '%ON_1%'",
    "qlib_g005": "SELECT DISTINCT item_code, product_name FROM {mart_breach} WHERE breach_type = 'OVER'",
    "qlib_g006": "SELECT * FROM {mart_action_queue} ORDER BY urgency_rank, source, target_id LIMIT 20",
    "qlib_g007": "SELECT snapshot_date AS month, forecast_accuracy_pct FROM {mart_exec_summary}",
    "qlib_g008": "SELECT item_code, item_name, manufacturer_name, latest_lt_weeks FROM {mart_lt_snapshot}"
    " WHERE latest_lt_weeks > 16",
    "qlib_s01": "SELECT COUNT(*) AS critical_count FROM {mart_order_risk} WHERE priority_rank = 'Critical'",
    "qlib_s02": "SELECT sales_order_id, part_number, component_name, customer_name, requested_delivery_date"
    " FROM {mart_order_risk} WHERE priority_rank = 'Critical' ORDER BY requested_delivery_date, sales_order_id",
    "qlib_s03": "SELECT supplier_name, COUNT(*) AS critical_count FROM {mart_order_risk} WHERE priority_rank = 'Critical'"
    " GROUP BY supplier_name ORDER BY critical_count DESC, supplier_name",
    "qlib_s04": "SELECT DISTINCT item_code AS part_number, product_name AS component_name FROM {mart_breach}"
    " WHERE breach_type = 'ZERO' ORDER BY part_number, component_name",
    "qlib_s05": "SELECT COUNT(DISTINCT item_id) AS over_part_count FROM {mart_breach} WHERE breach_type = 'OVER'",
    "qlib_s06": "SELECT item_code AS part_number, item_name AS component_name, latest_lt_weeks FROM {mart_lt_snapshot}"
    " WHERE latest_lt_weeks > 16 ORDER BY latest_lt_weeks DESC, part_number",
    "qlib_s07": "SELECT item_code AS part_number, item_name AS component_name, latest_lt_weeks, lt_n3_weeks, lt_n6_weeks,"
    " trend_arrow_n3, trend_arrow_n6 FROM {mart_lt_escalation} ORDER BY latest_lt_weeks DESC, part_number",
    "qlib_s08": "SELECT warehouse_name, prefecture, health_score, zero_count, under_count, over_count FROM {mart_warehouse}"
    " ORDER BY health_score, warehouse_name",
    "qlib_s09": "SELECT urgency_rank, risk_type, item_code, item_name, recommended_action, due_date FROM {mart_action_queue}"
    " ORDER BY urgency_rank, source, target_id LIMIT 10",
    "qlib_s10": "SELECT supplier_name, COUNT(*) AS escalation_count FROM {mart_lt_escalation} GROUP BY supplier_name"
    " ORDER BY escalation_count DESC, supplier_name",
    "qlib_s11": "SELECT critical_count, high_count, lt_escalation_item_count, zero_count, under_count, over_count,"
    " warehouse_health_score, forecast_accuracy_pct FROM {mart_exec_summary}",
    "qlib_s12": "SELECT item_code AS part_number, item_name AS component_name, manufacturer_name, latest_lt_weeks"
    f" FROM {{mart_lt_snapshot}} WHERE manufacturer_name = '{MANUFACTURER}'"
    " ORDER BY latest_lt_weeks DESC, item_id LIMIT 5",
}

_PLACEHOLDER = re.compile(r"\{(mart_[a-z_0-9]+)\}")


def marts_used(sql: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(sql)))


def run_library_query(spark: SparkSession, name: str, marts: dict[str, DataFrame]) -> DataFrame:
    sql = QLIB[name]
    return spark.sql(sql, **{m: marts[m] for m in marts_used(sql)})


def library_sql_for(name: str, table_names: dict[str, str]) -> str:
    """The library text with placeholders replaced by plain table names."""
    return _PLACEHOLDER.sub(lambda m: table_names[m.group(1)], QLIB[name])
