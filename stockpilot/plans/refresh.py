"""Scheduled refresh: every raw, cleansed and decision table as Parquet with
its table and column comments, each computed once and all published together.

    python -m stockpilot.plans.refresh --sf /root/testdata/sf0.1 --out <shared folder> [name ...]

The output folder must be shared storage on a cluster (default: a fresh
folder under the session's ``spark.checkpoint.dir``)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from stockpilot.params import DEFAULT, Params
from stockpilot.plans.context import Domain
from stockpilot.plans.graph import MartStore, refresh
from stockpilot.plans.layers import layer_root
from stockpilot.plans.registry import load_all

# Table comments of the main decision tables.
TABLE_COMMENTS: dict[str, str] = {
    "mart_lt_snapshot": "Latest lead time per component with N-1/N-3/N-6 comparison and trend codes.",
    "mart_lt_trend": "Lead-time history rows with month key and band.",
    "mart_lt_escalation": "Components whose lead time is up against 3 or 6 months ago.",
    "mart_order_risk": "Sales order lines with priority rank, adjustment action, reasons and risk score.",
    "mart_timeline": "Signed stock events per component with running balance and allocation.",
    "mart_projection": "Month-by-month projected customer stock and policy status per component.",
    "mart_breach": "Projected ZERO/UNDER/OVER months up to the cutoff with first breach per component.",
    "mart_warehouse": "Warehouse health: component classes, stock value, open inbound shipments.",
    "mart_source_health": "Row count and success flag per raw source.",
    "mart_exec_summary": "One-row executive KPIs.",
    "mart_action_queue": "Unified ranked action queue (orders, lead-time escalations, stock-outs).",
    "mart_options": "Four supply routes per demand with shortage, timing and action level.",
    "mart_fulfillment": "Build readiness per product and month.",
}
COLUMN_COMMENTS: dict[str, dict[str, str]] = {
    "mart_options": {
        "route_type": "CUSTOMER_STOCK, DISTRIBUTOR_FREE, EXISTING_PO or NEW_ORDER",
        "shortage_qty": "requested minus available; negative means surplus",
        "action_level": "NONE, LIGHT, MEDIUM or HEAVY",
    },
    "mart_order_risk": {"risk_score": "100 - 3 x days to due, clamped to 0..100; NULL due date scores 100"},
    "mart_projection": {"policy_status": "ZERO (<= 0), UNDER (< min), OVER (> max) or OK"},
}


def comments_of(name: str) -> dict:
    """Table and column comments to write with a table."""
    return {"comment": TABLE_COMMENTS.get(name), "column_comments": COLUMN_COMMENTS.get(name)}


def refresh_all(
    spark: SparkSession, sf_dir: str, out_root: str | None = None, names: list[str] | None = None,
    params: Params = DEFAULT,
) -> dict[str, str]:
    """Store every table below ``out_root`` and publish them (``graph.refresh``):
    each is computed once, and tables whose sources have not changed since the
    published run are kept; returns name -> path."""
    store = MartStore(spark, out_root or layer_root(spark), params)
    queries = load_all()
    wanted = {name: queries[name] for name in names or sorted(queries)}
    run = refresh(Domain.from_driver(spark, sf_dir, params), store, wanted, comments_of)
    return {name: node.path for name, node in run.nodes().items() if name in wanted}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", required=True)
    ap.add_argument("--out", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from stockpilot.session import apply_cluster_conf

    spark = SparkSession.builder.appName("stockpilot-refresh").getOrCreate()  # master and folders as submitted
    apply_cluster_conf(spark)
    for name, path in refresh_all(spark, a.sf, a.out, a.names or None).items():
        print(name, path)


if __name__ == "__main__":
    main()
