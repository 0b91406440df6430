"""Wiring: mart name -> builder over a Domain.  Marts that feed other marts
are fetched through ``dom.mart`` so each is one shared logical subtree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from stockpilot.operators import orders

MART_BUILDERS: dict[str, Callable] = {}


def mart(name: str):
    def deco(fn):
        MART_BUILDERS[name] = fn
        return fn

    return deco


@mart("stock_by_component")
def _stock(dom) -> DataFrame:
    return orders.stock_by_component(dom["inventory_current"])


@mart("mart_order_risk")
def _order_risk(dom) -> DataFrame:
    return orders.order_risk(dom["sales_orders"], dom["components"], dom.mart("stock_by_component"), dom.p)


from stockpilot.operators import leadtime  # noqa: E402


@mart("mart_lt_snapshot")
def _lt_snapshot(dom) -> DataFrame:
    return leadtime.lt_snapshot(dom["lead_times_base"], dom.p, dom["components"], dom["suppliers"])


@mart("mart_lt_trend")
def _lt_trend(dom) -> DataFrame:
    return leadtime.lt_trend(dom["lead_times"])


@mart("mart_lt_escalation")
def _lt_escalation(dom) -> DataFrame:
    return leadtime.lt_escalation(dom.mart("mart_lt_snapshot"))


from stockpilot.operators import ledger  # noqa: E402


@mart("mart_timeline")
def _timeline(dom) -> DataFrame:
    return ledger.timeline(dom["inventory_current"], dom["sales_orders"], dom["purchase_orders"], dom.p)


@mart("mart_projection")
def _projection(dom) -> DataFrame:
    return ledger.projection(
        dom["components"], dom["inventory_current"], dom["sales_orders"], dom["purchase_orders"],
        dom["forecasts"], dom["bom"], dom.p,
    )


@mart("mart_breach")
def _breach(dom) -> DataFrame:
    return ledger.breach(dom.mart("mart_projection"), dom.p)


from stockpilot.operators import procurement  # noqa: E402


@mart("demand_routes")
def _demand_routes(dom) -> DataFrame:
    wide = procurement.demand_wide(
        dom["demand_plan_components"], dom["inventory_current"], dom["free_inventory"],
        dom["purchase_orders"], dom["components"], dom.p,
    )
    return procurement.with_routes(wide, dom.p)


@mart("mart_options")
def _options(dom) -> DataFrame:
    return procurement.options(dom.mart("demand_routes"))


@mart("mart_fulfillment")
def _fulfillment(dom) -> DataFrame:
    return procurement.fulfillment(dom.mart("demand_routes"), dom["products"], dom.p)


@mart("best_route")
def _best_route(dom) -> DataFrame:
    return procurement.best_route(dom.mart("demand_routes"))


from stockpilot.operators import summary, warehouse  # noqa: E402


@mart("mart_warehouse")
def _warehouse(dom) -> DataFrame:
    return warehouse.warehouse_status(
        dom["warehouses"], dom["inventory_current"], dom["components"], dom["logistics"], dom.p
    )


@mart("mart_source_health")
def _source_health(dom) -> DataFrame:
    return summary.source_health(dom.raw, dom.p)


@mart("mart_exec_summary")
def _exec_summary(dom) -> DataFrame:
    return summary.exec_summary(
        dom.mart("mart_order_risk"), dom.mart("mart_lt_escalation"), dom.mart("mart_breach"),
        dom.mart("mart_warehouse"), dom["forecasts"], dom.p,
    )


@mart("mart_action_queue")
def _action_queue(dom) -> DataFrame:
    return summary.action_queue(
        dom.mart("mart_order_risk"), dom.mart("mart_lt_escalation"), dom.mart("mart_breach"), dom.p
    )
