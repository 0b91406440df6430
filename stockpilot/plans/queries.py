"""Registered non-mart operators (analytics, KPIs, quality reports)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockpilot.operators import leadtime
from stockpilot.plans.incremental import OnlyComponents
from stockpilot.plans.registry import query
from stockpilot.session import ensure_checkpoint_dir


@query("lt_kpi")
def _lt_kpi(dom):
    return leadtime.lt_kpi(dom.mart("mart_lt_snapshot"))


@query("lt_surge")
def _lt_surge(dom):
    return leadtime.lt_surge(dom.mart("mart_lt_escalation"), dom.p)


@query("lt_band_trend")
def _lt_band_trend(dom):
    return leadtime.band_trend_counts(dom.mart("mart_lt_snapshot"))


from stockpilot.operators import ledger  # noqa: E402


@query("inv_balance_status")
def _inv_balance(dom):
    return ledger.balance_status(dom.mart("mart_projection"))


@query("inv_inout")
def _inv_inout(dom):
    return ledger.inbound_outbound(dom.mart("mart_timeline"))


@query("inv_health")
def _inv_health(dom):
    return ledger.inventory_health(dom.mart("mart_projection"), dom.p)


@query("inv_item_status")
def _inv_item_status(dom):
    return ledger.item_status(dom.mart("mart_projection"), dom.p)


from stockpilot.operators import procurement  # noqa: E402


@query("opt_best_route")
def _opt_best(dom):
    return dom.mart("best_route")


@query("opt_needs_action")
def _opt_needs(dom):
    return procurement.needs_action(dom.mart("best_route"))


@query("opt_level_counts")
def _opt_levels(dom):
    return procurement.level_counts(dom.mart("best_route"))


@query("opt_level_filter")
def _opt_level_filter(dom):
    return procurement.filter_levels(dom.mart("best_route"), ["HEAVY", "MEDIUM"])


@query("dash_needs_top")
def _dash_needs_top(dom):
    return procurement.needs_top(dom.mart("best_route"), dom["components"], dom.p)


@query("page_three_route")
def _three_route(dom):
    return procurement.three_route(dom.mart("demand_routes"), dom.p)


@query("kpi_fulfillment")
def _kpi_ful(dom):
    return procurement.fulfillment_kpi(dom.mart("mart_fulfillment"))


@query("bom_chain")
def _bom_chain(dom):
    return procurement.bom_chain(dom.mart("mart_fulfillment"))


@query("bom_drill")
def _bom_drill(dom):
    return procurement.bom_drill(dom.mart("demand_routes"), dom["components"], dom.p)


@query("bom_bottleneck")
def _bom_bottleneck(dom):
    return procurement.bom_bottleneck(dom.mart("demand_routes"), dom["components"], dom.p)


from functools import reduce  # noqa: E402

from pyspark.sql import DataFrame  # noqa: E402

from stockpilot.operators import orders, quality, summary, warehouse  # noqa: E402
from stockpilot.operators.cleanse import _base  # noqa: E402
from stockpilot.sources.schemas import TABLES  # noqa: E402


@query("wh_rank")
def _wh_rank(dom):
    return warehouse.warehouse_rank(dom.mart("mart_warehouse"), dom.p.hub_warehouse_id)


@query("ship_recent")
def _ship_recent(dom):
    return warehouse.shipments_recent(dom["logistics"], dom.p)


@query("ship_delays")
def _ship_delays(dom):
    return warehouse.shipment_delays(dom["logistics"], dom.p)


@query("ship_routes")
def _ship_routes(dom):
    inbound = warehouse.routes_by_direction(dom["shipment_routes"], "inbound")
    return inbound.unionByName(warehouse.routes_by_direction(dom["shipment_routes"], "outbound"))


@query("clean_inventory")
def _clean_inventory(dom):
    return dom["inventory"]


@query("clean_warehouse_components")
def _clean_warehouse_components(dom):
    return dom["warehouse_components"]


@query("flt_band_trend")
def _flt_band_trend(dom):
    return leadtime.filter_band_trend(dom.mart("mart_lt_snapshot"), "27-52w", "UP")


@query("flt_split_sides")
def _flt_split_sides(dom):
    """Both sides of the actual / forecast split; the as-of day is on both."""
    before, after = analytics.split_actual_forecast(dom.mart("mart_timeline"), "event_date", dom.p)
    return before.withColumn("side", F.lit("ACTUAL")).unionByName(after.withColumn("side", F.lit("FORECAST")))


@query("free_kpi")
def _free_kpi(dom):
    return warehouse.free_stock_kpi(dom["free_inventory"], dom["components"])


@query("free_top")
def _free_top(dom):
    return warehouse.free_stock_top(dom["free_inventory"], dom["components"])


@query("free_leverage")
def _free_leverage(dom):
    return warehouse.free_leverage(dom["free_inventory"], dom.mart("stock_by_component"), dom["components"])


@query("src_kpi")
def _src_kpi(dom):
    return summary.source_kpi(dom.mart("mart_source_health"))


@query("dq_report")
def _dq_report(dom):
    parts = [quality.rule_report(_base(dom.raw[t], t), t, quality.rules_for(t)) for t in TABLES if quality.rules_for(t)]
    return reduce(DataFrame.unionByName, parts)


@query("dq_quarantine")
def _dq_quarantine(dom):
    """Rejected rows of every table with drop rules, each as a JSON record."""
    tables = [t for t in TABLES if quality.rules_for(t, quality.DROP)]
    return reduce(DataFrame.unionByName, [quality.quarantine_records(_base(dom.raw[t], t), t) for t in tables])


@query("dq_quarantine_demand")
def _dq_quarantine_demand(dom):
    t = "demand_plan_components"
    return quality.quarantine(_base(dom.raw[t], t), quality.rules_for(t))


@query("dq_null_rate")
def _dq_null_rate(dom):
    parts = [quality.null_rate(dom.raw[t], t, list(quality.KEY_COLUMNS[t])) for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


@query("risk_delivery")
def _risk_delivery(dom):
    return orders.delivery_risk(dom["sales_orders"], dom.p)


from stockpilot.operators import recommend  # noqa: E402


def _scenarios(dom):
    return recommend.scenarios_from_emergencies(dom["demand_plan_components"])


def _whatif(dom):
    if "whatif" not in dom._marts:
        dom._marts["whatif"] = recommend.whatif(
            _scenarios(dom), dom["demand_plan_components"], dom["inventory_current"], dom["free_inventory"],
            dom["purchase_orders"], dom["components"], dom.p,
        )
    return dom._marts["whatif"]


@query("rec_pull_in")
def _rec_pull_in(dom):
    return recommend.pull_in(dom["demand_plan_components"])


@query("rec_actions")
def _rec_actions(dom):
    return recommend.actions(dom.mart("demand_routes"), recommend.month_totals(dom["demand_plan_components"]), dom.p)


@query("whatif")
def _whatif_q(dom):
    return _whatif(dom)


@query("whatif_impact")
def _whatif_impact(dom):
    return recommend.where_used(dom["bom"], dom["products"], _scenarios(dom))


@query("whatif_brief")
def _whatif_brief(dom):
    return recommend.whatif_brief(_whatif(dom))


from stockpilot.operators import analytics, ledger as _ledger  # noqa: E402


def _frisk(dom):
    return analytics.forecast_risk(dom["forecasts"], dom["bom"], dom["components"], dom["products"],
                                   dom["customers"], dom["purchase_orders"], dom.p)


def _avail(dom):
    return analytics.available_stock(dom["components"], dom.mart("stock_by_component"), dom["sales_orders"], dom.p)


def _comp_monthly(dom):
    return analytics.forecast_component_monthly(dom["forecasts"], dom["bom"])


def _backlog(dom):
    return analytics.backlog(dom["components"], dom["sales_orders"], dom["purchase_orders"])


@query("risk_forecast")
def _risk_forecast(dom):
    return _frisk(dom)


@query("inv_available")
def _inv_available(dom):
    return _avail(dom)


@query("kpi_overview")
def _kpi_overview(dom):
    return analytics.overview_kpis(
        _frisk(dom), orders.delivery_risk(dom["sales_orders"], dom.p), _avail(dom),
        _ledger.balance_status(dom.mart("mart_projection")),
    )


@query("kpi_demand")
def _kpi_demand(dom):
    return analytics.demand_kpis(dom["demand_plan_components"], dom.p)


@query("kpi_stock")
def _kpi_stock(dom):
    return analytics.stock_kpis(dom["inventory_current"], dom["free_inventory"])


@query("flt_period")
def _flt_period(dom):
    return analytics.filter_period(dom["demand_plan_components"], "requested_date", dom.p, 90)


@query("flt_due_bucket")
def _flt_due_bucket(dom):
    return analytics.due_bucket_counts(dom.mart("mart_order_risk"))


@query("flt_search")
def _flt_search(dom):
    return analytics.search(dom["components"], "Red W", ["component_id", "part_number", "component_name"])


@query("page_monthly_demand")
def _page_monthly_demand(dom):
    return analytics.monthly_demand(dom["demand_plan_components"], dom.p)


@query("page_fcst_accuracy")
def _page_fcst_accuracy(dom):
    return analytics.forecast_accuracy(dom["forecasts"], dom.raw["actuals"], dom["products"], dom.p)


@query("page_commit_list")
def _page_commit_list(dom):
    return analytics.commit_list(dom.mart("mart_order_risk"))


@query("page_commit_bottleneck")
def _page_commit_bottleneck(dom):
    risk = dom.mart("mart_order_risk")
    # the options of the few components that are shown, not of all
    items = analytics.critical_lines(risk).select(F.col("component_id").alias("item"))
    return analytics.commit_bottleneck(risk, OnlyComponents(dom, items).domain().mart("mart_options"))


@query("inv_daily_demand")
def _inv_daily_demand(dom):
    return analytics.daily_demand(dom["components"], _comp_monthly(dom), dom.p)


@query("inv_backlog")
def _inv_backlog(dom):
    return _backlog(dom)


@query("inv_effective_stock")
def _inv_effective(dom):
    return analytics.effective_stock(_backlog(dom), dom.mart("stock_by_component"))


@query("agg_peak")
def _agg_peak(dom):
    return analytics.peak_consumption(_comp_monthly(dom), dom.p)


@query("agg_capacity")
def _agg_capacity(dom):
    return analytics.route_capacity(dom["components"], dom.mart("stock_by_component"), dom["free_inventory"],
                                    dom["purchase_orders"])


@query("metric_coverage_weeks")
def _metric_coverage(dom):
    return analytics.coverage_weeks(dom.mart("mart_projection"), dom.p)


@query("metric_breach_3m")
def _metric_breach_3m(dom):
    return analytics.breach_3m(dom.mart("mart_breach"), dom.p)


from stockpilot.operators import semantic  # noqa: E402


def _qlib(name):
    def run(dom):
        return semantic.run_library_query(
            dom.spark, name, {m: dom.mart(m) for m in semantic.marts_used(semantic.QLIB[name])}
        )

    return run


for _name in semantic.QLIB:
    query(_name)(_qlib(_name))


from stockpilot.streaming.ingest import ingest_events  # noqa: E402
from stockpilot.streaming.upsert import latest_events  # noqa: E402


@query("stream_ingest")
def _stream_ingest(dom):
    return ingest_events(dom.spark, dom.sf_dir)


@query("stream_latest_events")
def _stream_latest_events(dom):
    return latest_events(dom.spark, dom.sf_dir)


@query("flt_global")
def _flt_global(dom):
    return analytics.filter_lists(
        dom.mart("mart_order_risk"),
        {"supplier_name": ["Supplier#000000001", "Supplier#000000002"], "priority_rank": ["Critical", "High"]},
    )


@query("flt_split")
def _flt_split(dom):
    return analytics.actual_forecast_flag(dom.mart("mart_timeline"), "event_date", dom.p)


@query("flt_item_by_status")
def _flt_item_by_status(dom):
    return analytics.items_with_status(dom.mart("mart_projection"), "ZERO")


@query("inv_ledger")
def _inv_ledger(dom):
    events = _ledger.events(dom["inventory_current"], dom["sales_orders"], dom["purchase_orders"], dom.p)
    # the balances of the item that is shown, not of all
    ensure_checkpoint_dir(dom.spark)
    item = analytics.busiest_item(events).select(F.col("item_id").alias("item")).checkpoint()
    return analytics.busiest_item_ledger(OnlyComponents(dom, item).domain().mart("mart_timeline"))


@query("whatif_verdict")
def _whatif_verdict(dom):
    return analytics.whatif_verdicts(_whatif(dom))


from stockpilot.functions.columns import LEVEL_LABELS, ROUTE_LABELS, SOURCE_LABELS, label  # noqa: E402


@query("fn_label")
def _fn_label(dom):
    """Best route per demand with display labels and display column names."""

    b = dom.mart("best_route")
    return b.select(
        "demand_id",
        "component_id",
        label(F.col("route_type"), ROUTE_LABELS).alias("route_label"),
        label(F.col("action_level"), LEVEL_LABELS).alias("priority_label"),
        label(F.col("source_type"), SOURCE_LABELS).alias("source_label"),
    ).withColumnsRenamed({"demand_id": "Demand", "component_id": "Component", "route_label": "Recommended route",
                          "priority_label": "Priority", "source_label": "Source"})


from stockpilot.operators.asof import asof_join  # noqa: E402


@query("asof_order_lead_time")
def _asof_order_lead_time(dom):
    """The lead time in force when each sales order line is due."""
    lines = dom["sales_orders"].select("sales_order_id", "component_id", "requested_delivery_date")
    history = dom["lead_times_base"].select("component_id", "effective_date", "lead_time_weeks", "lead_time_id")
    return asof_join(lines, history, ["component_id"], "requested_delivery_date", "effective_date", ["lead_time_weeks", "lead_time_id"])
