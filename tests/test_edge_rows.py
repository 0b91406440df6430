"""Hand-made boundary rows, one small table set per operator."""

import datetime as dt

from pyspark.sql import functions as F

from conftest import T, days, rows
from stockpilot.functions.columns import band
from stockpilot.operators import ledger, leadtime, procurement, recommend, warehouse
from stockpilot.operators.orders import delivery_risk, order_risk, stock_by_component
from stockpilot.operators.quality import dedupe, keep, quarantine, rules_for
from stockpilot.params import DEFAULT


def _comp(cid, **kw):
    base = {"component_id": cid, "part_number": f"PN-{cid}", "component_name": f"c{cid}", "supplier_id": "S1",
            "base_lead_time_weeks": 2, "min_stock": 10, "max_stock": 30, "unit_price_usd": 1.0}
    base.update(kw)
    return base


def test_order_rank_action_reason_score(make_domain):
    ds = [-1, 0, 3, 4, 7, 8, 14, 15, None]
    so = [
        {"sales_order_id": f"o{i}", "component_id": "c1" if i != 2 else "c2",
         "requested_delivery_date": None if n is None else days(n), "component_required_qty": 1}
        for i, n in enumerate(ds)
    ]
    dom = make_domain(
        sales_orders=so,
        components=[_comp("c1"), _comp("c2")],
        suppliers=[{"supplier_id": "S1", "supplier_name": "s"}],
        inventory_current=[{"component_id": "c1", "warehouse_id": "w", "stock_qty": 5}],
    )
    out = order_risk(dom["sales_orders"], dom["components"], stock_by_component(dom["inventory_current"]), DEFAULT)
    got = {r[0]: r[1:] for r in rows(out, "sales_order_id", "priority_rank", "risk_score", "adjustment_action",
                                      "risk_reason")}
    assert [got[f"o{i}"][0] for i in range(9)] == ["Critical"] * 3 + ["High"] * 2 + ["Mid"] * 2 + ["Low"] * 2
    # NULL due date: rank Low but score 100 (kept quirk)
    assert got["o8"][:2] == ("Low", 100)
    assert got["o0"][1] == 100 and got["o6"][1] == 58
    # 3 days with stock -> PULL_IN, without stock (c2) -> EMERGENCY_ORDER
    assert got["o1"][2] == "PULL_IN" and got["o2"][2] == "EMERGENCY_ORDER"
    assert got["o2"][3] == "due soon; no customer stock"
    assert got["o7"][3] == "none"


def test_risk_score_clamp(make_domain):
    dom = make_domain(sales_orders=[
        {"sales_order_id": f"o{n}", "component_id": "c", "requested_delivery_date": days(n)} for n in (-5, 0, 33, 34)
    ])
    out = order_risk(dom["sales_orders"], dom["components"], stock_by_component(dom["inventory_current"]), DEFAULT)
    assert dict(rows(out, "sales_order_id", "risk_score")) == {"o-5": 100, "o0": 100, "o33": 1, "o34": 0}


def test_lt_band_cut_points(spark):
    df = spark.createDataFrame([(w,) for w in (13, 14, 26, 27, 52, 53, 78, 79)], "w int")
    got = [r[0] for r in df.select(band(F.col("w"))).collect()]
    assert got == ["<=13w", "14-26w", "14-26w", "27-52w", "27-52w", "53-78w", "53-78w", ">78w"]


def test_lt_trend_and_tie_break(make_domain):
    lt = [
        # c1: nothing before T-1M -> '' everywhere
        {"lead_time_id": "a", "component_id": "c1", "effective_date": days(-5), "lead_time_weeks": 10},
        # c2: one row before T-3M (8), current 12 -> UP vs n3/n6 is '' (nothing before T-6M)
        {"lead_time_id": "b", "component_id": "c2", "effective_date": T - dt.timedelta(days=120), "lead_time_weeks": 8},
        {"lead_time_id": "c", "component_id": "c2", "effective_date": days(-1), "lead_time_weeks": 12},
        # c3: two rows on one date: larger weeks wins; earlier value larger -> DOWN
        {"lead_time_id": "d", "component_id": "c3", "effective_date": T - dt.timedelta(days=200), "lead_time_weeks": 20},
        {"lead_time_id": "e", "component_id": "c3", "effective_date": days(-2), "lead_time_weeks": 5},
        {"lead_time_id": "f", "component_id": "c3", "effective_date": days(-2), "lead_time_weeks": 7},
        # future row is ignored by the snapshot
        {"lead_time_id": "g", "component_id": "c3", "effective_date": days(10), "lead_time_weeks": 99},
    ]
    dom = make_domain(lead_times=lt)
    snap = leadtime.lt_snapshot(dom["lead_times"], DEFAULT)
    got = {r[0]: r[1:] for r in rows(snap, "item_id", "latest_lt_weeks", "trend_arrow_n1", "trend_arrow_n3",
                                      "trend_arrow_n6", "remark")}
    assert got["c1"] == (10, "", "", "", "")
    assert got["c2"] == (12, "UP", "UP", "", "lengthening, order early")
    assert got["c3"] == (7, "DOWN", "DOWN", "DOWN", "")
    esc = leadtime.lt_escalation(snap)
    assert rows(esc, "item_id", "escalation_reason") == [("c2", "up vs 3 months ago")]


def test_policy_status_and_projection_rules(make_domain):
    comps = [_comp(f"c{s}") for s in range(6)] + [_comp("cn", min_stock=None, max_stock=None)]
    stocks = {"c0": 0, "c1": 1, "c2": 9, "c3": 10, "c4": 30, "c5": 31, "cn": 500}
    inv = [{"component_id": c, "warehouse_id": "w", "stock_qty": q} for c, q in stocks.items()]
    # an order dated before the current month is ignored by the projection
    so = [{"sales_order_id": "old", "component_id": "c4", "requested_delivery_date": T - dt.timedelta(days=40),
           "component_required_qty": 25}]
    dom = make_domain(components=comps, inventory_current=inv, sales_orders=so)
    proj = ledger.projection(dom["components"], dom["inventory_current"], dom["sales_orders"],
                             dom["purchase_orders"], dom["forecasts"], dom["bom"], DEFAULT)
    cur = T.strftime("%Y-%m")
    got = dict(rows(proj.filter(F.col("month_end_date") == cur), "item_id", "policy_status"))
    assert got == {"c0": "ZERO", "c1": "UNDER", "c2": "UNDER", "c3": "OK", "c4": "OK", "c5": "OVER", "cn": "OK"}
    # defaults 100 / 1000 for missing min / max
    assert rows(proj.filter(F.col("item_id") == "cn").select("min_qty", "max_qty").distinct()) == [(100, 1000)]
    # the old order did not reduce c4 (past month counts as 0 use)
    assert rows(proj.filter((F.col("item_id") == "c4") & (F.col("month_end_date") == cur)), "customer_stock_proj") == [
        (30,)
    ]
    # breach in a past month is listed (no lower bound)
    brc = ledger.breach(proj, DEFAULT)
    assert brc.filter((F.col("item_id") == "c5") & (F.col("breach_date") < cur)).count() == 3


def test_timeline_ties_and_partial_received(make_domain):
    so = [
        {"sales_order_id": "b", "component_id": "c", "requested_delivery_date": days(5), "component_required_qty": 3},
        {"sales_order_id": "a", "component_id": "c", "requested_delivery_date": days(5), "component_required_qty": 2},
    ]
    po = [{"purchase_order_id": "p", "component_id": "c", "expected_delivery_date": days(5), "outstanding_qty": 4,
           "status": "partial_received"}]
    dom = make_domain(sales_orders=so, purchase_orders=po, components=[_comp("c")],
                      inventory_current=[{"component_id": "c", "warehouse_id": "w", "stock_qty": 1}])
    tl = ledger.timeline(dom["inventory_current"], dom["sales_orders"], dom["purchase_orders"], DEFAULT)
    got = rows(tl, "event_type", "order_no", "cumulative_balance", "allocated_qty",
               order=["cumulative_balance"])
    # order within the day: CONSUMPTION a, CONSUMPTION b, RECEIPT p
    assert sorted(got, key=lambda r: (r[0] != "ON_HAND", r[0], r[1])) == [
        ("ON_HAND", "", 1, 0), ("CONSUMPTION", "a", -1, 0), ("CONSUMPTION", "b", -4, 0), ("RECEIPT", "p", 0, 0)
    ]
    proj = ledger.projection(dom["components"], dom["inventory_current"], dom["sales_orders"],
                             dom["purchase_orders"], dom["forecasts"], dom["bom"], DEFAULT)
    assert proj.count() == 12
    assert proj.filter(F.col("inbound_qty_order_linked") > 0).count() == 0


def test_warehouse_without_stock(make_domain):
    dom = make_domain(warehouses=[{"warehouse_id": "9", "warehouse_name": "empty"}])
    out = warehouse.warehouse_status(dom["warehouses"], dom["inventory_current"], dom["components"],
                                     dom["logistics"], DEFAULT)
    assert rows(out, "health_score", "managed_count", "zero_count") == [(50.0, 0, 0)]


def _routes(dom):
    wide = procurement.demand_wide(dom["demand_plan_components"], dom["inventory_current"],
                                   dom["free_inventory"], dom["purchase_orders"], dom["components"], DEFAULT)
    return procurement.with_routes(wide, DEFAULT)


def test_consumption_and_levels(make_domain):
    dm = [
        # two forecast demands on one date see each other
        {"demand_id": "d1", "component_id": "c", "requested_date": days(30), "requested_qty": 5, "source_type": "FCST_AUTO"},
        {"demand_id": "d2", "component_id": "c", "requested_date": days(30), "requested_qty": 7, "source_type": "FCST_AUTO"},
        # emergency demand is not consumed by others
        {"demand_id": "d3", "component_id": "c", "requested_date": days(10), "requested_qty": 100,
         "source_type": "EMERGENCY_MANUAL"},
        # NULL component / NULL date -> 0
        {"demand_id": "d4", "component_id": None, "requested_date": days(30), "requested_qty": 1, "source_type": "FCST_AUTO"},
        {"demand_id": "d5", "component_id": "c", "requested_date": None, "requested_qty": 1, "source_type": "FCST_AUTO"},
        # requested before T with enough stock: NONE although late
        {"demand_id": "d6", "component_id": "c", "requested_date": days(-3), "requested_qty": 1,
         "source_type": "EMERGENCY_MANUAL"},
    ]
    dom = make_domain(demand_plan_components=dm, components=[_comp("c", base_lead_time_weeks=1)],
                      inventory_current=[{"component_id": "c", "warehouse_id": "w", "stock_qty": 10}])
    r = _routes(dom)
    cons = dict(rows(r, "demand_id", "consumption"))
    assert cons == {"d1": 7, "d2": 5, "d3": 0, "d4": 0, "d5": 0, "d6": 0}
    opts = procurement.options(r)
    assert opts.groupBy("demand_id").count().filter("count != 4").count() == 0
    lv = dict(rows(r, "demand_id", "action_level"))
    # d1: stock 10 - 7 = 3 < 5; new order in time (7 days) -> LIGHT
    assert lv["d1"] == "LIGHT"
    # no component: nothing available, new order late -> HEAVY
    assert lv["d4"] == "HEAVY"
    # customer stock late but enough -> NONE (timing not required)
    assert lv["d6"] == "NONE"


def test_no_open_po_and_combination(make_domain):
    dm = [
        {"demand_id": "m", "component_id": "c", "requested_date": days(1), "requested_qty": 6, "source_type": "FCST_AUTO"},
        {"demand_id": "h", "component_id": "c", "requested_date": days(1), "requested_qty": 7, "source_type": "EMERGENCY_MANUAL"},
    ]
    dom = make_domain(
        demand_plan_components=dm, components=[_comp("c", base_lead_time_weeks=50)],
        inventory_current=[{"component_id": "c", "warehouse_id": "w", "stock_qty": 3}],
        free_inventory=[{"free_inventory_id": "f", "component_id": "c", "qty_available": 3}],
    )
    r = _routes(dom)
    po = procurement.options(r).filter("route_type = 'EXISTING_PO'")
    assert set(rows(po, "eta_date", "is_in_time", "days_late", "confidence")) == {(None, None, 0, "EXPECTED")}
    lv = dict(rows(r, "demand_id", "action_level"))
    assert lv == {"m": "MEDIUM", "h": "HEAVY"}


def test_fulfillment_rate_thresholds(make_domain):
    def prod(pid, n_ok, n):
        return [{"demand_id": f"{pid}{i}", "component_id": "ok" if i < n_ok else "bad", "requested_date": days(20),
                 "requested_qty": 1, "source_type": "FCST_AUTO", "product_id": pid} for i in range(n)]

    dm = prod("A", 4, 5) + prod("B", 7, 9) + prod("C", 3, 3)
    dom = make_domain(demand_plan_components=dm,
                      inventory_current=[{"component_id": "ok", "warehouse_id": "w", "stock_qty": 10**6}])
    ful = procurement.fulfillment(_routes(dom), dom["products"], DEFAULT)
    got = {r[0]: r[1:] for r in rows(ful, "product_id", "fulfillment_rate", "production_status")}
    assert got == {"A": (0.8, "PARTIAL"), "B": (0.778, "BLOCKED"), "C": (1.0, "PRODUCIBLE")}


def test_delivery_risk_order_of_tests(make_domain):
    cases = {  # id: (days to requested, response -> deadline gap, response late)
        "a": (7, 3, False), "b": (7, 4, False), "c": (-1, 10, False), "d": (30, 7, False), "e": (60, 20, False),
        "f": (90, 20, True), "g": (None, None, False),
    }
    so = []
    for k, (dd, gap, late) in cases.items():
        req = None if dd is None else days(dd)
        resp = days(200) if late else days(0)
        so.append({"sales_order_id": k, "component_id": "c", "requested_delivery_date": req, "response_date": resp,
                   "deadline_date": None if gap is None else resp + dt.timedelta(days=gap)})
    dom = make_domain(sales_orders=so)
    got = dict(rows(delivery_risk(dom["sales_orders"], DEFAULT), "sales_order_id", "delivery_status"))
    assert got == {"a": "Critical", "b": "High", "c": "Critical", "d": "High", "e": "Medium", "f": "Medium",
                   "g": "Normal"}


def test_recommendations_and_pull_in_over_year_end(make_domain):
    dm = [
        {"demand_id": "x", "component_id": "c", "requested_date": dt.date(1998, 12, 20), "requested_qty": 10,
         "source_type": "EMERGENCY_MANUAL"},
        {"demand_id": "n1", "component_id": "c", "requested_date": dt.date(1999, 1, 5), "requested_qty": 3,
         "source_type": "FCST_AUTO"},
        {"demand_id": "n2", "component_id": "c", "requested_date": dt.date(1999, 1, 25), "requested_qty": 4,
         "source_type": "FCST_AUTO"},
    ]
    dom = make_domain(
        demand_plan_components=dm, components=[_comp("c", base_lead_time_weeks=0)],
        inventory_current=[{"component_id": "c", "warehouse_id": "w", "stock_qty": 6}],
        free_inventory=[{"free_inventory_id": "f", "component_id": "c", "qty_available": 5}],
        purchase_orders=[{"purchase_order_id": "p", "component_id": "c", "expected_delivery_date": days(3),
                          "outstanding_qty": 4, "status": "placed"}],
    )
    pulls = recommend.pull_in(dom["demand_plan_components"])
    assert dict(rows(pulls, "demand_id", "pull_in_qty"))["x"] == 3  # floor(7 / 2), January
    totals = recommend.month_totals(dom["demand_plan_components"])
    acts = recommend.actions(_routes(dom), totals, DEFAULT).filter("demand_id = 'x'")
    got = rows(acts, "option_rank", "option_code", "coverage_qty", "gap_qty", order=["option_rank"])
    codes = [g[1] for g in got]
    # customer 6 - consumption 0 (forecasts dated later) -> customer+free combination;
    # PO covers 4 of 10; pull-in 3; new order always
    assert codes == ["CUSTOMER_PLUS_FREE", "EXPEDITE_PO", "PULL_IN_NEXT_MONTH", "NEW_ORDER"]
    assert got[1][2:] == (4, 6)
    titles = rows(acts, "title", "steps", order=["option_rank"])
    assert titles[1] == ("Expedite the open PO backlog", "confirm and expedite 4 of the open PO backlog\n"
                         f"earliest arrival {days(3)}\ncover the missing 6 by another route")


def test_repeated_demand_ids_keep_their_rows_and_never_consume_themselves(make_domain):
    def row(i, day, qty, source="FCST_AUTO"):
        return {"demand_id": i, "component_id": "c", "requested_date": days(day), "requested_qty": qty, "source_type": source}

    dm = [row("d", 1, 3), row("d", 5, 4), row("d", 5, 4), row("e", 3, 2), row("f", 6, 1, "EMERGENCY_MANUAL")]
    dom = make_domain(demand_plan_components=dm, components=[_comp("c")])
    want = sorted(
        (x["demand_id"], x["requested_date"], sum(
            o["requested_qty"] for o in dm if o["source_type"] == "FCST_AUTO" and o["demand_id"] != x["demand_id"]
            and o["requested_date"] <= x["requested_date"]))
        for x in dm
    )
    assert sorted(rows(dom.mart("demand_routes"), "demand_id", "requested_date", "consumption")) == want


def test_quarantine_covers_every_table_with_drop_rules(make_domain):
    from stockpilot.plans.registry import load_all

    dom = make_domain(
        inventory=[{"component_id": "c", "warehouse_id": "w", "stock_qty": -1}, {"component_id": "c", "stock_qty": 1}],
        suppliers=[{"supplier_name": "nameless"}],
    )
    got = rows(load_all()["dq_quarantine"](dom), "table_name", "failed_rules", order=["table_name"])
    assert got == [("inventory", "stock_non_negative"), ("suppliers", "supplier_id_not_null")]


def test_whatif_window_and_missing_po(make_domain):
    dm = [
        {"demand_id": "past", "component_id": "c", "requested_date": days(-3), "requested_qty": 50, "source_type": "FCST_AUTO"},
        {"demand_id": "in", "component_id": "c", "requested_date": days(4), "requested_qty": 2,
         "source_type": "EMERGENCY_MANUAL"},
        {"demand_id": "late", "component_id": "c", "requested_date": days(40), "requested_qty": 9, "source_type": "FCST_AUTO"},
    ]
    dom = make_domain(demand_plan_components=dm, components=[_comp("c", base_lead_time_weeks=3)],
                      inventory_current=[{"component_id": "c", "warehouse_id": "w", "stock_qty": 10}])
    sc = dom.spark.createDataFrame([("s", "c", 5, days(5))], "scenario_id string, component_id string, req_qty int, req_date date")
    wf = recommend.whatif(sc, dom["demand_plan_components"], dom["inventory_current"],
                          dom["free_inventory"], dom["purchase_orders"], dom["components"], DEFAULT)
    cust = wf.filter("route_type = 'CUSTOMER_STOCK'").first()
    assert (cust["consumption"], cust["cust_effective"], cust["shortage_qty"]) == (2, 8, 0)
    po = wf.filter("route_type = 'EXISTING_PO'").first()
    assert po["eta_date"] == days(21) and po["shortage_qty"] == 5


def test_quality_null_rule_and_dedupe(spark):
    from stockpilot.sources.schemas import SCHEMAS

    bom = spark.createDataFrame([("p", "c", None), ("p", "c2", 2), ("p", None, 1)], SCHEMAS["bom"])
    rules = rules_for("bom")
    kept, quar = keep(bom, rules), quarantine(bom, rules)
    assert kept.count() + quar.count() == bom.count() == 3
    assert rows(quar, "failed_rules", order=["failed_rules"]) == [("bom_keys_present",), ("bom_qty_positive",)]
    sup = spark.createDataFrame([("s", "b", None, None), ("s", "a", None, None)], SCHEMAS["suppliers"])
    assert rows(dedupe(sup, "supplier_id"), "supplier_name") == [("a",)]


def test_marts_on_empty_inputs(make_domain):
    """Every mart runs on empty tables and returns no rows (the warehouse
    and summary marts return their fixed shapes)."""
    from stockpilot.plans.registry import load_all

    dom = make_domain()
    q = load_all()
    for name in ("mart_timeline", "mart_options", "mart_fulfillment", "mart_lt_snapshot", "mart_projection",
                 "mart_breach", "mart_order_risk", "mart_action_queue", "whatif", "rec_actions", "bom_bottleneck"):
        assert q[name](dom).count() == 0, name
    assert q["mart_exec_summary"](dom).count() == 1
    assert q["opt_level_counts"](dom).count() == 4
