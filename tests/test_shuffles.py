"""Joins and groups that would shuffle many rows more often than their job needs."""

import datetime as dt
import re

import pytest

from conftest import SF001, T, days
from stockpilot.operators import ledger
from stockpilot.params import DEFAULT
from stockpilot.plans.context import Domain
from stockpilot.plans.registry import load_all
from stockpilot.sources.driver import DriverAdapter


@pytest.fixture
def no_broadcast(spark):
    """Tables count as large: each join shuffles."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_customers_join_the_orders_not_the_lines(spark):
    plan = optimized(Domain.from_driver(spark, SF001).raw["logistics"])
    depth = {k: line.index("Join") for line in plan.splitlines() for k in ("c_custkey", "l_orderkey") if re.search(rf"Join.*{k}", line)}
    assert depth["c_custkey"] > depth["l_orderkey"]


def test_logistics_of_repeated_and_missing_keys(spark):
    day = dt.datetime(1998, 1, 5)
    line = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_quantity double, l_returnflag string, l_linestatus string, l_discount double"
    t = {
        "lineitem": spark.createDataFrame([(k, 1, 1, 1, day, 2.0, "N", "O", 0.0) for k in (1, 2, 3, 4, None)], line),
        # order 2 comes twice, 3 has a customer that is not there, 4 one without nation, one order has no customer
        "orders": spark.createDataFrame([(1, 1, day, "x"), (2, 1, day, "x"), (2, 2, day, "x"), (3, 9, day, "x"), (4, 3, day, "x"), (1, None, day, "x")], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": spark.createDataFrame([(1, 7), (2, 8), (2, 9), (3, None)], "c_custkey long, c_nationkey int"),
        "part": spark.createDataFrame([(1, "b", "t", 3, 5.0)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double"),
    }
    got = [(r.shipment_id[0], r.destination_warehouse_id) for r in DriverAdapter(t, DEFAULT).logistics().collect()]
    assert sorted(got, key=str) == [("1", "7"), ("2", "7"), ("2", "8"), ("2", "9"), ("4", None)]


def test_lead_times_shuffle_the_lines_once(spark, no_broadcast):
    plan = Domain.from_driver(spark, SF001).raw["lead_times"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # lines and parts, for their join


def test_forecast_months_join_last(make_domain):
    fc = [{"forecast_id": str(m), "product_id": "P", "forecast_month": dt.date(1998, m, 1), "forecast_qty": 10 * m} for m in (7, 8)]
    fc += [{"forecast_id": "q", "product_id": "Q", "forecast_month": dt.date(1998, 7, 1), "forecast_qty": 1}]
    dom = make_domain(
        forecasts=fc,
        bom=[{"product_id": p, "component_id": c, "quantity_per_unit": 2} for p, c in (("P", "A"), ("P", "B"), ("R", "A"))],
        components=[{"component_id": "A", "supplier_id": "s", "base_lead_time_weeks": 1}],
        products=[{"product_id": "P", "product_name": "pump", "customer_id": "c"}],
        customers=[{"customer_id": "c", "customer_name": "Cust"}],
        purchase_orders=[{"purchase_order_id": str(i), "component_id": "A", "outstanding_qty": 50} for i in (1, 2)],
    )
    risk = load_all()["risk_forecast"](dom)
    first = next(line for line in optimized(risk).splitlines() if "Join" in line)
    assert "Join Inner" in first and "product_id" in first  # the masters are joined below it
    got = {(r.component_id, r.forecast_month.month): (r.customer_name, r.component_demand_qty, r.ordered_qty, r.unordered_qty, r.base_lead_time_weeks) for r in risk.collect()}
    assert got == {
        ("A", 7): ("Cust", 140, 100, 40, 1), ("A", 8): ("Cust", 160, 100, 60, 1),
        ("B", 7): ("Cust", 140, 0, 140, None), ("B", 8): ("Cust", 160, 0, 160, None),
    }


def _so(i, item, n):
    return {"sales_order_id": i, "component_id": item, "requested_delivery_date": days(n), "component_required_qty": 1}


def test_balances_of_the_shown_item_only(make_domain, monkeypatch):
    seen, balance = [], ledger.with_balance

    def watched(ev, *a, **k):
        seen.append({r.item_id for r in ev.collect()})
        return balance(ev, *a, **k)

    monkeypatch.setattr(ledger, "with_balance", watched)
    dom = make_domain(
        sales_orders=[_so("1", "A", 1), _so("2", "B", 2), _so("3", "B", 3)],
        inventory_current=[{"component_id": c, "stock_qty": 5} for c in ("A", "B")],
    )
    got = sorted((r.event_date, r.cumulative_balance) for r in load_all()["inv_ledger"](dom).collect())
    assert got == [(T, 5), (days(2), 4), (days(3), 3)]
    assert seen == [{"B"}]


def test_rows_without_an_item_are_no_item(make_domain):
    """As before: where most rows have no item, the list is empty."""
    dom = make_domain(
        sales_orders=[_so("1", "A", 1)],
        purchase_orders=[{"purchase_order_id": str(i), "status": "placed", "outstanding_qty": 1, "expected_delivery_date": days(i)} for i in range(3)],
    )
    assert load_all()["inv_ledger"](dom).count() == 0
