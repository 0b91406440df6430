"""Incremental decision tables equal the full computation after any changes."""

import random

import pytest

from conftest import T, days
from stockpilot.plans.context import Domain
from stockpilot.plans.incremental import KEYS, IncrementalMart, changed_points
from stockpilot.plans.marts import MART_BUILDERS
from tools_oracle import same_rows

ITEMS = ["c1", "c2", "c3", "c4", "c5"]


def world(r):
    one = lambda *some: r.choice(some)
    day = lambda: one(None, *[days(k) for k in range(-60, 90, 15)])
    item = lambda: one(*ITEMS, "c1", "c1", "c9")
    q = lambda: r.randint(1, 60)
    return {
        "components": [{"component_id": c, "part_number": "p" + c, "component_name": "n" + c, "supplier_id": "s", "min_stock": one(None, 10), "base_lead_time_weeks": one(None, 3)} for c in ITEMS],
        "suppliers": [{"supplier_id": "s", "supplier_name": "S"}],
        "products": [{"product_id": "a", "product_name": "A"}, {"product_id": "b", "product_name": "B"}],
        "bom": [{"product_id": one("a", "b"), "component_id": c, "quantity_per_unit": r.randint(1, 3)} for c in ITEMS],
        "inventory_current": [{"component_id": item(), "warehouse_id": str(k), "stock_qty": q()} for k in range(8)],
        "sales_orders": [{"sales_order_id": f"so{k}", "component_id": item(), "requested_delivery_date": day(), "component_required_qty": q()} for k in range(40)],
        "purchase_orders": [{"purchase_order_id": f"po{k}", "component_id": item(), "expected_delivery_date": day(), "outstanding_qty": q(), "status": one("placed", "shipped", "received", "partial_received")} for k in range(30)],
        "forecasts": [{"forecast_id": f"f{k}", "product_id": one("a", "b"), "forecast_month": T.replace(day=1, month=T.month + k % 4), "forecast_qty": q()} for k in range(8)],
        "free_inventory": [{"free_inventory_id": f"fr{k}", "component_id": item(), "qty_available": q()} for k in range(4)],
        "demand_plan_components": [{"demand_id": f"d{k % 17}", "component_id": item(), "requested_date": day(), "requested_qty": q(), "source_type": "FCST_AUTO"} for k in range(20)],
    }


def changed(r, tables):
    """Another version of some tables: rows removed, added and rewritten; and the rows that differ."""
    new, rows = {k: list(v) for k, v in tables.items()}, {}
    fresh = world(r)
    for t in r.sample(["sales_orders", "purchase_orders", "inventory_current", "forecasts", "free_inventory", "demand_plan_components"], 3):
        gone = [new[t].pop(r.randrange(len(new[t]))) for _ in range(r.randint(0, 2))]
        added = r.sample(fresh[t], r.randint(0, 2))
        if t in ("sales_orders", "purchase_orders"):
            key = "sales_order_id" if t == "sales_orders" else "purchase_order_id"
            added = [{**a, key: f"new{k}-{r.random()}"} for k, a in enumerate(added)]
        new[t] += added
        rows[t] = gone + added
    return new, rows


def test_updates_equal_the_full_computation(spark, make_domain, tmp_path):
    r = random.Random(2)
    tables = world(r)
    dom = make_domain(**tables)
    marts = {n: IncrementalMart(spark, str(tmp_path), n, buckets=2) for n in KEYS}
    for m in marts.values():
        m.store(dom)
    for epoch in (1, 2):
        tables, rows = changed(r, tables)
        dom = make_domain(**tables)
        changes = {t: make_domain(**{t: some}).raw[t] for t, some in rows.items()}
        points = changed_points(changes, dom["bom"])
        for n, m in marts.items():
            m.update(dom, points, epoch)
            assert same_rows(m.read(), MART_BUILDERS[n](make_domain(**tables))), (n, epoch)


def test_only_touched_buckets_and_later_events_are_computed(spark, make_domain, tmp_path):
    order = lambda k, c, d, q: {"sales_order_id": k, "component_id": c, "requested_delivery_date": d, "component_required_qty": q}
    tables = {
        "inventory_current": [{"component_id": c, "warehouse_id": "1", "stock_qty": 100} for c in ITEMS],
        "sales_orders": [order(f"{c}{k}", c, days(k), 10) for c in ITEMS for k in (1, 2, 3)],
    }
    m = IncrementalMart(spark, str(tmp_path), "mart_timeline", buckets=16)
    m.store(make_domain(**tables))
    before = m._newest()
    # the source forgets the early orders: what stands before the change is not computed again
    new = [order("c1n", "c1", days(3), 7)]
    later = {**tables, "sales_orders": [o for o in tables["sales_orders"] if o["requested_delivery_date"] == days(3)] + new}
    points = changed_points({"sales_orders": make_domain(sales_orders=new).raw["sales_orders"]}, make_domain(**later)["bom"])
    m.update(make_domain(**later), points, 1)
    after = m._newest()
    assert sum(before[b] != after[b] for b in before) == 1
    rows = m.read().filter("item_id = 'c1'").orderBy("event_date", "order_no").collect()
    assert [(x.order_no, x.cumulative_balance) for x in rows if x.order_no] == [("c11", 90), ("c12", 80), ("c13", 70), ("c1n", 63)]
    m.update(make_domain(**tables), points, 1)  # a replay changes nothing
    assert m._newest() == after and m.read().count() == 5 * 4 + 1


def test_nothing_changed_and_nothing_left(spark, make_domain, tmp_path):
    tables = {"inventory_current": [{"component_id": "c1", "warehouse_id": "1", "stock_qty": 5}]}
    m = IncrementalMart(spark, str(tmp_path), "mart_timeline", buckets=2)
    with pytest.raises(ValueError):
        m.read()
    m.store(make_domain(**tables))
    raw = make_domain(**tables).raw["inventory_current"]
    m.update(make_domain(**tables), changed_points({"inventory_current": raw.limit(0)}, make_domain()["bom"]), 1)
    assert m.read().count() == 1
    m.update(make_domain(), changed_points({"inventory_current": raw}, make_domain()["bom"]), 2)
    assert m.read().count() == 0


def test_sources_are_read_for_changed_components_only(spark, make_domain):
    from stockpilot.plans.incremental import OnlyComponents

    r = random.Random(3)
    dom = make_domain(**world(r))
    only = OnlyComponents(dom, spark.createDataFrame([("c2",)], "item string")).domain()
    for t in ("sales_orders", "purchase_orders", "inventory_current", "demand_plan_components"):
        assert {x.component_id for x in only[t].collect()} <= {"c2"}
    used = {x.product_id for x in dom["bom"].filter("component_id = 'c2'").collect()}
    assert {x.product_id for x in only["forecasts"].collect()} <= used
    assert isinstance(only, Domain)
