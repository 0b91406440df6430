"""Library operators not covered by a registered query, and boundary rows
for the analytics views."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from conftest import T, days, rows
from stockpilot.functions.topk import topk_per_group
from stockpilot.operators import analytics, leadtime, ledger
from stockpilot.operators.orders import stock_by_component
from stockpilot.params import DEFAULT
from stockpilot.sources.files import read_raw_csv


def test_trend_selection_filters(spark):
    snap = spark.createDataFrame(
        [("a", "UP", "FLAT", "b1"), ("b", "DOWN", "UP", "b1"), ("c", "FLAT", "FLAT", "b2"), ("d", "", "DOWN", "b2")],
        "item_id string, trend_arrow_n3 string, trend_arrow_n6 string, lt_band string",
    )
    pick = lambda df: sorted(r[0] for r in df.select("item_id").collect())
    assert pick(leadtime.filter_band_trend(snap, trend_sel="UP")) == ["a", "b"]
    assert pick(leadtime.filter_band_trend(snap, trend_sel="DOWN")) == ["b", "d"]
    assert pick(leadtime.filter_band_trend(snap, trend_sel="FLAT")) == ["c"]
    assert pick(leadtime.filter_band_trend(snap, lt_band="b2", trend_sel="DOWN")) == ["d"]
    got = dict(rows(snap.select("item_id", leadtime.trend_class())))
    assert got == {"a": "UP", "b": "UP", "c": "FLAT", "d": "DOWN"}


def test_item_ledger_and_split(spark):
    tl = spark.createDataFrame(
        [("x", days(-1), "CONSUMPTION", "o1"), ("x", T, "ON_HAND", ""), ("x", days(3), "RECEIPT", "p"),
         ("y", days(1), "CONSUMPTION", "o2"), ("x", None, "CONSUMPTION", "o0")],
        "item_id string, event_date date, event_type string, order_no string",
    )
    assert [r.order_no for r in ledger.item_ledger(tl, "x").collect()] == ["o0", "o1", "", "p"]
    actual, forecast = analytics.split_actual_forecast(tl, "event_date", DEFAULT)
    assert actual.count() == 2 and forecast.count() == 3  # T in both, NULL in neither
    flags = dict(rows(analytics.actual_forecast_flag(tl, "event_date", DEFAULT), "order_no", "phase"))
    assert flags == {"o1": "ACTUAL", "": "ACTUAL", "p": "FORECAST", "o2": "FORECAST", "o0": "FORECAST"}


def test_read_raw_csv_tables(spark):
    d = tempfile.mkdtemp(prefix="sp-raw-")
    with open(os.path.join(d, "suppliers.csv"), "w", encoding="utf-8-sig") as f:
        f.write("supplier_id,supplier_name,country,region\nS1,one,C,R\n")
    raw = read_raw_csv(spark, d, tables=("suppliers",))
    assert rows(raw["suppliers"], "supplier_id", "supplier_name") == [("S1", "one")]


def test_forecast_status_thresholds(spark):
    df = spark.createDataFrame([(x,) for x in (None, -3, 3, 4, 7, 8, 14, 15)], "d int")
    got = [r[0] for r in df.select(analytics.forecast_status(F.col("d"))).collect()]
    assert got == ["Normal", "Critical", "Critical", "High", "High", "Medium", "Medium", "Normal"]


def test_available_stock_status(make_domain):
    comps = [{"component_id": c, "min_stock": m} for c, m in (("neg", 10), ("low", 10), ("ok", 10), ("dflt", None))]
    inv = [{"component_id": c, "warehouse_id": "w", "stock_qty": q} for c, q in (("neg", 5), ("low", 9), ("ok", 10),
                                                                                  ("dflt", 99))]
    so = [{"sales_order_id": "s", "component_id": "neg", "component_required_qty": 6, "status": "confirmed"},
          {"sales_order_id": "t", "component_id": "low", "component_required_qty": 50, "status": "picking"}]
    dom = make_domain(components=comps, inventory_current=inv, sales_orders=so,
                      suppliers=[{"supplier_id": "S"}])
    dom.raw["components"] = dom.raw["components"].withColumn("supplier_id", F.lit("S"))
    out = analytics.available_stock(dom["components"], stock_by_component(dom["inventory_current"]),
                                    dom["sales_orders"], DEFAULT)
    got = {r[0]: r[1:] for r in rows(out, "component_id", "available_inventory", "spot_order_capacity",
                                      "inventory_status")}
    assert got == {"neg": (-1, 0, "Shortage"), "low": (9, 9, "Low"), "ok": (10, 10, "Available"),
                   "dflt": (99, 99, "Low")}


def test_round_ratio_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (1, 3), (13650, 1000), (-13650, 1000)], "n long, d long")
    got = [r[0] for r in df.select(analytics.round_ratio(F.col("n"), F.col("d"), 1)).collect()]
    assert got == [0.1, -0.1, 0.3, 13.7, -13.7]


def test_salted_topk_matches_plain_ranking(spark):
    data = [("hot" if i % 3 else f"g{i % 7}", f"n{(i * 37) % 101:03d}", f"id{i:04d}") for i in range(900)]
    df = spark.createDataFrame(data, "g string, name string, id string")
    top = topk_per_group(df, ["g"], [F.col("name"), F.col("id")], 5, ["id"], salts=16)
    got = sorted(rows(top, "g", "rank", "name", "id"))
    exp = []
    for g in sorted({r[0] for r in data}):
        members = sorted((r[1], r[2]) for r in data if r[0] == g)[:5]
        exp += [(g, i + 1, n, x) for i, (n, x) in enumerate(members)]
    assert got == sorted(exp)


def test_coverage_weeks_negative_stock(spark):
    cur = T.strftime("%Y-%m")
    nxt = (T.replace(day=1) + dt.timedelta(days=32)).strftime("%Y-%m")
    proj = spark.createDataFrame(
        [("a", cur, -26, 13), ("a", nxt, -40, 13), ("b", cur, 5, 0), ("b", nxt, 5, 0)],
        "item_id string, month_end_date string, customer_stock_proj long, production_use_qty long",
    )
    got = {r[0]: r[1:] for r in rows(analytics.coverage_weeks(proj, DEFAULT), "item_id", "weekly_use",
                                      "coverage_weeks")}
    # weekly use = 13 * 12 / 52 = 3.0; coverage = -26 / 3 = -8.67 -> -8.7
    assert got == {"a": (3.0, -8.7), "b": (0.0, None)}


def test_warn_rules_observed_without_extra_scan(spark):
    from stockpilot.operators.quality import keep, observe_rules, rules_for
    from stockpilot.sources.schemas import SCHEMAS

    fc = spark.createDataFrame(
        [("f1", "p", None, T, 1, 0.5, None), ("f2", "p", None, T, -1, 1.5, None), ("f3", "p", None, T, 2, None, None)],
        SCHEMAS["forecasts"],
    )
    rules = rules_for("forecasts")
    observed, obs = observe_rules(fc, "forecasts", rules)
    kept = keep(observed, rules)
    assert kept.count() == 2
    assert obs.get == {"rows_checked": 3, "forecast_qty_non_negative": 1, "accuracy_in_range": 1}


def test_cluster_conf_sizing_and_respect_for_explicit_settings(spark):
    from stockpilot.session import apply_cluster_conf, cluster_conf

    big = cluster_conf(input_tb=100, executors=1000, cores_per_executor=8)
    assert int(big["spark.sql.shuffle.partitions"]) > 100_000  # no cap
    assert big["spark.sql.autoBroadcastJoinThreshold"] == "-1"  # only measured (AQE) broadcasts
    assert cluster_conf(input_tb=1, executors=10, cores_per_executor=8)["spark.sql.shuffle.partitions"] == "1024"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    applied = apply_cluster_conf(spark, input_tb=1, executors=10)
    # the session's explicit shuffle setting wins
    assert "spark.sql.shuffle.partitions" not in applied
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    for k in applied:
        spark.conf.unset(k)


def test_warn_counts_ride_along_with_checkpoints(spark, duck001):
    """In a checkpointing domain the rule counters of each cleansed table
    are filled by its checkpoint job and equal the quality report."""
    from conftest import SF001
    from stockpilot.plans.context import Domain

    dom = Domain.from_driver(spark, SF001, checkpoint_clean=True)
    dom["demand_plan_components"], dom["bom"], dom["components"]
    counts = dom.warn_counts()
    dq = {(r[0], r[1]): (r[2], r[3]) for r in duck001.execute(
        "SELECT table_name, rule_name, rows_checked, rows_failed FROM (" + __import__("__spark_entry__").oracle_sql()
        ["dq_report"] + ") x").fetchall()}
    for table in ("demand_plan_components", "bom", "components"):
        c = counts[table]
        for (t, rule), (checked, failed) in dq.items():
            if t == table:
                assert c["rows_checked"] == checked and c[rule] == failed, (table, rule)
