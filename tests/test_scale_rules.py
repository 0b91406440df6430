"""Rules of the source adapter, folders and caches at scale."""

import datetime as dt
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from conftest import SF001, T, days
from stockpilot.plans.context import Domain
from stockpilot.plans.registry import domain_for, invalidate, load_all
from stockpilot.session import ensure_checkpoint_dir, shared_folder
from stockpilot.sources.files import column_comments, table_comment, write_table


def test_every_line_is_mapped(spark):
    raw = Domain.from_driver(spark, SF001).raw
    t = {n: spark.read.parquet(f"{SF001}/{n}.parquet") for n in ("lineitem", "customer", "supplier", "part")}
    line = t["lineitem"]
    counts = {
        "sales_orders": line.filter("l_linestatus = 'O' and l_returnflag = 'N'").count(),
        "purchase_orders": line.filter("l_linestatus = 'F' and l_returnflag = 'R'").count(),
        "demand_plan_components": line.filter("l_linestatus = 'O' and l_returnflag <> 'N'").count(),
        "logistics": line.count(),
        "shipment_routes": t["customer"].count() + t["supplier"].count(),
        "free_inventory": t["part"].count(),
    }
    assert {n: raw[n].count() for n in counts} == counts
    assert raw["forecasts"].agg(F.sum("forecast_qty")).first()[0] == line.agg(F.sum("l_quantity").cast("long")).first()[0]
    assert raw["sales_orders"].filter("requested_delivery_date is null").count() == 0


@pytest.mark.parametrize("table", ["lead_times", "inventory", "forecasts", "actuals"])
def test_orders_are_not_read_where_no_column_needs_them(spark, table):
    raw = Domain.from_driver(spark, SF001).raw
    plan = raw[table]._jdf.queryExecution().optimizedPlan().toString()
    assert "o_orderkey" not in plan


def test_non_local_master_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda k, d=None: d)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    for f in (shared_folder, ensure_checkpoint_dir):
        with pytest.raises(RuntimeError):
            f(SimpleNamespace(sparkContext=sc))


def test_refresh_uses_the_submitted_session(spark, monkeypatch, tmp_path):
    from stockpilot.plans import refresh

    seen = []
    monkeypatch.setattr(refresh, "refresh_all", lambda s, *a: seen.append(s) or {})
    monkeypatch.setattr("sys.argv", ["refresh", "--sf", SF001])
    refresh.main()
    assert seen[0].sparkContext is spark.sparkContext


def test_changed_files_are_read_after_invalidate(spark, tmp_path):
    for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        spark.read.parquet(f"{SF001}/{n}.parquet").write.parquet(str(tmp_path / f"{n}.parquet"))
    d = str(tmp_path)
    before = load_all()["ship_routes"](domain_for(spark, d)).count()
    spark.read.parquet(f"{SF001}/supplier.parquet").limit(3).write.mode("overwrite").parquet(f"{d}/supplier.parquet")
    invalidate(spark, d)
    after = load_all()["ship_routes"](domain_for(spark, d)).count()
    customers = spark.read.parquet(f"{d}/customer.parquet").count()
    assert before > 3 + customers and after == 3 + customers  # inbound routes of the suppliers, outbound ones of the customers


def test_projection_reads_the_months_of_its_grid_only(spark):
    from stockpilot.plans.layers import from_layers, materialize
    from stockpilot.session import scratch_path

    root = scratch_path(spark, "months-test")
    materialize(Domain.from_driver(spark, SF001), root)
    plan = load_all()["mart_projection"](from_layers(spark, root))._jdf.queryExecution().optimizedPlan().toString()
    for column in ("forecast_month", "requested_delivery_date", "expected_delivery_date"):
        # literal bounds directly above the stored table
        assert re.search(rf"Filter .*\({column}#\d+ >= 1998-03-01\).*\({column}#\d+ < 1999-03-01\).*\n[^\n]*Relation \[", plan), column


def test_cleansed_tables_are_pruned_scans(spark):
    dom = Domain.from_driver(spark, SF001, checkpoint_clean=True)
    plan = dom["lead_times_base"].select("component_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<component_id:string>" in plan


def test_parquet_path_keeps_table_and_column_comments(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(3), path, comment="three rows", column_comments={"id": "a number"})
    back = spark.read.parquet(path)
    assert back.count() == 3 and column_comments(back) == {"id": "a number"} and table_comment(spark, path) == "three rows"


def test_scenario_does_not_consume_itself(make_domain):
    row = {"component_id": "C", "requested_qty": 7, "source_type": "EMERGENCY_MANUAL"}
    dom = make_domain(
        demand_plan_components=[
            {**row, "demand_id": "late", "requested_date": days(20)},
            {**row, "demand_id": "soon", "requested_date": days(5), "requested_qty": 4},
            {**row, "demand_id": "past", "requested_date": T - dt.timedelta(days=3)},
        ]
    )
    got = {r.scenario_id: r.consumption for r in load_all()["whatif"](dom).select("scenario_id", "consumption").distinct().collect()}
    assert got == {"late": 4, "soon": 0, "past": 0}
