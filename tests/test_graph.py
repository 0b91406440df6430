"""The stored table graph: each table once, published together, kept while its sources are unchanged."""

import pytest

from conftest import SF001
from stockpilot.params import DEFAULT
from stockpilot.plans import graph
from stockpilot.plans.context import Domain
from stockpilot.plans.graph import MartStore
from stockpilot.plans.marts import MART_BUILDERS
from stockpilot.plans.registry import domain_for, load_all
from tools_oracle import same_rows

NAMES = ["mart_breach", "mart_action_queue", "mart_exec_summary", "mart_options", "mart_fulfillment", "mart_projection",
         "mart_timeline", "inv_health", "kpi_overview", "qlib_g007", "bom_bottleneck", "dq_report", "inv_inout"]


def tables(spark, tmp, names=("region", "nation", "customer", "supplier", "part", "orders", "lineitem")):
    for n in names:
        spark.read.parquet(f"{SF001}/{n}.parquet").coalesce(1).write.mode("overwrite").parquet(f"{tmp}/in/{n}.parquet")
    return f"{tmp}/in"


@pytest.fixture(scope="module")
def refreshed(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("graph")
    folder = tables(spark, tmp)
    store = MartStore(spark, f"{tmp}/store")
    queries = {n: load_all()[n] for n in NAMES}
    run = graph.refresh(Domain.from_driver(spark, folder), store, queries)
    return folder, store, queries, run


def test_tables_equal_the_queries(spark, refreshed):
    folder, store, queries, _ = refreshed
    dom = domain_for(spark, folder)
    for name, node in store.published().items():
        if name in queries:
            assert same_rows(spark.read.parquet(node.path), queries[name](dom)), name


def test_each_table_is_computed_once_from_stored_reads(spark, refreshed):
    _, store, queries, run = refreshed
    nodes = store.published()
    assert len(run.computed) == len(set(run.computed)) and set(run.computed) == set(nodes)
    assert set(nodes["mart_breach"].reads) == {"mart_projection"}
    assert set(nodes["qlib_g007"].reads) == {"mart_exec_summary"}
    assert {"mart_order_risk", "mart_lt_escalation", "mart_breach"} == set(nodes["mart_action_queue"].reads)
    assert "raw/purchase_orders" in nodes["clean/purchase_orders"].reads
    # a table's plan scans the stored tables that it says it reads, nothing behind them
    dom = store.domain()
    for name in ("mart_breach", "mart_action_queue", "inv_health", "kpi_overview", "mart_projection"):
        frame = MART_BUILDERS[name](dom) if name in MART_BUILDERS else queries[name](dom)
        folders = {f.rsplit("/", 1)[0].split("/store/", 1)[1] for f in frame.inputFiles()}
        assert folders and folders <= {nodes[r].path.split("/store/", 1)[1] for r in nodes[name].reads}, name


def test_unchanged_sources_compute_nothing(spark, refreshed):
    folder, store, queries, _ = refreshed
    before = store.published()
    again = graph.refresh(Domain.from_driver(spark, folder), store, queries)
    assert again.computed == [] and store.published() == before


def test_failed_run_leaves_the_published_tables(spark, refreshed):
    folder, store, queries, _ = refreshed
    before = store.published()

    def broken(dom):
        dom.mart("mart_lt_trend")
        raise RuntimeError("broken")

    with pytest.raises(RuntimeError, match="broken"):
        graph.refresh(Domain.from_driver(spark, folder), store, {**queries, "broken": broken})
    assert store.published() == before
    assert store.domain().mart("mart_breach").count() == spark.read.parquet(before["mart_breach"].path).count()


def test_changed_source_computes_its_readers_only(spark, tmp_path):
    folder = tables(spark, tmp_path)
    store = MartStore(spark, f"{tmp_path}/store")
    queries = {n: load_all()[n] for n in ("ship_routes", "mart_lt_snapshot", "mart_lt_trend", "mart_warehouse")}
    first = graph.refresh(Domain.from_driver(spark, folder), store, queries)
    old = store.published()
    spark.read.parquet(f"{SF001}/customer.parquet").limit(40).coalesce(1).write.mode("overwrite").parquet(f"{folder}/customer.parquet")
    from stockpilot.plans.registry import invalidate

    invalidate(spark, folder)
    second = graph.refresh(Domain.from_driver(spark, folder), store, queries)
    new = store.published()
    assert "ship_routes" in second.computed and "raw/customers" in second.computed
    assert "mart_lt_snapshot" not in second.computed and new["mart_lt_snapshot"] == old["mart_lt_snapshot"]
    assert len(second.computed) < len(first.computed)
    assert same_rows(spark.read.parquet(new["ship_routes"].path), queries["ship_routes"](domain_for(spark, folder)))
    assert spark.read.parquet(old["ship_routes"].path).count() > spark.read.parquet(new["ship_routes"].path).count()


def test_a_query_that_reads_the_folder_itself_follows_its_files(spark, tmp_path):
    folder = tables(spark, tmp_path, ("events",))
    store = MartStore(spark, f"{tmp_path}/store")
    base = lambda: Domain({}, spark=spark)
    queries = {"stream_latest_events": load_all()["stream_latest_events"]}
    for n, computed in ((50, 1), (50, 0), (20, 1)):
        spark.read.parquet(f"{SF001}/events.parquet").filter(f"event_id < {n}").coalesce(1).write.mode("ignore" if not computed else "overwrite").parquet(f"{folder}/events.parquet")
        dom = base()
        dom.sf_dir = folder
        graph_run = graph.RunDomain(dom, store)
        graph_run.table("stream_latest_events", queries["stream_latest_events"])
        store.publish(graph_run.run, graph_run.nodes())
        assert len(graph_run.computed) == computed, n


def test_other_parameters_are_other_tables(spark, refreshed):
    import dataclasses

    _, store, _, _ = refreshed
    other = MartStore(spark, store.root, dataclasses.replace(DEFAULT, fx_rate=2))
    assert other.published() == {} and MartStore(spark, store.root + "-none").published() == {}
