"""CSV source, sinks with comments, presence check, static semantic tables
and the streaming ingest (stream result == batch result)."""

import os
import tempfile

from pyspark.sql import functions as F

from stockpilot.operators import semantic
from stockpilot.operators.quality import keep, rules_for, typed
from stockpilot.plans.registry import domain_for, load_all
from stockpilot.sources.files import (
    column_comments,
    csv_rejects,
    missing_tables,
    read_csv,
    read_csv_checked,
    write_table,
)
from stockpilot.sources.schemas import SCHEMAS
from stockpilot.streaming.ingest import stream_ingest


def _write(path, text):
    with open(path, "w", encoding="utf-8-sig") as f:  # with byte-order mark
        f.write(text)


def test_csv_reader_typed_with_bom(spark):
    d = tempfile.mkdtemp(prefix="sp-csv-")
    p = os.path.join(d, "bom.csv")
    _write(p, "product_id,component_id,quantity_per_unit\nP1,C1,2\nP1,C2,x\n,C3,1\n")
    df = read_csv(spark, p, "bom")
    assert df.columns[:3] == ["product_id", "component_id", "quantity_per_unit"]
    got = sorted(((r.product_id, r.component_id, r.quantity_per_unit) for r in df.collect()), key=repr)
    assert got == sorted([("P1", "C1", 2), ("P1", "C2", None), (None, "C3", 1)], key=repr)
    assert "_ingested_at" in df.columns
    kept = keep(typed(df, SCHEMAS["bom"]), rules_for("bom"))
    assert [(r.component_id) for r in kept.collect()] == ["C1"]


def test_bad_csv_rows_land_in_the_rejects(spark):
    d = tempfile.mkdtemp(prefix="sp-csv-")
    good = ["P1,C1,2", "P2,C1,", ',C3,1', '"a, ""b""",C4,7']
    bad = {"P1,C2": "SHORT", "P1,C2,x": "MISTYPED", "P1,C2,3,4": "LONG", '"q,r",C9': "SHORT", '"q,r",C9,1.5': "MISTYPED", "P9,C9,99999999999": "MISTYPED"}
    os.makedirs(os.path.join(d, "bom.csv"))
    for i, some in enumerate((good[:2] + list(bad)[:3], good[2:] + list(bad)[3:])):
        _write(os.path.join(d, "bom.csv", f"part{i}.csv"), "product_id,component_id,quantity_per_unit\n" + "\n".join(some) + "\n")
    rows, rejects = read_csv_checked(spark, os.path.join(d, "bom.csv"), "bom")
    assert rows.columns[-1] == "_ingested_at"
    got = {tuple(r)[:3] for r in rows.collect()}
    assert got == {("P1", "C1", 2), ("P2", "C1", None), (None, "C3", 1), ('a, "b"', "C4", 7)}
    found = rejects.collect()
    assert {r.record: r.reason for r in found} == bad and len(found) == len(bad)
    assert {r.source_file.rsplit("/", 1)[1] for r in found} == {"part0.csv", "part1.csv"} and all(r.block_start == 0 for r in found)
    assert rows.count() == 4 and rejects.count() == len(bad)  # whatever columns a query reads
    every = csv_rejects(spark, d, ["bom"])
    assert sorted(map(tuple, every.collect())) == sorted(map(tuple, found))


def test_write_table_keeps_comments(spark):
    d = tempfile.mkdtemp(prefix="sp-sink-")
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    target = os.path.join(d, "t")
    write_table(df, target, comment="demo", column_comments={"v": "a value"})
    back = spark.read.parquet(target)
    assert column_comments(back) == {"v": "a value"}
    assert back.count() == 1


def test_presence_check(spark):
    assert missing_tables(spark, ["surely_not_a_table_xyz"]) == ["surely_not_a_table_xyz"]


def test_static_semantic_tables(spark):
    assert semantic.glossary(spark).count() == 19
    assert semantic.metric_definitions(spark).count() == 10
    assert semantic.example_questions(spark).count() == 8
    assert all(semantic.marts_used(q) for q in semantic.QLIB.values())


def test_stream_ingest_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="sp-src-")
    schema = SCHEMAS["demand_plan_components"]
    rows = [("d1", "c", None, 5, "FCST_AUTO", None, None, None, None),
            ("d2", "c", None, 0, "FCST_AUTO", None, None, None, None),
            (None, "c", None, 3, "FCST_AUTO", None, None, None, None)]
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(src, "part1"))
    spark.createDataFrame([("d3", "c", None, 7, "EMERGENCY_MANUAL", None, None, None, None)], schema) \
        .write.mode("overwrite").parquet(os.path.join(src, "part2"))
    sink = stream_ingest(spark, os.path.join(src, "*"), schema, rules_for("demand_plan_components"))
    streamed = sorted(r.demand_id for r in spark.read.parquet(sink).collect())
    batch = keep(spark.read.schema(schema).parquet(os.path.join(src, "*")), rules_for("demand_plan_components"))
    assert streamed == sorted(r.demand_id for r in batch.collect()) == ["d1", "d3"]
    assert spark.read.parquet(sink).filter(F.col("requested_qty") <= 0).count() == 0


def test_layers_give_the_same_marts(spark):
    from conftest import SF001
    from stockpilot.plans.context import Domain
    from stockpilot.plans.layers import from_layers, layer_root, materialize
    from stockpilot.plans.registry import load_all

    direct = Domain.from_driver(spark, SF001)
    root = layer_root(spark)
    materialize(direct, root)
    layered = from_layers(spark, root)
    q = load_all()
    for name in ("mart_options", "mart_breach", "mart_lt_snapshot", "mart_source_health", "dq_report"):
        a = sorted(map(tuple, q[name](direct).collect()), key=repr)
        b = sorted(map(tuple, q[name](layered).collect()), key=repr)
        assert a == b, name


def test_refresh_writes_tables_with_comments(spark):
    from conftest import SF001
    from stockpilot.plans.refresh import refresh_all
    from stockpilot.sources.files import column_comments

    paths = refresh_all(spark, SF001, names=["mart_options", "mart_breach"])
    opts = spark.read.parquet(paths["mart_options"])
    assert opts.count() == load_all()["mart_options"](domain_for(spark, SF001)).count()
    assert column_comments(opts)["action_level"] == "NONE, LIGHT, MEDIUM or HEAVY"
    assert spark.read.parquet(paths["mart_breach"]).count() > 0


def test_catalog_table_with_comments(spark):
    name = "sp_comment_demo"
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    write_table(df, name, comment="demo table", column_comments={"v": "a value"})
    try:
        assert missing_tables(spark, [name]) == []
        desc = {r[0]: (r[1], r[2]) for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        assert desc["v"][1] == "a value"
        assert desc["Comment"][0] == "demo table"
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
