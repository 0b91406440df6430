"""Keyed incremental ingest equals the batch result for any split, order and replay."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from stockpilot.operators.cleanse import _base
from stockpilot.operators.quality import keep, quarantine, rules_for
from stockpilot.plans.context import Domain
from stockpilot.plans.registry import load_all
from stockpilot.sources.schemas import MASTER_KEYS, SCHEMAS
from stockpilot.streaming.upsert import ALL, LATEST, SMALLEST, KeyedTable, domain_table, ingested_domain
from tools_oracle import same_rows


def split(df, n, seed, copies=True):
    """n batches; some rows come in two of them if copies may repeat."""
    parts = df.withColumn("_p", F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(n))).checkpoint()
    out = []
    for i in range(n):
        mine = F.col("_p") == i
        if copies:
            mine = mine | ((F.col("_p") == (i + 1) % n) & (F.pmod(F.xxhash64(*df.columns), F.lit(3)) == 0))
        out.append(parts.filter(mine).drop("_p"))
    random.Random(seed).shuffle(out)
    return out


@pytest.fixture(scope="module")
def raw(spark):
    return Domain.from_driver(spark, SF001).raw


def test_the_seventeen_tables_by_batches(spark, raw, tmp_path):
    for k, t in enumerate(SCHEMAS):
        table = domain_table(spark, str(tmp_path), t, buckets=2)
        source = raw[t].checkpoint()
        if t in MASTER_KEYS:  # rows of the same key that differ, in other batches
            name = next(c for c in source.columns if c.endswith("_name") or c == "part_number")
            source = source.unionByName(source.withColumn(name, F.lit("A earlier name"))).unionByName(source.limit(3).withColumn(MASTER_KEYS[t], F.lit(None).cast("string")))
        for epoch, batch in enumerate(split(source, 2, k, copies=t in MASTER_KEYS)):
            table.merge(batch, epoch)
        table.merge(batch, epoch)  # replayed after its publication
        want = _base(source, t)
        assert same_rows(table.clean(), keep(want, rules_for(t))), t
        assert table.quarantine().count() == quarantine(want, rules_for(t)).count(), t
    # marts over the ingested tables, against a domain that cleanses the same rows itself
    dom = ingested_domain(spark, str(tmp_path), buckets=2)
    plain = Domain({t: domain_table(spark, str(tmp_path), t, 2).rows() for t in SCHEMAS}, spark=spark)
    for name in ("mart_breach", "mart_lt_trend"):
        assert same_rows(load_all()[name](dom), load_all()[name](plain)), name


SCHEMA = "k string, t int, v string"


def brute(rows):
    best = {}
    low = lambda x: (x is not None, x if x is not None else 0)
    word = lambda x: (x is not None, x or "")
    for k, t, v in rows:
        if k not in best or (low(t), word(v)) > (low(best[k][0]), word(best[k][1])):
            best[k] = (t, v)
    return sorted(((k, *x) for k, x in best.items()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_by_event_time(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.choice(["a", "b", "c", None, "hot", "hot", "hot"]), r.choice([None, 1, 2, 3, 4]), r.choice([None, "x", "y", "z"])) for _ in range(120)]
    table = KeyedTable(spark, str(tmp_path), frame(spark, []).schema, ["k"], LATEST, "t", buckets=3)
    seen = []
    for epoch in range(3):
        batch = r.sample(rows, 40) if epoch != 1 else []
        seen += batch
        table.merge(frame(spark, batch), epoch)
        assert sorted(map(tuple, table.rows().collect()), key=repr) == brute(seen)


def test_a_lost_batch_is_computed_again(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), frame(spark, []).schema, ["k"], LATEST, "t", buckets=2)
    table.merge(frame(spark, [("a", 1, "x"), ("b", 1, "x")]), 0)
    publish = KeyedTable._publish
    monkeypatch.setattr(KeyedTable, "_publish", lambda self, rows: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        table.merge(frame(spark, [("a", 2, "y"), ("c", 1, "z")]), 1)
    assert sorted(map(tuple, table.rows().collect())) == [("a", 1, "x"), ("b", 1, "x")]  # not published, not seen
    monkeypatch.setattr(KeyedTable, "_publish", publish)
    table.merge(frame(spark, [("a", 2, "y"), ("c", 1, "z")]), 1)
    assert sorted(map(tuple, table.rows().collect())) == [("a", 2, "y"), ("b", 1, "x"), ("c", 1, "z")]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), frame(spark, []).schema, ["k"], SMALLEST, buckets=8)
    table.merge(frame(spark, [(str(i), i, "x") for i in range(100)]), 0)
    before = table._paths()
    table.merge(frame(spark, [("7", 0, "a")]), 1)
    after = table._paths()
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) == 1
    assert table.rows().count() == 100 and table.rows().filter("k = '7'").first().t == 0


def test_streams_of_files_go_on_where_they_ended(spark, raw, tmp_path):
    source = raw["suppliers"].checkpoint()
    batches = split(source.unionByName(source.withColumn("supplier_name", F.lit("A"))), 3, 5)
    table = domain_table(spark, f"{tmp_path}/t", "suppliers", buckets=4)
    for some in (batches[:2], batches[2:]):
        for b in some:
            b.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table.ingest(f"{tmp_path}/in", files_per_batch=1)
    assert table._published().select("epoch").distinct().count() == 3
    every = spark.read.parquet(f"{tmp_path}/in")
    assert same_rows(table.clean(), keep(_base(every, "suppliers"), rules_for("suppliers")))


def test_arguments(spark, tmp_path):
    for args in ({"keep": ALL, "key": ["k"]}, {"keep": LATEST, "key": ["k"]}, {"keep": SMALLEST}):
        with pytest.raises(ValueError):
            KeyedTable(spark, str(tmp_path), frame(spark, []).schema, **args)
