"""The as-of join against looking through all right rows."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import T, days
from stockpilot.operators.asof import asof_join


def brute(left, right, forward, exact, most):
    low = lambda x: (x is not None, x if x is not None else 0)
    out = []
    for n, k, t in left:
        near = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None
                and (x[1] == t and exact or (x[1] > t if forward else x[1] < t))]
        best = max(near, key=lambda x: ((t - x[1]).days * (1 if forward else -1), low(x[2]), low(x[3])), default=None)
        if best and most is not None and abs((t - best[1]).days) > most:
            best = None
        out.append((n, k, t, *(best[1:] if best else (None,) * 3)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("direction,exact,most,slices", [("backward", True, None, 8), ("backward", False, None, 3), ("forward", True, None, 8), ("forward", False, 6, 1), ("backward", True, 4, 40)])
def test_against_all_rows(spark, direction, exact, most, slices):
    r = random.Random(slices)
    key = lambda: r.choice(["hot", "hot", "hot", "hot", "a", "b", "z", None])
    day = lambda: r.choice([None, *[days(i) for i in range(0, 60, 3)], days(r.randrange(60))])
    right = [(key(), day(), r.choice([None, 1, 2, 3]), r.choice([None, 0.5, 1.5])) for _ in range(150)]
    right += right[:10]
    left = [(r.randrange(200), key(), day()) for _ in range(300)]
    left += left[:10] + [(7, "none", T), (8, "hot", days(-400)), (9, "hot", days(400))]
    a = spark.createDataFrame(left, "n int, key string, `when` date")
    b = spark.createDataFrame(right, "key string, since date, v int, w double").repartition(5)
    within = (lambda x, y: F.abs(F.datediff(x, y)) <= most) if most is not None else None
    got = asof_join(a, b, ["key"], "when", "since", ["v", "w"], direction, exact, within, slices)
    assert got.columns == ["n", "key", "when", "since", "v", "w"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, direction == "forward", exact, most)


def test_a_hot_key_is_dealt_over_tasks(spark):
    n = 4000
    right = spark.range(n).selectExpr("1 as k", "cast(id * 10 as long) as since", "id as v")
    left = spark.range(n).selectExpr("1 as k", "cast(id * 10 + 5 as long) as t")
    out = asof_join(left, right, ["k"], "t", "since", ["v"], slices=16)
    assert out.filter("v * 10 + 5 = t").count() == n
    # the rows of the only key, as the windows see them, by slice
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(slice#" in plan
    sizes = out.select("k", F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in sizes) < n


def test_empty_sides_and_arguments(spark):
    a = spark.createDataFrame([(1, "x", T)], "n int, key string, `when` date")
    b = spark.createDataFrame([], "key string, since date, v int")
    assert asof_join(a, b, ["key"], "when", "since", ["v"]).collect() == [(1, "x", T, None, None)]
    assert asof_join(a.limit(0), b, ["key"], "when", "since", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(a, b.withColumnRenamed("v", "n"), ["key"], "when", "since", ["n"])
    with pytest.raises(ValueError):
        asof_join(a, b, ["key"], "when", "since", ["v"], "sideways")
