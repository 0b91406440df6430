"""Clustered tables: the same rows, from a part of the files."""

import random

import pytest

from conftest import T, days
from stockpilot.sources.clustered import files_of, read_clustered, write_clustered
from tools_oracle import same_rows


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(r.choice([None, *range(1000)]), r.choice([None, *[days(i) for i in range(300)]]), r.choice(["", "a", "é", "part", "partner"]) + str(r.randrange(99)), r.random()) for _ in range(6000)]
    rows += rows[:50] + [(7, T, "hot", 1.0)] * 1500
    df = spark.createDataFrame(rows, "item int, day date, name string, `_z` double").repartition(4).checkpoint()
    path = str(tmp_path_factory.mktemp("clustered") / "t")
    write_clustered(df, path, ["item", "day"], 32)
    return df, path


def test_two_column_filters_read_a_part_of_the_files(spark, table):
    df, path = table
    files = spark.read.parquet(f"{path}/data").inputFiles()
    assert same_rows(read_clustered(spark, path), df)
    shares = []
    for lo, first in ((100, 20), (500, 150), (0, 0), (850, 270)):
        ranges = {"item": (lo, lo + 100), "day": (days(first), days(first + 30))}
        got = read_clustered(spark, path, ranges)
        assert same_rows(got, df.filter(f"item between {lo} and {lo + 100} and day between '{days(first)}' and '{days(first + 30)}'"))
        assert set(got.inputFiles()) <= set(files)
        shares.append(len(files_of(spark, path, ranges)) / len(files))
    assert sum(shares) / len(shares) < 0.35  # a hundredth of the rows; a plain layout reads every file
    for ranges in ({"item": (0, 99)}, {"day": (days(0), days(29))}):  # either column alone
        assert len(files_of(spark, path, ranges)) < 0.75 * len(files)


def test_strings_nulls_and_nothing(spark, table, tmp_path):
    df, _ = table
    path = str(tmp_path / "s")
    write_clustered(df, path, ["name"], 8)
    ranges = {"name": ("part", "partner5")}
    assert same_rows(read_clustered(spark, path, ranges), df.filter("name between 'part' and 'partner5'"))
    assert len(files_of(spark, path, ranges)) < 8
    assert read_clustered(spark, path, {"name": ("zz", "zzz")}).count() == 0
    with pytest.raises(ValueError):
        files_of(spark, path, {"item": (1, 2)})
    empty = str(tmp_path / "e")
    write_clustered(df.limit(0), empty, ["item", "day"], 4)
    assert read_clustered(spark, empty).count() == 0 and read_clustered(spark, empty, {"item": (1, 2)}).count() == 0
