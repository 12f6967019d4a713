from itertools import combinations
from pathlib import Path
from statistics import median

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.text import longer_than
from lodeworks.operators import skew
from lodeworks.operators.pairs import blocks_of_pairs, meet, pairs_within
from lodeworks.operators.skew import with_sizes
from lodeworks.session import materialize, scope


@pytest.mark.parametrize("block", [2, 7, 1000])
def test_every_pair_once(spark, block):
    rows = [("hot", i, str(i)) for i in range(40)] + [("warm", i, str(i)) for i in range(5)] + [("one", 1, "x"), (None, 1, "x"), (None, 2, "x"), ("hot", None, "x")]
    got = [(min(r["x"], r["y"]), max(r["x"], r["y"]), r["v_x"] == str(r["x"]) and r["v_y"] == str(r["y"])) for r in pairs_within(spark.createDataFrame(rows, "k string, id int, v string"), "k", "id", ["v"], block).collect()]
    assert sorted(got) == sorted([(*p, True) for n in (40, 5) for p in combinations(range(n), 2)])


def test_empty(spark):
    assert pairs_within(spark.createDataFrame([], "k string, id int"), "k", "id").collect() == []


def loads(df):
    """Rows a task."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("small", [0, 4_000_000])
def test_with_sizes_equals_a_join(spark, monkeypatch, how, small):
    monkeypatch.setattr(skew, "SMALL_TABLE", small)
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("b", 2), ("c", 3), ("gone", 4), (None, 5)], "k string, id int")
    sizes = materialize(spark.createDataFrame([("hot", 50), ("b", 2), ("c", 1), ("unused", 9)], "k string, n int"), "sizes")
    for hot_keys in (1, 4, 1000):
        got = with_sizes(rows, sizes, ["k"], "n", 62, how, hot_keys)
        assert sorted(map(str, got.select("k", "id", "n").collect())) == sorted(map(str, rows.join(sizes, "k", how).select("k", "id", "n").collect()))


def test_half_of_all_rows_in_one_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "SMALL_TABLE", 0)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 19_999).cast("string"))).alias("k"), "id")
        sizes = materialize(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "sizes")
        joined = with_sizes(rows, sizes, ["k"], "n", 200_000)
        assert joined.count() == 200_000 and joined.filter("k = 'hot'").select("n").distinct().collect() == [(100_000,)]
        assert max(loads(joined)) <= 2 * median(loads(joined))
        left, right = blocks_of_pairs(rows, [], 2000)
        for side in (left, right):
            tasks = loads(side.repartition(32, "k", "i", "j"))
            assert max(tasks) <= 2 * median(tasks)
            assert side.filter("k = 'hot'").groupBy("i", "j").count().agg({"count": "max"}).first()[0] < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("block", [3, 10_000])
def test_meet_equals_a_join(spark, block):
    left = spark.createDataFrame([("a", i) for i in range(30)] + [("b", i) for i in range(2)] + [("c", 1), (None, 5)], "k string, l int")
    right = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(20)] + [("d", 1), (None, 5), ("a", 0)], "k string, r int")
    rows = lambda df: sorted(tuple(x) for x in df.select("k", "l", "r").collect())
    assert rows(meet(left, right, "k", block)) == rows(left.join(right, "k"))
    assert rows(meet(left, right.limit(0), "k", block)) == []


def test_longer_than(spark):
    texts = ["", None, "a" * 10, "a" * 11, "  " + "a" * 10 + "\n", "\t a" + " " * 9 + "b ", "a" + "\n" * 9 + "b", "a" + "\n" * 8 + "b", " " * 500, "é" * 11]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(longer_than(F.col("t"), 10).alias("x")).collect()
    assert [r["x"] for r in got] == [len((t or "").strip(" \t\n\r\f\v")) > 10 for t in texts]


def test_scope_removes_its_tables(spark):
    with scope():
        held = materialize(spark.range(3), "scoped")
        path = Path(held._shared_path.removeprefix("file://"))
        assert held.count() == 3 and path.exists()
    assert not path.exists()
