from collections import Counter

from pyspark.sql import functions as F

from lodeworks.operators.skew import Partial, heavy_keys, key_counts, plays_by_key, salted_aggregate

SCHEMA = "userid string, artid string, ts string, field_name string"


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_counts_distinct_rows_by_clean_key(spark):
    rows = [("U1 ", "a", "1", None), ("u1", "a", "2", "x"), ("u1", "a", "2", "x"), (None, "a", "3", None), (" ", "", None, None), ("u2", "B", None, None), ("u2", "b", None, "")]
    got = {(r[0], r[1]): r[2] for r in key_counts(log(spark, rows), ["userid", "artid"]).collect()}
    assert got == {("*", ""): 6, ("userid", "u1"): 2, ("userid", "u2"): 2, ("artid", "a"): 3, ("artid", "b"): 2}


def test_nulls_are_values_of_their_own(spark):
    rows = [(None, "a", None, None), ("a", None, None, None), (None, None, "a", None)]
    got = {(r[0], r[1]): r[2] for r in key_counts(log(spark, rows), ["userid"]).collect()}
    assert got == {("*", ""): 3, ("userid", "a"): 1}


def test_empty_log(spark):
    assert plays_by_key(log(spark, []), ["userid", "artid"]).collect() == []


def test_heavy_share(spark):
    rows = [("big", "a", str(i), None) for i in range(300)] + [(f"u{i}", f"b{i}", "1", None) for i in range(700)]
    got = {(r["field_name"], r["key_value"]) for r in plays_by_key(log(spark, rows), ["userid", "artid"], 0.01).filter("heavy").collect()}
    assert got == {("userid", "big"), ("artid", "a")}
    assert ("userid", "big") in heavy_keys(log(spark, rows), ["userid"], 0.1)


def test_exactly_the_share_is_not_heavy(spark):
    rows = [("x", "a", str(i), None) for i in range(1)] + [(f"u{i}", None, "1", None) for i in range(99)]
    assert plays_by_key(log(spark, rows), ["userid"], 0.01).filter("heavy").count() == 0


def test_salted_aggregate_equals_plain(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), "id")
    aggs = [Partial("n", F.count(F.lit(1))), Partial("s", F.sum("id")), Partial("lo", F.min("id"), "min"), Partial("hi", F.max("id"), "max")]
    got = {tuple(r) for r in salted_aggregate(df, ["k"], aggs, F.col("k") == "hot", F.col("id"), 8).collect()}
    want = {tuple(r) for r in df.groupBy("k").agg(F.count("*"), F.sum("id"), F.min("id"), F.max("id")).collect()}
    assert got == want
    assert Counter(r[0] for r in got)["hot"] == 1
