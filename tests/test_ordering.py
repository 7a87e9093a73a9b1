"""Bucketed numbering, totals and look-ups against plain windows, with one key at a third."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.operators import ordering


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data, position = [], {}
    for i in range(6000):
        key = "hot" if rng.random() < 0.35 else f"k{rng.randint(0, 400)}"
        position[key] = position.get(key, 0) + rng.randint(1, 9)
        data.append((key, position[key], i, rng.randint(0, 50)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, pos int, id long, amount int").cache()


def plain():
    return Window.partitionBy("key").orderBy("pos")


def same(left, right):
    return sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))


def test_number_rows(rows):
    got = ordering.number_rows(rows, ["key"], [F.col("pos")], ordering.bucket_of("pos", 64), "n")
    want = rows.withColumn("n", F.row_number().over(plain()).cast("long"))
    assert same(got.select("id", "n"), want.select("id", "n"))


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_rows_without_a_key_are_kept(spark, rows, broadcast):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    some = rows.withColumn("key", F.when(F.col("id") % 4 != 0, F.col("key")))
    got = ordering.number_rows(some, ["key"], [F.col("pos"), F.col("id")], ordering.bucket_of("pos", 64), "n")
    order = Window.partitionBy("key").orderBy("pos", "id")
    want = some.withColumn("n", F.row_number().over(order).cast("long"))
    assert same(got.select("id", "n"), want.select("id", "n"))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_total_before(rows):
    got = ordering.total_before(
        rows, ["key"], [F.col("pos")], ordering.bucket_of("pos", 64), F.col("amount"), "before")
    earlier = plain().rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumn("before", F.coalesce(F.sum("amount").over(earlier), F.lit(0)))
    assert same(got.select("id", "before"), want.select("id", "before"))


def test_first_rows(rows):
    got = ordering.first_rows(rows, ["key"], [F.col("pos")], ordering.bucket_of("pos", 64), 7, "n")
    want = rows.withColumn("n", F.row_number().over(plain())).where("n <= 7")
    assert same(got.select("id", "n"), want.select("id", "n"))


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_spreads_hot_and_missing_keys(spark, rows, how):
    left = rows.withColumn("key", F.when(F.col("id") % 5 != 0, F.col("key")))
    right = rows.select("key").distinct().where("key <> 'k7'").withColumn("value", F.upper("key"))
    got = ordering.lookup(left, right, ["key"], how, ["id"], hot_rows=500, hot_keys=3)
    want = left.join(right, ["key"], how)
    assert same(got.select("id", "value").fillna(""), want.select("id", "value").fillna(""))


def test_hot_key_reaches_many_partitions(spark, rows):
    """The rows of the hot key must not end up in one task of the look-up join."""
    right = rows.select("key").distinct().withColumn("value", F.lit(1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = ordering.lookup(rows, right, ["key"], spread=["id"], hot_rows=500)
        parts = got.where("key = 'hot'").select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parts >= 4
