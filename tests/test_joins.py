import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textquarry.plans.joins import fits_broadcast, lookup_join, running, spread


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    # a third of the rows share one key
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k")
    )
    lookup = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted(map(tuple, rows.join(lookup, ["k"], how).collect()))
    plain = lookup_join(rows, lookup, ["k"], how, measure=False)
    salted = lookup_join(rows, lookup, ["k"], how, measure=False, salts=8)
    measured = lookup_join(rows, lookup, ["k"], how)
    too_big = lookup_join(rows, lookup, ["k"], how, max_rows=5)
    for got in (plain, salted, measured, too_big):
        assert got.columns == rows.join(lookup, ["k"], how).columns
        assert sorted(map(tuple, got.collect())) == want


def test_broadcast_needs_both_bounds(spark):
    small = spark.range(10)
    assert fits_broadcast(small)
    assert not fits_broadcast(small, max_rows=9)
    assert not fits_broadcast(small, max_bytes=20)
    assert fits_broadcast(spark.range(0))


@pytest.mark.parametrize("largest", [False, True])
def test_running_equals_one_window(spark, largest):
    df = spark.range(2000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"),
        F.col("id"),
        ((F.col("id") * 7919) % 101).alias("v"),
    )
    plain = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("r", (F.max if largest else F.sum)("v").over(plain))
    got = running(df, ["k"], ["id"], F.floor(F.col("id") / 97), F.col("v"), "r", largest=largest)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_spread_only_widens(spark):
    assert spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == 8
    assert spread(spark.range(0, 100, 1, 20)).rdd.getNumPartitions() == 20
