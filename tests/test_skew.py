"""Joins with a hot key: same rows as a plain join, and no task with all of a key."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dieflow.functions import skew


@pytest.fixture(scope="module")
def rows(spark):
    # A third of the rows on one key, a tenth without a key.
    key = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 500)
    return spark.range(30_000).select(key.cast("long").alias("k"), F.col("id").alias("v"))


@pytest.fixture(scope="module")
def other(spark):
    return spark.range(0, 600, 7).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).unionAll(spark.sql("select cast(null as bigint), 5L"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(rows, other, how):
    got = skew.hot_join(rows, other, ["k"], how, slots=16, least=100)
    want = rows.join(other, ["k"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_heavy_hitters_are_exact(rows):
    hot = skew.heavy_hitters(skew.count_keys(rows, ["k"]), ["k"], slots=16, least=100)
    assert [k for k, _ in hot] == [(7,)] and 4 <= hot[0][1] <= 7
    assert skew.heavy_hitters(skew.count_keys(rows, ["k"]), ["k"]) == []


def test_hot_key_of_two_columns_and_taken_names(spark, rows, other):
    left = rows.withColumn("j", F.lit("x")).withColumn("__salt", F.lit(1))
    right = other.withColumn("j", F.lit("x"))
    got = skew.hot_join(left, right, ["k", "j"], "left", slots=16, least=100)
    assert got.columns == ["k", "j", "v", "__salt", "w"] and got.count() == 30_000


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_largest_task_holds_a_small_share(spark, rows, other):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "32")
        assert largest_share(rows.join(other, ["k"], "left")) > 0.33
        assert largest_share(skew.hot_join(rows, other, ["k"], "left", least=100)) < 0.12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
