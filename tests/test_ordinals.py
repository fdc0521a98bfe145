"""Numbers within keys and newest rows against windows, with keys that span partitions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodeweave import shared
from lodeweave.operators import ordinals, resolve


def sample(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice(["hot"] * 6 + ["a", "b", None, "zz"]), rnd.choice([None, *range(40)]), i) for i in range(500)] + [("hot", 7, 1000 + i) for i in range(200)]
    return spark.createDataFrame(rows, "k string, t int, id long").repartition(5)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_numbers(spark, parts):
    df = sample(spark, parts)
    got = {r.id: r.n for r in ordinals.numbered(df, ["k"], ["t", "id"], "n", parts).collect()}
    want = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("t", "id"))).collect()}
    assert got == want
    # ties: any order, but each number once
    tied = ordinals.numbered(df, ["k"], ["t"], "n", parts).groupBy("k").agg(F.count_distinct("n").alias("d"), F.max("n").alias("m"), F.count(F.lit(1)).alias("c")).collect()
    assert all(r.d == r.m == r.c for r in tied)
    plan = ordinals.numbered(df, ["k"], ["t", "id"], "n", parts)._jdf.queryExecution().executedPlan().toString()
    assert "__part" in plan.split("Window [")[1]


def test_numbers_edges(spark):
    none = sample(spark, 1).limit(0)
    assert ordinals.numbered(none, ["k"], ["t"], "n").count() == 0
    one = ordinals.numbered(sample(spark, 2), [F.lit(1)], [F.col("id")], "n", 9)
    assert [r.n for r in one.orderBy("id").collect()] == list(range(1, 701))
    batches = resolve.session_batches(sample(spark, 3), "k", "id", 40)
    assert max(r["count"] for r in batches.groupBy("k", "session").count().collect()) == 40


@pytest.mark.parametrize("most", [0, 1, 5, 100, 10_000])
def test_newest(spark, most):
    df = sample(spark, most)
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc_nulls_last("t"), F.desc("id")))
    want = {r.id for r in df.withColumn("n", place).where(F.col("n") <= most).collect()}
    assert {r.id for r in ordinals.newest(df, ["k"], "t", most, ["id"]).collect()} == want
    at = df.withColumn("t", F.timestamp_seconds(F.col("t") * 1000 + 1_700_000_000))
    assert {r.id for r in ordinals.newest(at, ["k"], "t", most, ["id"]).collect()} == want


def test_newest_edges(spark):
    df = sample(spark, 1)
    assert ordinals.newest(df.limit(0), ["k"], "t", 3).count() == 0
    nulls = df.withColumn("t", F.lit(None).cast("int"))
    assert ordinals.newest(nulls, ["k"], "t", 3, ["id"]).groupBy("k").count().agg(F.max("count")).first()[0] == 3


def test_tables_are_released(spark):
    kept = shared.cut(spark.range(3).toDF("x"), "mine")
    assert kept.count() == 3 and shared.release(spark) >= 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|File"):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_first_of(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", None, "z"), (None, 1, "w")], "k string, o int, v string")
    assert {tuple(r) for r in resolve.first_of(df, "k", "o").collect()} == {("a", 1, "y"), ("b", None, "z"), (None, 1, "w")}
