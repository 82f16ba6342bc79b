"""Intermediate tables, and joins with counted tables."""

import os

from claimloom.sources import scratch


def test_cut_and_clear(spark):
    df = spark.range(5).withColumnRenamed("id", "a")
    before = spark.conf.get("spark.checkpoint.dir")
    own = spark.newSession()
    other = scratch.cut(own.createDataFrame(df.collect(), df.schema), "x")
    assert sorted(other.collect()) == sorted(df.collect()) and scratch.shared_dir(spark) == before
    folder = scratch._own_dir(spark).removeprefix("file://")
    assert any(name.startswith("x-") for name in os.listdir(folder))


def test_hinted(spark):
    few, many = spark.range(3), spark.range(50)
    for most, kind in ((10, "Broadcast"), (2, "SortMerge")):
        plan = many.join(scratch.hinted(few, most=most), "id")
        assert plan.count() == 3 and kind in plan._jdf.queryExecution().executedPlan().toString()
