"""Refined histograms against Spark's own percentile, which holds every distinct value."""

import pytest
from pyspark.sql import functions as F

from doorstep.operators.percentiles import exact_percentiles

POINTS = {"low": 0.0, "half": 0.5, "most": 0.95, "top": 1.0}


def test_equals_plain_percentile(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 20 < 18, "hot").when(F.col("id") % 20 == 18, None).otherwise("g").alias("g"),
        F.when(F.col("id") % 9 > 0, F.xxhash64("id")).alias("v"), F.lit(1).alias("n"),
    )
    edge = spark.createDataFrame(
        [("one", 7), ("none", None), ("ties", 3), ("ties", 3), ("ties", -3), ("ends", -(2**63)), ("ends", 2**63 - 1)], "g string, v long"
    ).withColumn("n", F.lit(1))
    both = rows.unionByName(edge)
    plain = both.groupBy("g").agg(F.count("v").alias("n"), *[F.percentile("v", F.lit(p)).alias(c) for c, p in POINTS.items()])
    want = {r.g: r for r in plain.collect()}
    got = {r.g: r for r in exact_percentiles(both, ["g"], "v", POINTS).collect()}
    assert set(got) == set(want) and None in got
    for g, r in got.items():
        assert r.n == want[g].n
        for c in POINTS:
            assert (r[c] is None and want[g][c] is None) or r[c] == pytest.approx(want[g][c], rel=1e-9, abs=1e4 if g == "ends" else 0)


def test_empty_and_whole_table(spark):
    empty = spark.createDataFrame([], "g string, v long")
    assert exact_percentiles(empty, ["g"], "v", POINTS).collect() == []
    whole = exact_percentiles(spark.range(101).withColumnRenamed("id", "v"), [], "v", POINTS).collect()
    assert [(r.n, r.low, r.half, r.most, r.top) for r in whole] == [(101, 0, 50, 95, 100)]
