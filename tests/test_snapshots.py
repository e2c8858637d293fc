"""Bucketed snapshots: comparisons equal the plain one and read differing buckets only."""

import pytest
from pyspark.sql import functions as F

from doorstep.operators.trends import snapshot_diff
from doorstep.session import fresh_path
from doorstep.sources import snapshots

SCHEMA = "id string, band string, priority int"


def rows_of(df):
    return sorted(map(str, df.collect()))


def table(spark, change=lambda k: False, gone=lambda k: False, n=4000):
    rows = [(f"k{k}", None if k % 5 == 0 else ("y" if change(k) else "x"), k % 7 or None) for k in range(n) if not gone(k)]
    return spark.createDataFrame(rows, SCHEMA)


def test_equals_plain_diff_and_reads_little(spark):
    path = fresh_path(spark, "snapshots")
    old = table(spark)
    new = table(spark, change=lambda k: k in (1, 2), gone=lambda k: k == 3).union(
        spark.createDataFrame([("new", None, None)], SCHEMA)
    )
    for day, df in (("2024-05-01", old), ("2024-05-02", new)):
        snapshots.write_day(df, path, day, "id", 256)
    buckets = snapshots.differing_buckets(spark, path, "2024-05-01", "2024-05-02")
    assert 1 <= len(buckets) <= 4
    got = snapshots.changes(spark, path, "2024-05-01", "2024-05-02", SCHEMA, "id", ["band", "priority"])
    plain = snapshot_diff(old, new, "id", ["band", "priority"]).where(F.col("action") != "same")
    assert rows_of(got) == rows_of(plain) and got.count() == 4
    read = snapshots.read_day(spark, path, "2024-05-02", SCHEMA, buckets)
    assert len(read.inputFiles()) >= len(buckets)
    plan = read._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert read.count() < 4000 / 20


def test_equal_empty_and_rewritten_days(spark):
    path = fresh_path(spark, "snapshots")
    first = table(spark, n=50)
    for day, df in (("a", first), ("b", first.repartition(3)), ("c", first.limit(0)), ("d", first)):
        snapshots.write_day(df, path, day, "id", 16)
    compare = lambda x, y: snapshots.changes(spark, path, x, y, SCHEMA, "id", ["band", "priority"])
    assert snapshots.differing_buckets(spark, path, "a", "b") == [] and compare("a", "b").count() == 0
    assert {r.action for r in compare("a", "c").collect()} == {"gone"} and compare("c", "a").count() == 50
    snapshots.write_day(first.limit(1), path, "d", "id", 16)  # buckets without rows now lose their old ones
    assert snapshots.read_day(spark, path, "d", SCHEMA).count() == 1 and compare("a", "d").count() == 49


def test_nulls_count_by_place_and_cut_short_writes_are_read_whole(spark):
    path = fresh_path(spark, "snapshots")
    schema = "id string, a string, b string"
    for day, row in (("a", ("k", "x", None)), ("b", ("k", None, "x"))):
        snapshots.write_day(spark.createDataFrame([row], schema), path, day, "id", 4)
    assert len(snapshots.differing_buckets(spark, path, "a", "b")) == 1
    marks = spark.read.parquet(f"{path}/digests/snapshot_date=a").schema
    spark.createDataFrame([], marks).write.mode("overwrite").parquet(f"{path}/digests/snapshot_date=a")
    assert snapshots.differing_buckets(spark, path, "a", "b") is None
    assert [r.action for r in snapshots.changes(spark, path, "a", "b", schema, "id", ["a", "b"]).collect()] == ["changed"]
    snapshots.write_day(spark.createDataFrame([("k", "x", None)], schema), path, "e", "id", 8)
    with pytest.raises(ValueError):
        snapshots.differing_buckets(spark, path, "b", "e")
