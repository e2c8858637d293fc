"""Bucketed current tables: merges equal the plain operators and touch the buckets of their keys only."""

import pytest
from pyspark.sql import functions as F

from doorstep.operators import identity
from doorstep.session import fresh_path
from doorstep.sources import current

SCHEMA = "id string, name string, note string"


def rows_of(df):
    return sorted(map(str, df.collect()))


def upserted(held, new):
    return identity.upsert(held, new, "id", replace=["name"], keep_known=["note"])


def table(spark, n=3000):
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("id"), F.lit("old").alias("name"),
        F.when(F.col("id") % 3 == 0, "n").alias("note"),
    )


def bytes_of(spark, folders):
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folders[0]).getFileSystem(spark._jsc.hadoopConfiguration())
    return sum(files.getContentSummary(path(f)).getLength() for f in folders)


def test_a_merge_reads_and_writes_the_buckets_of_its_keys(spark):
    path = fresh_path(spark, "current")
    current.begin(table(spark), path, ["id"], 64)
    before = current._folders(spark, path, 0)
    delta = spark.createDataFrame([("k3", "new", None), ("k4", "new", "x"), ("fresh", "new", None)], SCHEMA)
    seen = []

    def how(held, new):
        seen.append(held)
        return upserted(held, new)

    touched = current.merge(spark, path, 1, delta, how)
    after = current._folders(spark, path, 1)
    assert 1 <= len(touched) <= 3 and {b for b in after if after[b] != before.get(b)} == set(touched)
    assert len(seen[0].inputFiles()) == len(touched) and seen[0].count() < 3000 / 8
    assert bytes_of(spark, [after[b] for b in touched]) < bytes_of(spark, list(before.values())) / 8
    assert rows_of(current.rows(spark, path)) == rows_of(upserted(table(spark), delta))
    assert rows_of(current.rows(spark, path, 0)) == rows_of(table(spark))


def test_a_finished_batch_changes_nothing_when_sent_again(spark):
    path = fresh_path(spark, "current")
    current.begin(table(spark, 20), path, ["id"], 8)
    one = spark.createDataFrame([("k1", "a", None), (None, "loose", None)], SCHEMA)
    two = spark.createDataFrame([("k1", "b", None)], SCHEMA)
    assert current.merge(spark, path, 1, one, upserted) and current.merge(spark, path, 2, two, upserted)
    want = rows_of(current.rows(spark, path))
    for batch, delta in ((1, one), (2, two), (2, one)):
        assert current.merge(spark, path, batch, delta, upserted) == []
    assert rows_of(current.rows(spark, path)) == want and "Row(id='k1', name='b', note=None)" in want
    with pytest.raises(ValueError):
        current.begin(table(spark, 1), path, ["id"], 8)


def test_a_batch_cut_short_is_not_seen_and_can_run_again(spark):
    path = fresh_path(spark, "current")
    current.begin(table(spark, 50), path, ["id"], 4)
    want = rows_of(current.rows(spark, path))
    delta = spark.createDataFrame([("k1", "a", None), (None, "loose", None)], SCHEMA)
    layout = current._layout(spark, path)  # rows written, commit missing
    current._write(delta.where("id IS NOT NULL"), path, 1, layout)
    current._append_loose(delta, path, 1, layout)
    assert rows_of(current.rows(spark, path)) == want
    current.merge(spark, path, 1, delta, upserted)
    assert rows_of(current.rows(spark, path)) == rows_of(upserted(table(spark, 50), delta))


def test_many_batches_keep_two_commits_and_every_loose_row(spark):
    path = fresh_path(spark, "current")
    current.begin(table(spark, 30), path, ["id"], 4)
    deltas = []
    for n in range(1, 7):
        rows = [(f"k{n % 3}", f"v{n}", None), (f"new{n}", "v", "x"), (None, f"loose{n}", None)]
        deltas.append(spark.createDataFrame(rows, SCHEMA))
        current.merge(spark, path, n, deltas[-1], upserted)
    plain = table(spark, 30)
    for delta in deltas:
        plain = upserted(plain, delta)
    assert rows_of(current.rows(spark, path)) == rows_of(plain)
    assert current._commits(spark, path) == [5, 6]
    kept = {f for b in (5, 6) for k, f in current._folders(spark, path, b).items() if k is not None}
    assert len(kept) <= 8
    held = {f"{path}/rows/{b}/{name}" for b in current._children(spark, f"{path}/rows", "batch=*")
            for name in current._children(spark, f"{path}/rows/{b}", "bucket=*")}
    assert held == kept
    with pytest.raises(ValueError):
        current.rows(spark, path, 2)


def test_empty_tables_empty_deltas_and_hot_keys(spark):
    path = fresh_path(spark, "current")
    none = spark.createDataFrame([], SCHEMA)
    current.begin(none, path, ["id"], 4)
    assert current.rows(spark, path).count() == 0
    assert current.merge(spark, path, 1, none, upserted) == [] and current.rows(spark, path).count() == 0
    hot = spark.range(2000).select(F.lit("k").alias("id"), F.col("id").cast("string").alias("name"), F.col("id").alias("_seq"),
                                   F.lit(None).cast("string").alias("note"))
    current.merge(spark, path, 2, hot, upserted)
    assert rows_of(current.rows(spark, path)) == ["Row(id='k', name='1999', note=None)"]
    with pytest.raises(ValueError):
        current.begin(none.withColumn("bucket", F.lit(1)), fresh_path(spark, "current"), ["id"])
