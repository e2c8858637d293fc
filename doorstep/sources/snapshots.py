"""Dated snapshots in hashed buckets with digests: a comparison reads only buckets that differ.

A day's rows lie in `rows/snapshot_date=<day>/bucket=<n>`, the bucket a hash of the key. Beside
them `digests/snapshot_date=<day>` has, for every bucket, the number of rows and two sums of
row hashes, which do not depend on the order of rows. Two days are compared by their digests
first, at most `buckets` rows each, and the scan of the rows is pruned to buckets whose digests
differ. Buckets with equal digests hold equal rows but for odds of about 2**-126.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.operators.trends import snapshot_diff

BUCKETS = 1024


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _row_hash(df: DataFrame, seed: int) -> Column:
    """A hash of all of a row; nulls count by their place."""
    cells = [F.col(f"`{c}`") for c in sorted(df.columns)]
    return F.xxhash64(F.lit(seed), *cells, *[c.isNull() for c in cells]).cast("decimal(38,0)")


def digests(df: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """`bucket, n, first, second` of every bucket, those without rows too. `df` has no map column."""
    kept = df.select(
        bucket_of(F.col(f"`{key}`"), buckets).alias("bucket"),
        _row_hash(df, 1).alias("first"), _row_hash(df, 2).alias("second"),
    )
    found = kept.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"), F.sum("second").alias("second")
    )
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").na.fill(0)


def write_day(df: DataFrame, path: str, day: str, key: str, buckets: int = BUCKETS) -> None:
    """One day's snapshot: one row per key, no null key, no column named `bucket`.

    Writing a day again replaces it. Its digests go first and come last: a write that was cut
    short leaves none, and a comparison then reads that day's buckets whole.
    """
    if "bucket" in df.columns:
        raise ValueError("a snapshot has no column of its own named bucket")
    spark, marks, rows = df.sparkSession, f"{path}/digests/snapshot_date={day}", f"{path}/rows/snapshot_date={day}"
    empty = spark.createDataFrame([], "bucket int, n long, first decimal(38,0), second decimal(38,0)")
    empty.write.mode("overwrite").parquet(marks)
    (
        df.withColumn("bucket", bucket_of(F.col(f"`{key}`"), buckets)).repartition("bucket")
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(rows)
    )
    written = spark.read.schema(df.schema).parquet(rows).select(*[f"`{c}`" for c in df.columns])
    digests(written, key, buckets).write.mode("overwrite").parquet(marks)


def differing_buckets(spark: SparkSession, path: str, before: str, after: str) -> list[int] | None:
    """Buckets whose digests differ, by at most `buckets` rows a day; None: all, digests are missing."""
    old, new = (
        {r.bucket: (r.n, r["first"], r.second) for r in spark.read.parquet(f"{path}/digests/snapshot_date={d}").collect()}
        for d in (before, after)
    )
    if not old or not new:
        return None
    if len(old) != len(new):
        raise ValueError(f"snapshots of {before} and {after} have {len(old)} and {len(new)} buckets")
    return sorted(b for b in old if old[b] != new[b])


def read_day(spark: SparkSession, path: str, day: str, schema: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """A day's rows, or those of some buckets: only their folders are read."""
    rows = spark.read.schema(f"{schema}, bucket int").parquet(f"{path}/rows/snapshot_date={day}")
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(list(buckets)) if buckets else F.lit(False))
    return rows.drop("bucket")


def changes(
    spark: SparkSession, path: str, before: str, after: str, schema: str, key: str, compared: Sequence[str]
) -> DataFrame:
    """Rows of `snapshot_diff` that are not `same`, from differing buckets alone."""
    buckets = differing_buckets(spark, path, before, after)
    old, new = (read_day(spark, path, d, schema, buckets) for d in (before, after))
    return snapshot_diff(old, new, key, compared).where(F.col("action") != "same")
