"""Append-only tables as streams, and idempotent sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from doorstep.operators.ordering import latest_per_key


def read_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    files_per_batch: int | None = None,
    only: str | None = None,
) -> DataFrame:
    """A folder of parquet files as a stream; `only` is a pattern of file names."""
    reader = spark.readStream.schema(schema)
    if only:
        reader = reader.option("pathGlobFilter", only)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def changelog(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's updated rows under its batch number.

    A batch that runs again after a failure overwrites its own folder, so every update is
    stored once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """The latest row of every key in a changelog."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in key and c != "batch"]
    return latest_per_key(log, list(key), ["batch"], rest)


#: Buckets of a current-state table.
BUCKETS = 64


def compacted(
    df: DataFrame, path: str, checkpoint: str, key: Sequence[str], buckets: int = BUCKETS
) -> StreamingQuery:
    """Keep the latest row of every key of an update stream, in a table of hashed buckets.

    A batch reads the buckets its keys fall into, replaces those keys' rows and writes the buckets anew
    under its own number; buckets it does not touch stay where they are. Readers see a bucket's
    newest finished version, and the one before it stays until the next, so a batch that fails half-way
    or runs again changes nothing. What is read follows the keys, not the batches.
    """
    key = list(key)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        placed = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r.bucket for r in placed.select("bucket").distinct().collect()]
            if not touched:
                return
            versions = _versions(spark, path, before=number)
            held = [versions[b][0][1] for b in touched if b in versions]
            rows = placed
            if held:
                old = spark.read.option("basePath", path).parquet(*held).select(*placed.columns)
                same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in key]
                stays = old.alias("old").join(placed.select(*key).alias("new"), same, "left_anti")
                rows = stays.unionByName(placed)
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number:012d}")
            for b in touched:
                for _, old_path in versions.get(b, [])[1:]:
                    _delete(spark, old_path)
        finally:
            placed.unpersist()

    return (
        df.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def current_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a compacted table."""
    newest = [found[0][1] for found in _versions(spark, path).values()]
    return spark.read.option("basePath", path).parquet(*newest).drop("batch", "bucket")


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Finished (batch, folder) per bucket, newest first; at most two and one being replaced."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    pattern = spark._jvm.org.apache.hadoop.fs.Path
    done = {
        int(s.getPath().getParent().getName().split("=")[1])
        for s in files.globStatus(pattern(f"{path}/batch=*/_SUCCESS")) or []
    }
    out: dict[int, list[tuple[int, str]]] = {}
    for status in files.globStatus(pattern(f"{path}/batch=*/bucket=*")) or []:
        folder = status.getPath()
        batch, bucket = (int(p.getName().split("=")[1]) for p in (folder.getParent(), folder))
        if batch in done and (before is None or batch < before):
            out.setdefault(bucket, []).append((batch, folder.toString()))
    return {b: sorted(v, reverse=True) for b, v in out.items()}


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write final rows once; the file sink keeps its own commit log."""
    return (
        df.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def as_instant(df: DataFrame, column: str) -> DataFrame:
    """A zone-less time column as an instant (session zone UTC), as watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))
