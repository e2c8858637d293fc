"""Reading and writing the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from doorstep.sources.schemas import TABLES


def table_schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A domain table with its declared columns, never inferred and never `*`."""
    schema = table_schema(name)
    return spark.read.schema(schema).parquet(f"{folder}/{name}").select(*schema.names)


def read_spread(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """A parquet table whose rows are spread over all task slots.

    For work that is heavy per row. A table in fewer pieces than there are slots is
    repartitioned by its keys; a table in many files is read as it is, without a shuffle.
    """
    table = spark.read.parquet(path)
    slots = spark.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= slots:
        return table
    return table.repartition(slots, *keys)


def write_table(df: DataFrame, folder: str, name: str, mode: str = "overwrite") -> None:
    df.select(*table_schema(name).names).write.mode(mode).parquet(f"{folder}/{name}")


def write_snapshot(df: DataFrame, path: str, day: Column) -> None:
    """Dated snapshot; writing a day again replaces that day and no other."""
    (
        df.withColumn("snapshot_date", day)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("snapshot_date")
        .parquet(path)
    )


def read_snapshot(spark: SparkSession, path: str, day: str) -> DataFrame:
    """One day of a dated snapshot; only that day's folder is listed and read."""
    return spark.read.parquet(path).where(F.col("snapshot_date") == F.lit(day).cast("date"))


def write_sheet(df: DataFrame, path: str, format: str = "csv") -> None:
    """The lead sheet as csv (with header, NULL as an empty cell) or parquet."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", "").option(
            "escape", '"'
        ).csv(path)
    else:
        writer.parquet(path)


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Sheet cells by header name, all text; short rows are padded with NULL."""
    return (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
