"""Where the operators of this package keep what several steps read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doorstep.session import fresh_path, prepare

# Arrow batches between the JVM and Python: small enough for very long texts.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def ready(spark: SparkSession) -> SparkSession:
    """The session with this package's runtime settings."""
    prepare(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written once to the shared folder and read back: nothing above it runs again."""
    path = fresh_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that no later step reads."""
    session = table.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(table.stored_path)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The caller's row as one struct `row`, beside `columns`: no name of the caller's clashes."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20):
    """Runs of rows whose texts hold about `limit` bytes; a longer text is a run of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        begin = held = 0
        for row, size in enumerate(sizes):
            if row > begin and held + size > limit:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += size
        if begin < len(sizes):
            yield batch.slice(begin)
