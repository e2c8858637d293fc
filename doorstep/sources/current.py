"""Keyed tables in hashed buckets: a merge reads and writes the buckets its keys fall into.

Rows lie in `rows/batch=<n>/bucket=<b>`, the bucket a hash of the key. `commits/batch=<n>` names
the folder that holds every bucket as of that batch, and a batch exists once its commit is
finished. Readers follow the newest commit, so a merge that fails half-way is not seen; a
finished batch that is sent again changes nothing. A commit and the one before it stay readable,
older ones go. One writer at a time.

Rows with a null in the key equal no other: they are appended under `loose/batch=<n>` and never
read or written again by a merge.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Buckets of a table, fixed when it is begun: a merge rewrites at least one bucket per key, so
#: a bucket should be no more than a file's worth of rows.
BUCKETS = 1024
_LAYOUT = "key array<string>, buckets int, columns string"
_COMMIT = "bucket int, folder string"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Layout:
    key: list[str]
    buckets: int
    schema: StructType


def begin(df: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS) -> None:
    """A new table of `df` as batch 0: one row per key, no column named `bucket`, no void column."""
    if "bucket" in df.columns:
        raise ValueError("a bucketed table has no column of its own named bucket")
    spark = df.sparkSession
    if _commits(spark, path):
        raise ValueError(f"{path} holds a table")
    layout = Layout(list(key), buckets, df.schema)
    spark.createDataFrame([(layout.key, buckets, df.schema.json())], _LAYOUT).coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/layout")
    _commit(spark, path, 0, {}, _write(df.where(_keyed(layout)), path, 0, layout), _append_loose(df, path, 0, layout))


def merge(spark: SparkSession, path: str, batch: int, incoming: DataFrame, how: Merge) -> list[int]:
    """Bring `incoming` in as `batch`; gives the buckets written, none for a batch that is finished.

    `how(stored, incoming)` gets the rows of the touched buckets and the incoming rows, both with
    keys without nulls, and returns all rows those buckets hold from now on. It may not move a
    row to another key. `incoming` has the table's columns and perhaps others; it is read four times,
    so one that costs much should be a written table.
    """
    done = _commits(spark, path)
    if not done:
        raise ValueError(f"{path} holds no table")
    if batch in done or batch < done[-1]:
        return []
    layout, folders = _layout(spark, path), _folders(spark, path, done[-1])
    keyed = incoming.where(_keyed(layout))
    places = keyed.select(_bucket(layout).alias("bucket")).distinct()
    touched = sorted(r.bucket for r in places.collect())
    written: dict[int, str] = {}
    if touched:
        stored = _read(spark, layout, [folders[b] for b in touched if b in folders])
        after = how(stored, keyed).select(*_columns(layout))
        written = _write(after, path, batch, layout)
    stay = {b: f for b, f in folders.items() if b is None or b not in set(touched)}
    _commit(spark, path, batch, stay, written, _append_loose(incoming, path, batch, layout))
    return touched


def rows(spark: SparkSession, path: str, batch: int | None = None) -> DataFrame:
    """The table as of its newest commit, or of `batch` while that is kept."""
    done = _commits(spark, path)
    if not done or (batch is not None and batch not in done):
        raise ValueError(f"{path} has no commit {'' if batch is None else batch}")
    folders = _folders(spark, path, done[-1] if batch is None else batch)
    loose = folders.pop(None, [])
    return _read(spark, _layout(spark, path), [*folders.values(), *loose])


def _columns(layout: Layout) -> list[str]:
    return [f"`{c}`" for c in layout.schema.names]


def _bucket(layout: Layout) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in layout.key]), F.lit(layout.buckets)).cast("int")


def _keyed(layout: Layout) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{k}`").isNotNull() for k in layout.key])


def _read(spark: SparkSession, layout: Layout, folders: Sequence[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], layout.schema)
    return spark.read.schema(layout.schema).parquet(*folders)


def _write(df: DataFrame, path: str, batch: int, layout: Layout) -> dict[int, str]:
    """Folder of every bucket that `df` has rows in."""
    folder = f"{path}/rows/{_name(batch)}"
    placed = df.withColumn("bucket", _bucket(layout)).repartition("bucket")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(folder)
    found = _children(df.sparkSession, folder, "bucket=*")
    return {int(name.split("=")[1]): f"{folder}/{name}" for name in found}


def _append_loose(df: DataFrame, path: str, batch: int, layout: Layout) -> list[str]:
    loose, folder = df.where(~_keyed(layout)).select(*_columns(layout)), f"{path}/loose/{_name(batch)}"
    if loose.isEmpty():
        return []
    loose.write.mode("overwrite").parquet(folder)
    return [folder]


def _commit(spark: SparkSession, path: str, batch: int, stay: dict, written: dict[int, str], loose: list[str]) -> None:
    stay = dict(stay)
    entries = [(None, f) for f in [*stay.pop(None, []), *loose]] + list({**stay, **written}.items())
    table = spark.createDataFrame(entries, _COMMIT).coalesce(1)
    table.write.mode("overwrite").parquet(f"{path}/commits/{_name(batch)}")
    done = _commits(spark, path)
    kept = {f for b in done[-2:] for b_, f in _folders(spark, path, b).items() if b_ is not None}
    for old in done[:-2]:
        for bucket, folder in _folders(spark, path, old).items():
            if bucket is not None and folder not in kept:
                _delete(spark, folder)
        _delete(spark, f"{path}/commits/{_name(old)}")


def _name(batch: int) -> str:
    return f"batch={batch:012d}"


def _folders(spark: SparkSession, path: str, batch: int) -> dict:
    """Folder by bucket, at most one a bucket; under None the list of loose folders."""
    out: dict = {}
    for r in spark.read.schema(_COMMIT).parquet(f"{path}/commits/{_name(batch)}").collect():
        if r.bucket is None:
            out.setdefault(None, []).append(r.folder)
        else:
            out[r.bucket] = r.folder
    return out


def _layout(spark: SparkSession, path: str) -> Layout:
    row = spark.read.schema(_LAYOUT).parquet(f"{path}/layout").first()
    return Layout(list(row.key), row.buckets, StructType.fromJson(json.loads(row.columns)))


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Finished batches, oldest first; at most three."""
    names = _children(spark, f"{path}/commits", "batch=*/_SUCCESS", parent=True)
    return sorted(int(name.split("=")[1]) for name in names)


def _children(spark: SparkSession, folder: str, pattern: str, parent: bool = False) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [(s.getPath().getParent() if parent else s.getPath()).getName() for s in found]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
