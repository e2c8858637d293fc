"""Fixity of record archives: hash trees over offset ranges, compared level by level.

A record's leaf follows from its page_id, so that no loss moves another record's leaf; without an
id it follows from the content hash. A leaf's hash covers the ids, hashes and counts of its
records. Every `FANOUT` neighbours make a node, whose hash covers its children's with their
places, up to one root per file. Replicas are compared by their roots; only below differing nodes
are children looked at, so an audit of sound replicas reads roots, and one bad record costs one
path. Records are compared only in differing leaves. Only hashes are shuffled, never records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doorstep.llm.store import stored

FANOUT = 16
LEVELS = 4  # enough for 16 ** 4 records a file
RECORDS = 1000


def warc_record(url: Column, body: Column) -> Column:
    """A response record: header lines, an empty line, the body, two line ends."""
    whole = F.coalesce(body, F.lit(""))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit(""))),
        F.concat(F.lit("Content-Length: "), F.octet_length(whole).cast("string")), F.lit(""), F.lit(""),
    )
    return F.concat(head, whole, F.lit("\r\n\r\n"))


def archived(pages: DataFrame, records: int = RECORDS) -> DataFrame:
    """`file, offset, size, hash, page_id`: where each page lies in files of `records` ids each.

    Records of a file follow page_id, then url and content hash. Pages without an id are dealt to files
    by their content, so they fill many. Null urls and bodies are empty; other columns are ignored.
    """
    spread = -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 16))
    rows = pages.select(
        F.coalesce(F.floor(F.col("page_id") / records), spread).cast("bigint").alias("file"),
        "page_id", "url", warc_record(F.col("url"), F.col("html")).alias("_record"),
    ).select("file", "page_id", "url", F.octet_length("_record").cast("bigint").alias("size"),
             F.sha2("_record", 256).alias("hash"))
    before = (
        Window.partitionBy("file").orderBy("page_id", "url", "hash")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return rows.select(
        "file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"), "size", "hash", "page_id"
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """`file, offset, size, hash, body` of the records in WARC files, plain or gzip per record.

    Offsets and sizes are those of the uncompressed stream. A record whose header does not parse ends its file
    with one row that has no body. One task reads one file, as that format has no index.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                if data[:2] == b"\x1f\x8b":
                    data = gzip.decompress(data)
                at, rows = 0, []
                while at < len(data):
                    stop = data.find(b"\r\n\r\n", at)
                    head = data[at:stop].split(b"\r\n") if stop > 0 else []
                    fields = dict(h.lower().split(b": ", 1) for h in head[1:] if b": " in h)
                    size = fields.get(b"content-length", b"")
                    end = stop + 8 + int(size) if head and head[0].startswith(b"WARC/") and size.isdigit() else None
                    record = data[at:end]
                    rows.append((name, at, len(record), hashlib.sha256(record).hexdigest(),
                                 data[stop + 4 : end - 4] if end else None))
                    at += len(record)
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (
                            pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()))],
                        names=["file", "offset", "size", "hash", "body"],
                    )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, offset long, size long, hash string, body binary")


def leaf_of(fanout: int = FANOUT, levels: int = LEVELS) -> Column:
    """The leaf of a record in its file: the same in every replica, whatever else the file holds."""
    leaves = F.lit(fanout**levels)
    return F.coalesce(F.pmod(F.col("page_id"), leaves), F.pmod(F.xxhash64("hash"), leaves)).cast("bigint")


def tree(records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`file, level, node, hash, low, high` of all nodes: leaves are level 0, `levels` is the root.

    `low` and `high` are the byte range of a node's records. A node has at most `fanout` children.
    Repeated records are counted before a leaf is gathered.
    """
    counted = records.groupBy("file", leaf_of(fanout, levels).alias("node"), "page_id", "hash").agg(
        F.count(F.lit(1)).alias("n"), F.min("offset").alias("low"), F.max(F.col("offset") + F.col("size")).alias("high"),
    )
    # Every field is there in every entry, so a missing id is told from any other.
    entry = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "hash", F.col("n").cast("string"))
    nodes = counted.groupBy("file", "node").agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(entry)), ","), 256).alias("hash"),
        F.min("low").alias("low"), F.max("high").alias("high"),
    ).select("file", F.lit(0).alias("level"), "node", "hash", "low", "high")
    nodes = stored(nodes, "fixity-leaves")
    out = nodes
    for level in range(1, levels + 1):
        nodes = nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("parent")).agg(
            F.sha2(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("node", "hash"))),
                lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ","), 256).alias("hash"),
            F.min("low").alias("low"), F.max("high").alias("high"),
        ).select("file", F.lit(level).alias("level"), F.col("parent").alias("node"), "hash", "low", "high")
        nodes = stored(nodes, "fixity-nodes")  # a sixteenth of the level below
        out = out.unionByName(nodes)
    return out


def audit(ours: DataFrame, theirs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Differing leaves of two trees: `file, node, low, high, fault`.

    `fault` is `changed` where both have the leaf, `lost` where only the first has it, `extra`
    where only the second has it. Ids further apart than the leaves of a file share one, and so do
    repeated records; `located` names the records of a leaf.
    """
    def level(table: DataFrame, k: int, end: str) -> DataFrame:
        return table.where(F.col("level") == k).select(
            "file", "node", F.col("hash").alias(f"hash_{end}"), F.col("low").alias(f"low_{end}"),
            F.col("high").alias(f"high_{end}"),
        )

    bad = None
    for k in range(levels, -1, -1):
        a, b = level(ours, k, "a"), level(theirs, k, "b")
        if bad is not None:
            up = F.floor(F.col("node") / fanout)
            a = a.withColumn("_up", up).join(bad, ["file", "_up"], "left_semi").drop("_up")
            b = b.withColumn("_up", up).join(bad, ["file", "_up"], "left_semi").drop("_up")
        wrong = a.join(b, ["file", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))
        wrong = stored(wrong, "fixity-wrong")  # read by both sides of the next level
        bad = wrong.select("file", F.col("node").alias("_up"))
    return wrong.select(
        "file", "node", F.coalesce("low_a", "low_b").alias("low"), F.coalesce("high_a", "high_b").alias("high"),
        F.when(F.col("hash_b").isNull(), "lost").when(F.col("hash_a").isNull(), "extra")
        .otherwise("changed").alias("fault"), "hash_a", "hash_b",
    )


def located(ours: DataFrame, theirs: DataFrame, records_a: DataFrame, records_b: DataFrame,
            fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """`file, page_id, fault` of the records in differing leaves, one row per faulty record.

    Records count: of copies with one id and content, those that the other replica has fewer of are
    faulty. Per id, what is over on both sides is `changed`; the rest is `lost` or `extra`. Records
    without an id are compared among those of their leaf.
    """
    bad = audit(ours, theirs, fanout, levels).select("file", F.col("node").alias("_leaf"))

    def inside(records: DataFrame, sign: int) -> DataFrame:
        rows = records.select("file", "page_id", "hash", leaf_of(fanout, levels).alias("_leaf"))
        return rows.join(bad, ["file", "_leaf"], "left_semi").withColumn("n", F.lit(sign).cast("bigint"))

    both = inside(records_a, 1).unionByName(inside(records_b, -1))
    over = both.groupBy("file", "page_id", "hash").agg(F.sum("n").alias("n")).where("n <> 0")
    sides = over.groupBy("file", "page_id").agg(
        F.sum(F.greatest("n", F.lit(0))).alias("a"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("b")
    )
    changed = F.least("a", "b")
    faults = sides.select("file", "page_id", F.explode(F.array(
        F.struct(F.lit("changed").alias("fault"), changed.alias("n")),
        F.struct(F.lit("lost").alias("fault"), (F.col("a") - changed).alias("n")),
        F.struct(F.lit("extra").alias("fault"), (F.col("b") - changed).alias("n")),
    )).alias("_f")).where("_f.n > 0")
    return faults.select("file", "page_id", "_f.fault", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_f.n"))).alias("_k")).drop("_k")
