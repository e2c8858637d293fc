"""Dropping lines that many documents share, by sharded minimal perfect hashes.

1. Every document gives its distinct line keys as two 64-bit hashes; one aggregate counts the
   documents of each key.
2. Keys are dealt to shards by hash. Each shard becomes one row: a minimal perfect hash over its
   keys (levels of bit arrays) and, in its slots, flat arrays of fingerprints and counts.
3. Documents probe with hashes only: 16 bytes and a document key per line, no line text. A probe
   finds its slot, checks the fingerprint and reads the count. A shard with many probes (a line in a third
   of all documents) is laid out several times, in proportion to its load, and its probes are
   dealt over the copies, so a hot line is no hot task.
4. Hits return to their documents and the text is put together again in the JVM.

A document is a row. Its key in step 3 is (doc_id, hash of text): equal rows share their answer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.rules import bind
from doorstep.llm.store import packed, stored
from doorstep.llm.words import mix

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shards at least, and the probes (a line of a document is one) that a shard has at most on average.
SHARDS, SHARD_PROBES = 4096, 1 << 18
LEVEL_SEED = 0x51ED270B


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return F.translate(F.trim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes_of(key: Column) -> Column:
    return F.struct(
        F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit(1)).alias("b"),
        F.char_length(key).alias("n"),
    )


# ---- minimal perfect hash of one shard


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ np.uint64(LEVEL_SEED * (level + 1))) % np.uint64(size)).astype(np.int64)


def build_mph(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Level sizes, all levels' bits end to end, and the slot of each of the distinct `keys`.

    In every level a key that has a place to itself stays; the others go on to the next. A
    key's slot is the number of set bits before its own, so n keys fill slots 0 to n - 1.
    """
    sizes, levels = [], []
    left = np.arange(len(keys))
    place = np.zeros(len(keys), np.int64)
    base = 0
    while len(left):
        size = max(int(len(left) * 1.5), 8)
        at = _slot(keys[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        stays = alone[at]
        place[left[stays]] = base + at[stays]
        sizes.append(size)
        levels.append(alone)
        base += size
        left = left[~stays]
    bits = np.concatenate(levels) if levels else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    return sizes, np.packbits(bits), rank[place] if len(keys) else place


def find_slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key; -1 where no level holds it."""
    bits = np.unpackbits(bits, count=int(sum(sizes))).astype(bool)
    rank = np.cumsum(bits) - 1
    out = np.full(len(keys), -1, np.int64)
    left, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + _slot(keys[left], level, size)
        here = bits[at]
        out[left[here]] = rank[at[here]]
        left, base = left[~here], base + size
    return out


INDEX = "shard int, sizes array<int>, bits binary, prints binary, counts binary"


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _build(table: pa.Table) -> pa.Table:
    a = _column(table, "a").view(np.uint64)
    b = _column(table, "b").view(np.uint64)
    # Both hashes make the key, so keys that share one of them stay apart.
    sizes, bits, slot = build_mph(a ^ mix(b))
    prints, counts = np.zeros(len(a), np.uint64), np.zeros(len(a), np.int64)
    prints[slot], counts[slot] = b, _column(table, "n")
    return pa.table({
        "shard": pa.array([table.column("shard")[0].as_py()], pa.int32()),
        "sizes": pa.array([sizes], pa.list_(pa.int32())),
        "bits": pa.array([bits.tobytes()], pa.binary()),
        "prints": pa.array([prints.tobytes()], pa.binary()),
        "counts": pa.array([counts.astype("<u4").tobytes()], pa.binary()),
    })


def _probe(least: int):
    def run(probes: pa.Table, index: pa.Table) -> pa.Table:
        keep = np.zeros(probes.num_rows, bool)
        if index.num_rows and probes.num_rows:
            row = index.slice(0, 1).to_pylist()[0]
            a = _column(probes, "a").view(np.uint64)
            b = _column(probes, "b").view(np.uint64)
            slot = find_slots(a ^ mix(b), row["sizes"], np.frombuffer(row["bits"], np.uint8))
            prints = np.frombuffer(row["prints"], np.uint64)
            counts = np.frombuffer(row["counts"], "<u4")
            keep = (slot >= 0) & (prints[slot] == b) & (counts[slot] >= least)
        return probes.select(["doc_id", "text_hash", "a", "b"]).filter(pa.array(keep))

    return run


def shard_of(a: Column, shards: int) -> Column:
    return F.pmod(a, F.lit(shards)).cast("int")


def line_index(counts: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row per shard: perfect hash, fingerprints and counts of the lines `a, b, n`."""
    return (
        counts.select(shard_of(F.col("a"), shards).alias("shard"), "a", "b", "n")
        .groupBy("shard").applyInArrow(_build, INDEX)
    )


def shared_lines(docs: DataFrame, least: int = 10, shortest: int = 1, shards: int | None = None) -> DataFrame:
    """Per (doc_id, text_hash): `drop`, the sorted hashes of its lines that at least `least` rows hold.

    The number of shards follows the lines counted, so that a shard fits a task at any size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Distinct as strings, whose set is a hash set; structs would be compared pair by pair.
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    # Written once: counting and probing both read hashes, not texts.
    probes = stored(
        docs.select(
            "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            F.explode(F.transform(keys, hashes_of)).alias("k"),
        )
        .where(F.col("k.n") >= shortest)
        .select("doc_id", "text_hash", F.col("k.a").alias("a"), F.col("k.b").alias("b")),
        "line-probes",
    )
    counts = stored(
        probes.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "line-counts"
    )
    if shards is None:
        shards = max(SHARDS, -(-(counts.agg(F.sum("n")).first()[0] or 0) // SHARD_PROBES))
    # At most `shards` rows: how many copies of each shard its load asks for.
    loads = counts.groupBy(shard_of(F.col("a"), shards).alias("shard")).agg(F.sum("n").alias("load"))
    mean = (loads.agg(F.avg("load")).first()[0]) or 1.0
    copies = F.broadcast(
        loads.select("shard", F.ceil(F.col("load") / (2 * mean)).cast("int").alias("copies"))
    )
    index = (
        line_index(counts, shards).join(copies, "shard")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .drop("copies")
    )
    dealt = (
        probes.withColumn("shard", shard_of(F.col("a"), shards)).join(copies, "shard")
        .withColumn("salt", F.pmod(F.xxhash64("text_hash", "doc_id"), F.col("copies")).cast("int"))
        .drop("copies")
    )
    hits = dealt.groupBy("shard", "salt").cogroup(index.groupBy("shard", "salt")).applyInArrow(
        _probe(least), f"doc_id {kind}, text_hash long, a long, b long"
    )
    return hits.groupBy("doc_id", "text_hash").agg(
        F.sort_array(F.collect_set(F.struct("a", "b"))).alias("drop")
    )


def is_in(value: Column, found: Column) -> Column:
    """Whether a sorted array has the value: a binary search, so that a long text costs n log n."""
    steps = F.array(*[F.lit(1 << s) for s in range(30, -1, -1)])
    # How many entries are not above the value, one bit after another.
    upto = F.aggregate(
        F.filter(steps, lambda s: s <= F.size(found)), F.lit(0),
        lambda at, s: F.when(
            (at + s <= F.size(found)) & (F.get(found, at + s - 1) <= value), at + s
        ).otherwise(at),
    )
    return F.coalesce(F.get(found, upto - 1) == value, F.lit(False))


def dedup_lines(docs: DataFrame, least: int = 10, shortest: int = 1, shards: int | None = None) -> DataFrame:
    """`docs` plus `kept_text`, `n_lines` and `n_dropped`.

    Null and empty texts have one empty line, which is never dropped. All copies of a shared
    line go, in every row; the other lines keep their order. Equal rows count as rows of their
    own. Other columns pass unchanged, whatever their names; those three are replaced.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    found = shared_lines(docs, least, shortest, shards).select(
        F.col("doc_id").alias("found_id"), F.col("text_hash").alias("found_hash"), "drop"
    )
    rows = packed(
        docs, own_id=F.col("doc_id"), own_hash=F.xxhash64(F.coalesce("text", F.lit(""))),
        lines=lines_of(F.col("text")),
    )
    same = F.col("own_id").eqNullSafe(F.col("found_id")) & (F.col("own_hash") == F.col("found_hash"))

    def stays(line: Column) -> Column:
        return ~bind(line_key(line), lambda k: is_in(
            F.struct(F.xxhash64(k).alias("a"), F.xxhash64(k, F.lit(1)).alias("b")), F.col("drop")
        ))

    kept = F.when(F.col("drop").isNull(), F.col("lines")).otherwise(F.filter("lines", stays))
    return rows.join(found, same, "left").select(
        "row", F.size("lines").cast("bigint").alias("n_lines"), kept.alias("kept")
    ).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in added],
        F.array_join("kept", "\n").alias("kept_text"), "n_lines",
        (F.col("n_lines") - F.size("kept")).alias("n_dropped"),
    )


def without_shared_lines(docs: DataFrame, least: int = 10, shortest: int = 1, shards: int | None = None) -> DataFrame:
    """The same rows and columns with `text` and `n_chars` of what is kept."""
    kept = dedup_lines(docs, least, shortest, shards)
    fresh = {"text": F.col("kept_text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*[fresh.get(c, F.col(c)).alias(c) for c in docs.columns])
