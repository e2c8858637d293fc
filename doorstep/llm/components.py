"""Connected components of a link table: forests per task, then star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doorstep.llm.store import discard, stored

#: Links that one task holds at a time; more of them only make more, smaller forests.
FOREST = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that join what the links a, b join."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        rx, ry = root[x], root[y]
        apart = rx != ry
        x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(near := root[root], root):
            root = near
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _forests(batches):
    def grown(a, b):
        node, root = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])

    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column("a").to_numpy(zero_copy_only=False))
        b.append(batch.column("b").to_numpy(zero_copy_only=False))
        held += batch.num_rows
        if held >= FOREST:
            yield grown(a, b)
            a, b, held = [], [], 0
    if held:
        yield grown(a, b)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """`node`, `root` of every linked node but the roots; a root is its component's smallest node.

    `links` has columns a, b of 64-bit numbers. First every task turns the links of its nodes
    into a forest, so a node with many links keeps about one (any division of the links
    is right; a hot node's are split). Then every round points the
    larger neighbours of each node, then the smaller ones, at the smallest node near. Rounds
    grow with the logarithm of the longest path. Each round is written once; the driver sees
    a count and a checksum.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .hint("rebalance", "a").mapInArrow(_forests, "a long, b long").distinct(),
        "links",
    )
    before = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").where("b > a")
            .select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(
                F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
            )).alias("e")
        )
        fresh = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "links")
        discard(edges)
        edges = fresh
        now = _state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
