"""Approximate nearest neighbours: a navigable small-world graph with levels per shard.

1. Vectors that cannot be compared (null, zero, null or non-finite components) are left out.
   Equal vectors become one node that keeps its smallest ids, as many as a query may return.
2. Nodes are dealt to shards by a hash of the vector; usable vectors are counted first, and the
   number of shards follows the count. A shard's graph is built by inserting
   blocks of nodes: each block's neighbours are searched in the graph so far and among the
   block itself, and the nearest that are not nearer to each other are linked. The graph is
   stored as one row of flat arrays: vectors, neighbour table per level, ids.
3. Queries go to every shard as a stream of batches; a batch descends the levels and then widens
   a beam of `ef` nodes, all its queries in step. Shard results are merged by rank.

Largest inner product is turned into least distance by one more component that gives all nodes
of a shard the same length. Scores are recomputed in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.llm.store import stored


@dataclass(frozen=True)
class Graph:
    """Parameters: links per node, beam while building and while searching, nodes per block."""

    links: int = 16
    build: int = 48
    search: int = 96
    block: int = 256
    shard: int = 1 << 18  # vectors in a shard, so that they and their graph fit a task
    least: int = 16  # shards of a small table, for tasks to run side by side
    seen: int = 1 << 25  # queries times nodes marked at a time

    def shards(self, vectors: int) -> int:
        return max(self.least, -(-vectors // self.shard))


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _closest(have_ids, have_d, more_ids, more_d, size):
    ids, d = np.concatenate([have_ids, more_ids], 1), np.concatenate([have_d, more_d], 1)
    if ids.shape[1] > size:
        part = np.argpartition(d, size - 1, axis=1)[:, :size]
        ids, d = np.take_along_axis(ids, part, 1), np.take_along_axis(d, part, 1)
    return ids, d


def beam(data, table, queries, enter, size, marks=1 << 25):
    """The `size` nodes nearest to each query that walking `table` from `enter` finds.

    Queries go in blocks that mark at most `marks` visited nodes, one query at least.
    """
    n = len(data)
    norm = np.einsum("ij,ij->i", data, data)
    step = max(1, marks // (n + 1))
    parts = [
        _beam(data, norm, table, queries[k : k + step], enter[k : k + step], size)
        for k in range(0, max(1, len(queries)), step)
    ]
    width = max(ids.shape[1] for ids, _ in parts)
    wide = [((0, 0), (0, width - ids.shape[1])) for ids, _ in parts]
    return (
        np.concatenate([np.pad(ids, w, constant_values=n) for (ids, _), w in zip(parts, wide)]),
        np.concatenate([np.pad(d, w, constant_values=np.inf) for (_, d), w in zip(parts, wide)]),
    )


def _beam(data, norm, table, queries, enter, size):
    """`beam` of one block.

    All queries step together: each opens its nearest unopened node, looks at the node's
    unseen neighbours and keeps the best. A query is done when all it keeps are opened.
    """
    n, rows = len(data), np.arange(len(queries))
    seen = np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True
    ids = enter.reshape(len(queries), -1)
    d = norm[ids] - 2 * np.einsum("qkd,qd->qk", data[ids], queries)
    np.put_along_axis(seen, ids, True, 1)
    opened = np.zeros((len(queries), n + 1), bool)
    opened[:, n] = True
    live = rows
    while len(live):
        closed = np.where(opened[live[:, None], ids[live]], np.inf, d[live])
        best = closed.argmin(1)
        going = np.isfinite(closed[np.arange(len(live)), best])
        live, best = live[going], best[going]
        if not len(live):
            break
        node = ids[live, best]
        opened[live, node] = True
        near = table[node]
        fresh = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        safe = np.where(near < n, near, 0)
        found = norm[safe] - 2 * np.einsum("qkd,qd->qk", data[safe], queries[live])
        found = np.where(fresh, found, np.inf)
        near = np.where(fresh, near, n)
        kept, kept_d = _closest(ids[live], d[live], near, found, size)
        if kept.shape[1] > ids.shape[1]:
            grow = kept.shape[1] - ids.shape[1]
            ids = np.concatenate([ids, np.full((len(queries), grow), n)], 1)
            d = np.concatenate([d, np.full((len(queries), grow), np.inf)], 1)
        ids[live, : kept.shape[1]], d[live, : kept.shape[1]] = kept, kept_d
    order = np.argsort(d, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def _spread(data, ids, links):
    """Of candidates in order of distance, those nearer to the node than to one chosen before."""
    kept: list[int] = []
    if not len(ids):
        return kept
    point, near = data[ids[0]], data[ids[1:]]
    own = ((near - point) ** 2).sum(1)
    between = ((near[:, None] - near[None]) ** 2).sum(2)
    chosen: list[int] = []
    for k in range(len(near)):
        if all(own[k] < between[k, c] for c in chosen):
            chosen.append(k)
            if len(chosen) == links:
                break
    for k in range(len(near)):  # fill up with the nearest of the others
        if len(chosen) >= links // 2 or len(chosen) == len(near):
            break
        if k not in chosen:
            chosen.append(k)
    return [int(ids[1 + k]) for k in chosen]


def _link(data, table, node, candidates, links):
    """Set a node's links and the links back; a full neighbour chooses anew."""
    n = len(data)
    chosen = _spread(data, np.array([node, *candidates]), links)
    table[node, : len(chosen)] = chosen
    for other in chosen:
        row = table[other]
        free = np.flatnonzero(row == n)
        if node in row:
            continue
        if len(free):
            row[free[0]] = node
            continue
        held = np.append(row, node)
        d = ((data[held] - data[other]) ** 2).sum(1)
        again = _spread(data, np.array([other, *held[np.argsort(d, kind="stable")]]), len(row))
        row[:] = n
        row[: len(again)] = again


def _bridged(data, table):
    """`table` with one more column, which leads to nodes that no walk from node 0 would reach."""
    n = len(data)
    bridge = np.full(n, n, np.int32)
    reached = np.zeros(n + 1, bool)
    reached[n] = True

    def walk(start):
        reached[start] = True
        edge = np.array([start])
        while len(edge):
            near = np.unique(table[edge])
            edge = near[~reached[near]]
            reached[edge] = True

    walk(0)
    for node in range(n):
        if not reached[node]:
            doors = np.flatnonzero(reached[:n] & (bridge == n))
            bridge[doors[((data[doors] - data[node]) ** 2).sum(1).argmin()]] = node
            walk(node)
    return np.concatenate([table, bridge[:, None]], 1)


def build_graph(data: np.ndarray, graph: Graph) -> list[np.ndarray]:
    """Neighbour tables, lowest level first; nodes are in insertion order, missing links are n.

    Node i is on level k where i is divisible by `links` ** k: as nodes come in hashed order, that is a random
    choice with the usual rates.
    """
    n = len(data)
    tables = []
    top = 0
    while graph.links ** (top + 1) < n:
        top += 1
    for level in range(top, -1, -1):
        step = graph.links**level
        members = np.arange(0, n, step)
        width = 2 * graph.links if level == 0 else graph.links
        part = data[members]
        table = np.full((len(part), width), len(part), np.int32)
        begin = 0
        while begin < len(part):  # blocks no larger than the graph so far
            stop = min(begin + max(1, min(begin, graph.block)), len(part))
            block = part[begin:stop]
            inside = ((block[:, None] - block[None]) ** 2).sum(2) if len(block) <= 64 else (
                (block**2).sum(1)[:, None] + (block**2).sum(1)[None] - 2 * block @ block.T
            )
            np.fill_diagonal(inside, np.inf)
            near = np.argsort(inside, axis=1, kind="stable")[:, : graph.links]
            if begin:
                local = np.where(table[:begin] < begin, table[:begin], begin)
                start = np.zeros((len(block), 1), np.int64)
                found, _ = beam(part[:begin], local, block, start, graph.build, graph.seen)
            for k in range(len(block)):
                options = near[k][near[k] != k] + begin
                if begin:
                    options = np.concatenate([options, found[k][found[k] < begin]])
                d = ((part[options] - block[k]) ** 2).sum(1)
                _link(part, table, begin + k, options[np.argsort(d, kind="stable")], graph.links)
            begin = stop
        tables.append(_bridged(part, table))
    return tables[::-1]


def search_graph(data, tables, graph_links, queries, size, marks=1 << 25):
    """Nodes near each query: down the levels from node 0, then a beam of `size` on the lowest."""
    enter = np.zeros((len(queries), 1), np.int64)
    for level in range(len(tables) - 1, 0, -1):
        step = graph_links**level
        ids, _ = beam(data[::step], tables[level], queries, enter // step, 4, marks)
        enter = np.minimum(ids[:, :1], len(tables[level]) - 1) * step
    return beam(data, tables[0], queries, enter, size, marks)


INDEX = "shard int, size int, width int, vectors binary, tables array<binary>, ids binary, counts binary"


def _flat(lists: pa.ChunkedArray) -> pa.ChunkedArray:
    return pa.chunked_array([chunk.flatten() for chunk in lists.chunks])


def _build(graph: Graph):
    def run(nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("place")
        n = nodes.num_rows
        original = _flat(nodes.column("vector")).to_numpy().reshape(n, -1)
        norm = np.sqrt(np.einsum("ij,ij->i", original, original, dtype=np.float64))
        rest = np.sqrt(np.maximum(norm.max() ** 2 - norm**2, 0))
        data = np.concatenate([original, rest[:, None].astype(np.float32)], 1)
        tables = build_graph(data, graph)
        ids = nodes.column("ids")
        return pa.table({
            "shard": pa.array([nodes.column("shard")[0].as_py()], pa.int32()),
            "size": pa.array([n], pa.int32()), "width": pa.array([original.shape[1]], pa.int32()),
            "vectors": pa.array([original.tobytes()], pa.binary()),
            "tables": pa.array([[t.tobytes() for t in tables]], pa.list_(pa.binary())),
            "ids": pa.array([_flat(ids).to_numpy().astype(np.int64).tobytes()], pa.binary()),
            "counts": pa.array([pc.list_value_length(ids).to_numpy().astype(np.int32).tobytes()], pa.binary()),
        })

    return run


def shards_of(vectors: DataFrame, graph: Graph = Graph()) -> int:
    """How many shards the usable vectors need."""
    return graph.shards(vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).count())


def index(vectors: DataFrame, graph: Graph = Graph(), top: int = 20, shards: int | None = None) -> DataFrame:
    """One row per (shard, width of vectors) from `vec_id`, `embedding`. Every usable row is in it."""
    shards = shards or shards_of(vectors, graph)
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("embedding", lambda x: x.cast("float") + F.lit(0.0).cast("float")).alias("vector")
    )
    # Only the smallest ids of equal vectors can be returned: top, and one more for the query itself.
    order = Window.partitionBy("vector").orderBy("vec_id")
    first = good.dropDuplicates(["vector", "vec_id"]).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= top + 1)
    nodes = first.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"),
        F.size("vector").alias("width"), F.xxhash64("vector", F.lit(1)).alias("place"), "vector", "ids",
    )
    return nodes.repartition(shards, "shard").groupBy("shard", "width").applyInArrow(_build(graph), INDEX)


def _search(graph: Graph, top: int):
    def answers(row, ids, queries):
        n, width = row["size"], row["width"]
        original = np.frombuffer(row["vectors"], np.float32).reshape(n, width)
        norm2 = np.einsum("ij,ij->i", original, original, dtype=np.float64)
        rest = np.sqrt(np.maximum(norm2.max() - norm2, 0)).astype(np.float32)
        data = np.concatenate([original, rest[:, None]], 1)
        tables = []
        for level, blob in enumerate(row["tables"]):
            flat = np.frombuffer(blob, np.int32)
            tables.append(flat.reshape(-(-n // graph.links**level), -1))
        member = np.frombuffer(row["ids"], np.int64)
        edge = np.append(0, np.cumsum(np.frombuffer(row["counts"], np.int32)))
        wide = np.concatenate([queries, np.zeros((len(queries), 1), np.float32)], 1)
        found, _ = search_graph(data, tables, graph.links, wide, max(graph.search, 2 * top), graph.seen)
        for q in range(len(queries)):
            near = found[q][found[q] < n]
            score = original[near].astype(np.float64) @ queries[q].astype(np.float64)
            rows = [
                (-s, int(v)) for s, k in zip(score, near) for v in member[edge[k] : edge[k + 1]] if v != ids[q]
            ]
            for s, v in sorted(rows)[:top]:
                yield int(ids[q]), v, -s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: dict[tuple, dict] = {}
        shard = None
        for batch in batches:
            out = []
            waiting: dict[int, list] = {}

            def flush():
                for width, asked in waiting.items():
                    row = current.get(width)
                    if row:
                        ids = np.array([a for a, _ in asked], np.int64)
                        out.extend(answers(row, ids, np.array([v for _, v in asked], np.float32)))
                waiting.clear()

            for row in batch.to_pylist():
                if row["shard"] != shard:
                    flush()
                    current, shard = {}, row["shard"]
                if row["query_id"] is None:
                    flush()
                    current[row["width"]] = row
                else:
                    waiting.setdefault(len(row["query"]), []).append((row["query_id"], row["query"]))
            flush()
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def nearest(vectors: DataFrame, every: int = 20, top: int = 20, graph: Graph = Graph()) -> DataFrame:
    """`query_id, rank, vec_id, score`: the `top` nearest of each row whose id is divisible by `every`.

    Ties go to the smaller vec_id; rows without id or with unusable vectors take no part; repeated
    rows count once. Vectors are compared with those of their own width.
    """
    shards = shards_of(vectors, graph)
    found_index = stored(index(vectors, graph, top, shards), "hnsw-index")
    queries = vectors.where((F.col("vec_id") % every == 0) & usable(F.col("embedding"))).select(
        F.col("vec_id").alias("query_id"), F.transform("embedding", lambda x: x.cast("float")).alias("query")
    ).dropDuplicates(["query_id", "query"])
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query_id", "query")
    whole = found_index.unionByName(asked, allowMissingColumns=True)
    dealt = whole.repartition(shards, "shard").sortWithinPartitions("shard", F.col("query_id").asc_nulls_first())
    best = dealt.mapInArrow(_search(graph, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "query_id", "rank", "vec_id", "score"
    )
