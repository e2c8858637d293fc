"""A Merkle manifest of a table: per group a tree of its rows in order of id, and a tree over the groups.

1. Ids become bitmaps. An id's high bits name its chunk of 2**16 ids, its low bits a place in
   it. Every task compresses the places it sees of a (group, chunk) into a container, a list
   of 16-bit numbers or a bitmap, whichever is smaller, with the repeats beside it; the
   containers of a chunk are merged by OR. A container holds at most 65,536 places.
2. Popcount directories say how many rows of the group lie before a chunk. They have a level per
   twelve bits of the chunk's number, so that no sum runs over more than 4,097 entries however
   many chunks a group has.
3. Rank queries: ids meet their container, and directory plus popcount below the id's place is
   its position among the group's leaves. Ids are not sorted, and a group with most rows is as
   many chunks as its ids ask for. Null ids are one place before all others. Only rows that
   share an id are put in order, by leaf, among themselves.
4. Positions are keys: sixteen neighbours meet under (group, position / 16) as an array of slots,
   whose hash is the node above. Levels go on until every group has one node.
5. From the top down, each run is given the siblings above it; in its run a leaf's proof is
   hashed, and its root is folded from its own digest.

Order of leaves: null ids first, then ids; equal ids by leaf. Equal rows are leaves side by side.
Ids that lie so far apart that a chunk holds one of them cost a container each.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.llm.store import stored
from doorstep.operators.ordering import running_totals

WIDE_BITS = 4
CHUNK_BITS, LEVEL_BITS, LEVELS = 16, 12, 4
PLACES = 1 << CHUNK_BITS
#: The chunk of null ids, before those of all numbers.
NULLS = -(1 << 47) - 1
#: Rows a task holds before it gives out their containers.
HELD = 1 << 18
#: Equal rows that are laid out at once.
BLOCK = 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """`-` for null, else byte count, colon and the value's text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    )


def leaf_of(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


# ---- compressed bitmaps


def packed_places(places: np.ndarray) -> bytes:
    """Sorted distinct places as 16-bit numbers, or as a bitmap where that is smaller."""
    if 2 * len(places) < PLACES // 8:
        return places.astype("<u2").tobytes()
    bits = np.zeros(PLACES, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def places_of(container: bytes) -> np.ndarray:
    if len(container) < PLACES // 8:
        return np.frombuffer(container, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))


def rows_of(containers: Sequence[bytes], repeats: Sequence[bytes]) -> np.ndarray:
    """Rows at each place of several containers."""
    rows = np.zeros(PLACES, np.int64)
    for container, again in zip(containers, repeats):
        rows[places_of(container)] += 1
        more = np.frombuffer(again, "<i8").reshape(-1, 2)
        rows[more[:, 0]] += more[:, 1]
    return rows


def container_of(places: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    """A container and its repeats: (place, rows above one)."""
    again = rows > 1
    return packed_places(places), np.stack([places[again], rows[again] - 1], axis=1).astype("<i8").tobytes()


CONTAINER = "grp string, chunk long, n long, places binary, repeats binary"


def _task_containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One container per (group, chunk) of HELD rows."""

    def given(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        coded = table.column("grp").combine_chunks().dictionary_encode()
        group, chunk, place, n = (
            np.asarray(c) for c in (coded.indices, table.column("chunk"), table.column("place"), table.column("n"))
        )
        order = np.lexsort((place, chunk, group))
        group, chunk, place, n = group[order], chunk[order], place[order], n[order]
        new = np.flatnonzero((np.diff(group) != 0) | (np.diff(chunk) != 0)) + 1
        out = []
        for begin, end in zip(np.append(0, new), np.append(new, len(n))):
            places, at = np.unique(place[begin:end], return_index=True)
            rows = np.add.reduceat(n[begin:end], at)
            out.append((int(group[begin]), int(chunk[begin]), int(rows.sum()), *container_of(places, rows)))
        codes, *rest = zip(*out)
        return pa.RecordBatch.from_arrays(
            [coded.dictionary.take(pa.array(codes, pa.int32())), *map(pa.array, rest)],
            names=["grp", "chunk", "n", "places", "repeats"],
        )

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= HELD:
            yield given(held)
            held, rows = [], 0
    if held:
        yield given(held)


def _merge(table: pa.Table) -> pa.Table:
    """The containers of one chunk as one."""
    rows = rows_of(table.column("places").to_pylist(), table.column("repeats").to_pylist())
    places = np.flatnonzero(rows)
    bits, repeats = container_of(places, rows[places])
    first = table.slice(0, 1)
    return pa.table({
        "grp": first.column("grp"), "chunk": first.column("chunk"), "n": pa.array([int(rows.sum())]),
        "places": pa.array([bits], pa.binary()), "repeats": pa.array([repeats], pa.binary()),
    })


def bitmaps(ids: DataFrame) -> DataFrame:
    """One container per group and chunk of `grp, chunk, place, n`."""
    partial = ids.select("grp", "chunk", "place", "n").mapInArrow(_task_containers, CONTAINER)
    return partial.groupBy("grp", "chunk").applyInArrow(_merge, CONTAINER)


def directory(chunks: DataFrame) -> DataFrame:
    """`chunks` plus `before`, the rows of the group in smaller chunks, and `size`, those in all.

    One level per LEVEL_BITS of the chunk's number. At each, the entries of one parent are summed up
    in order; a chunk's `before` is the sum over its ancestors.
    """
    out = chunks.withColumn("before", F.lit(0).cast("bigint"))
    nodes = chunks.select("grp", F.col("chunk").alias("node"), "n")
    for level in range(LEVELS):
        parent = F.shiftright("node", LEVEL_BITS) if level < LEVELS - 1 else F.lit(0).cast("bigint")
        up = Window.partitionBy("grp", parent).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        sums = nodes.select("grp", "node", F.coalesce(F.sum("n").over(up), F.lit(0)).alias("under"))
        out = (
            out.withColumn("node", F.shiftright("chunk", LEVEL_BITS * level)).join(sums, ["grp", "node"])
            .withColumn("before", F.col("before") + F.col("under")).drop("node", "under")
        )
        nodes = nodes.groupBy("grp", parent.alias("node")).agg(F.sum("n").alias("n"))
    return out.join(nodes.select("grp", F.col("n").alias("size")), "grp")


def _ranked(ids: pa.Table, index: pa.Table) -> pa.Table:
    """Rank queries against one container."""
    below = size = np.zeros(0, np.int64)
    if ids.num_rows:
        rows = rows_of(index.column("places").to_pylist(), index.column("repeats").to_pylist())
        places = ids.column("place").to_numpy()
        below = index.column("before")[0].as_py() + (np.cumsum(rows) - rows)[places]
        size = np.full(ids.num_rows, index.column("size")[0].as_py())
    return ids.drop_columns(["chunk", "place"]).append_column("pos", pa.array(below, pa.int64())).append_column(
        "size", pa.array(size, pa.int64())
    )


def ranked(ids: DataFrame) -> DataFrame:
    """Stored `ids` (grp, chunk, place, n and others) with `pos`, the rows of smaller ids in the
    group, and `size`, its rows; chunk and place go. No two ids share group, chunk and place, so a
    chunk is at most 65,536 rows."""
    index = directory(stored(bitmaps(ids), "manifest-bitmaps"))
    kinds = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in ids.schema.fields if f.name not in ("chunk", "place")
    )
    return ids.groupBy("grp", "chunk").cogroup(index.groupBy("grp", "chunk")).applyInArrow(
        _ranked, f"{kinds}, pos long, size long"
    )


# ---- leaves in their places


def _laid_out(rows: DataFrame) -> DataFrame:
    """A row that stands for `n` equal ones as `n` rows in positions from `pos` on."""
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(BLOCK).cast("bigint")))
    many = rows.where(F.col("n") > BLOCK).withColumn("block", blocks).repartition("grp", "pos", "block")
    cut = many.union(rows.where(F.col("n") <= BLOCK).withColumn("block", F.lit(0).cast("bigint")))
    last = F.least(F.col("n") - F.col("block"), F.lit(BLOCK).cast("bigint")) - 1
    turn = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("turn")
    return cut.select("*", turn).withColumn("pos", F.col("pos") + F.col("block") + F.col("turn")).drop(
        "n", "block", "turn"
    )


def positions(leaves: DataFrame) -> DataFrame:
    """Stored `leaves` (grp, doc_id, leaf, other), each with `pos` in its group and `size` of that."""
    one = leaves.groupBy("grp", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("leaf").alias("leaf"), F.max("leaf").alias("last"),
        F.min("other").alias("other"),
    )
    number = F.col("doc_id").cast("bigint")
    ids = stored(
        one.select(
            "grp", F.coalesce(F.shiftright(number, CHUNK_BITS), F.lit(NULLS)).alias("chunk"),
            F.coalesce(number.bitwiseAND(F.lit(PLACES - 1)), F.lit(0)).cast("int").alias("place"),
            "doc_id", "n", "leaf", "other", (F.col("leaf") != F.col("last")).alias("mixed"),
        ),
        "manifest-ids",
    )
    found = stored(ranked(ids), "manifest-ranks")
    out = _laid_out(found.where("NOT mixed").drop("mixed"))
    mixed = found.where("mixed").select("grp", F.col("doc_id").alias("id"), "pos", "size")
    if mixed.isEmpty():
        return out
    # Different rows share these ids: among themselves they go by leaf.
    alike = (
        leaves.join(mixed.withColumnRenamed("grp", "in"), (F.col("grp") == F.col("in")) & F.col("doc_id").eqNullSafe(F.col("id")))
        .groupBy("grp", "doc_id", "leaf", "other", "pos", "size").agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = running_totals(alike, ["grp", "doc_id"], [F.col("leaf")], {"upto": F.col("n")})
    ordered = ordered.withColumn("pos", F.col("pos") + F.col("upto") - F.col("n")).drop("upto")
    return out.unionByName(_laid_out(ordered))


# ---- trees


def _above(size: Column, level: int) -> Column:
    """Nodes at a level over `size` leaves."""
    wide = WIDE_BITS * level
    return F.shiftright(size + ((1 << wide) - 1), wide)


def _runs(nodes: DataFrame, payload: Sequence[str] = ()) -> DataFrame:
    """Sixteen neighbours each of `grp, pos, size, hash` as slot arrays, with the hash above them."""
    slot = F.struct(F.col("pos").bitwiseAND(F.lit((1 << WIDE_BITS) - 1)).cast("int").alias("slot"), "hash", *payload)
    runs = nodes.groupBy("grp", F.shiftright("pos", WIDE_BITS).alias("pos")).agg(
        F.sort_array(F.collect_list(slot)).alias("slots"), F.first("size").alias("size")
    )
    return stored(runs.withColumn("hash", F.sha2(F.array_join("slots.hash", ""), 256)), "manifest-runs")


class Trees:
    """The trees over `leaves` (grp, pos, size, hash and payload): runs by level, and tops."""

    def __init__(self, leaves: DataFrame, payload: Sequence[str] = ()):
        self.payload = payload
        self.lone = leaves.where("size = 1")
        self.levels: list[DataFrame] = []
        most = leaves.agg(F.max("size")).first()[0] or 0
        nodes, columns = leaves.where("size > 1"), payload
        while most > 1:
            runs = _runs(nodes, columns)
            self.levels.append(runs)
            most = -(-most >> WIDE_BITS) if most % 16 == 0 else (most >> WIDE_BITS) + 1
            level = len(self.levels)
            nodes = runs.where(_above(F.col("size"), level) > 1).select("grp", "pos", "size", "hash")
            columns = ()

    def tops(self) -> DataFrame:
        """`grp`, `hash`, `height` of every tree's last node."""
        tops = self.lone.select("grp", "hash", F.lit(0).alias("height"))
        for level, runs in enumerate(self.levels, 1):
            done = runs.where((_above(F.col("size"), level) == 1))
            tops = tops.union(done.select("grp", "hash", F.lit(level).alias("height")))
        return tops

    def paths(self, over: DataFrame) -> DataFrame:
        """Per leaf `grp`, payload, `hash`, `steps` and the columns of `over`.

        A step is what stands left and right of the leaf's node in its run, level by level; `over` has
        one row per tree: grp, height, `steps` above the tree and columns to carry.
        """
        carried = [c for c in over.columns if c not in ("grp", "height", "steps")]
        path = None
        for level in range(len(self.levels), 0, -1):
            tops = over.where(F.col("height") == level).select("grp", F.lit(0).cast("bigint").alias("pos"), "steps", *carried)
            path = tops if path is None else path.unionByName(tops)
            runs = self.levels[level - 1].select("grp", "pos", "slots").join(path, ["grp", "pos"])
            columns = self.payload if level == 1 else ()
            runs = runs.select("*", F.col("slots.hash").alias("hashes"), F.posexplode("slots").alias("at", "own"))
            left = F.array_join(F.slice("hashes", F.lit(1), F.col("at")), "")
            right = F.array_join(F.slice("hashes", F.col("at") + 2, F.lit(1 << WIDE_BITS)), "")
            step = F.struct(left.alias("left"), right.alias("right"))
            path = runs.select(
                "grp", (F.shiftleft("pos", WIDE_BITS) + F.col("at")).alias("pos"),
                F.concat(F.array(step), "steps").alias("steps"), *carried,
                *([F.col("own.hash").alias("hash"), *[F.col(f"own.{c}").alias(c) for c in columns]] if level == 1 else []),
            )
        out = ["grp", "steps", *carried, "hash", *self.payload]
        alone = self.lone.select("grp", "hash", *self.payload).join(over.where("height = 0").drop("height"), "grp")
        return alone.select(*out) if path is None else path.select(*out).union(alone.select(*out))


STEPS = "array<struct<left:string,right:string>>"


def folded(own: Column, steps: Column) -> Column:
    """The root that follows from a digest and the siblings beside its path."""
    return F.aggregate(steps, own, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, ident: str = "doc_id", group: str = "source",
    changed: Mapping[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """Per row of `docs`: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    A leaf is the hash of `fields`; leaves of one `group` make a tree in order of `ident`, the
    groups' roots, null first and then bytewise, make the tree of the table. `changed` replaces fields
    in the rows that `where` names, after the manifest was made: what those rows fold to is not the
    root if a byte of them differs. `proof_sha256` is the hash of the leaf's siblings up to the root;
    of the empty string where it has none. An empty table gives no rows; other columns are ignored.
    """
    own = [F.col(f"`{f}`") for f in fields]
    later = [(changed or {}).get(f, c) for f, c in zip(fields, own)]
    leaf = leaf_of(own)
    other = F.when(where, leaf_of(later)) if where is not None else F.lit(None).cast("string")
    source = F.col(f"`{group}`").cast("string")
    leaves = stored(
        docs.select(
            # Null before all other groups, and never a null key.
            F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("grp"),
            F.col(f"`{ident}`").alias("doc_id"), leaf.alias("leaf"), other.alias("other"),
        ),
        "manifest-leaves",
    )
    placed = positions(leaves).select("grp", "pos", "size", F.col("leaf").alias("hash"), "doc_id", "other")
    trees = Trees(stored(placed, "manifest-placed"), ("doc_id", "other"))
    tops = stored(trees.tops(), "manifest-tops")
    groups = tops.count()
    order = running_totals(tops, [], [F.col("grp")], {"upto": F.lit(1).cast("bigint")})
    upper = Trees(
        order.select(
            F.lit("").alias("grp"), (F.col("upto") - 1).alias("pos"), F.lit(groups).cast("bigint").alias("size"),
            "hash", F.col("grp").alias("name"), "height",
        ),
        ("name", "height"),
    )
    root = upper.tops().select(
        "grp", "height", F.array().cast(STEPS).alias("steps"), F.col("hash").alias("root")
    )
    over = stored(
        upper.paths(root).select(
            F.col("name").alias("grp"), "height", "steps", F.col("hash").alias("subroot"), "root"
        ),
        "manifest-over",
    )
    proof = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    rows = trees.paths(over)
    fold = folded(F.coalesce("other", "hash"), F.col("steps"))
    return rows.select(
        "doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"),
        fold.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
