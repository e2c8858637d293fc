"""Near-duplicate texts by min-max hashing.

1. A text's set is its distinct n-word shingles. Every permutation (a hash of the shingle's hash)
   is evaluated once and gives two signature values, its smallest and its greatest over the set.
   Either is equal for two sets with odds of their similarity, so 100 evaluations give 200
   values; a minimum and a maximum of one permutation hang together less than two draws from
   one would, which lowers the variance.
2. Five values make a band, 40 bands a signature: minima of neighbouring permutations, and maxima of
   permutations far apart, so that no two bands share more than one permutation. Two sets of
   similarity 0.8 miss each other in all bands with odds of (1 - 0.8**5)**40, 1.3e-7.
3. Equal sets are one node. In a bucket (a band's value) the sets are not paired off: one of
   them, drawn anew in every bucket, leads, and a set is compared with the two nearest of its
   leaders by parity (4). Confirmed links make components. Once more, sets outside their buckets'
   largest component meet leaders from it and from others. A last round compares all sets of a
   bucket that are still in different components: those outside the largest with all others. A
   pair inside a component can change nothing, so no link is lost, and a group of near copies
   costs as much as its size and its stragglers.
4. Before that, and before any set is moved, a pair must agree in enough of 200 signature bits: at
   similarity 0.8 a tenth of them differs on average, more than `bits_apart` with odds under 1e-8.
   And it must pass the sets' parity maps (an odd sketch: 1,024 bits, each flipped by every member
   that falls on it), whose difference is a lower bound of the sets' own, so the test is exact.
5. Pairs left are confirmed on whole sets, recomputed from the texts for the sets in question.

A text with fewer than n words is one shingle; a text without words, or null, links with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doorstep.llm.components import components
from doorstep.llm.spread import attach
from doorstep.llm.store import pieces, stored
from doorstep.llm.words import mix, shingle_hashes, split_words

PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
SKETCH = 4
#: Numbers of 64 bits in a set's parity map.
PARITY = 16
#: Leaders a set is compared with in a turn, and turns before all pairs left are compared.
NEAREST, TURNS = 2, 1
#: Slots of the table of wanted sets: at least 16 per set, within these bounds (8 KB, 32 MB).
SIEVE = (1 << 16, 1 << 28)

_SEEDS = mix(np.arange(2 * PERMUTATIONS, dtype=np.uint64) + np.uint64(0x6D696E6D6178))
_ODD = (_SEEDS[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MORE = (_SEEDS[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def set_members(piece: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text end to end, and where each text's begin."""
    hashes, edge = shingle_hashes(split_words(piece.column("text")), width)
    sets = [np.unique(hashes[a:b]) for a, b in zip(edge[:-1], edge[1:])]
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.cumsum([0, *map(len, sets)])


def identities(members: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """64 bits that equal sets share, whatever their texts."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(members), dtype=np.uint64)])
    return mix((total[edge[1:]] - total[edge[:-1]]) ^ np.diff(edge).astype(np.uint64)).view(np.int64)


def min_max(members: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of every permutation over each of the sets, none of them empty."""
    base = (members >> np.uint64(32)).astype(np.uint32)
    low = np.empty((PERMUTATIONS, len(edge) - 1), np.uint32)
    high = np.empty_like(low)
    begins = edge[:-1]
    for k in range(PERMUTATIONS):
        value = base * _ODD[k]
        value ^= value >> np.uint32(15)
        value *= _MORE[k]
        low[k] = np.minimum.reduceat(value, begins)
        high[k] = np.maximum.reduceat(value, begins)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit bucket per set (rows) and band (columns)."""
    half = BANDS // 2
    near = np.arange(PERMUTATIONS).reshape(half, ROWS)
    far = np.arange(PERMUTATIONS).reshape(ROWS, half).T
    out = np.empty((low.shape[1], BANDS), np.uint64)
    for band in range(BANDS):
        values, rows = (low, near[band]) if band < half else (high, far[band - half])
        key = np.full(low.shape[1], band, np.uint64)
        for row in rows:
            key = mix(key ^ values[row].astype(np.uint64))
        out[:, band] = key
    return out


def parities(members: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Per set 64 * PARITY bits: whether an odd number of its members falls on each."""
    bits = 64 * PARITY
    place = np.repeat(np.arange(len(edge) - 1) * bits, np.diff(edge)) + (members & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=bits * (len(edge) - 1)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, bits), axis=1).view("<u8")


def sketches(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bit of each signature value, in four 64-bit numbers per set."""
    bits = np.zeros((low.shape[1], 64 * SKETCH), np.uint8)
    bits[:, :PERMUTATIONS] = (low.T >> np.uint32(3)) & np.uint32(1)
    bits[:, PERMUTATIONS : 2 * PERMUTATIONS] = (high.T >> np.uint32(3)) & np.uint32(1)
    return np.packbits(bits, axis=1).view("<u8")


SIGNS = "n int, sid long, sketch array<long>, parity array<long>, bands array<long>"


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix of 64-bit numbers as lists."""
    rows, wide = values.shape
    ends = np.arange(0, rows * wide + 1, wide, dtype=np.int32) if wide else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).view(np.int64).ravel()))


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            members, edge = set_members(piece, width)
            sizes = np.diff(edge)
            some = np.flatnonzero(sizes)
            sketch = np.zeros((len(sizes), SKETCH), np.uint64)
            buckets = np.zeros((len(sizes), BANDS), np.uint64)
            if len(some):
                low, high = min_max(members, np.append(edge[some], edge[-1]))
                sketch[some], buckets[some] = sketches(low, high), bands(low, high)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(sizes.astype(np.int32)),
                    pa.array(identities(members, edge), mask=sizes == 0), _lists(sketch),
                    _lists(parities(members, edge)), _lists(buckets),
                ],
                names=["doc_id", "n", "sid", "sketch", "parity", "bands"],
            )

    return run


def _whole_sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = wanted.value
        for piece in pieces(batches, "text"):
            members, edge = set_members(piece, width)
            sids = identities(members, edge)
            take = np.flatnonzero((np.diff(edge) > 0) & slots[sids & (len(slots) - 1)])
            if len(take):
                sets = [members[edge[i] : edge[i + 1]].view(np.int64) for i in take]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids[take]), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=["sid", "members"],
                )

    return run


def _alike(shared: Column, sizes: Column, num: int, den: int) -> Column:
    """shared / (sizes - shared) >= num / den, in whole numbers."""
    return shared.cast("bigint") * (num + den) >= sizes.cast("bigint") * num


def _apart(name: str, size: int, a: str, b: str) -> Column:
    """How many bits of two entries' maps differ."""
    each = [F.bit_count(F.col(f"{a}.{name}")[k].bitwiseXOR(F.col(f"{b}.{name}")[k])) for k in range(size)]
    return reduce(lambda x, y: x + y, each)


def _may_be_alike(a: str, b: str, num: int, den: int) -> Column:
    """Sizes, sketches and parities of two entries leave the similarity possible.

    Every bit in which parities differ is the place of a member that only one set has, so they
    bound what the sets do not share: nothing alike is lost by them.
    """
    n, m = F.col(f"{a}.n").cast("bigint"), F.col(f"{b}.n").cast("bigint")
    return (
        (F.least(n, m) * den >= F.greatest(n, m) * num)
        & (_apart("sketch", SKETCH, a, b) <= bits_apart(num, den))
        & (_apart("parity", PARITY, a, b) * (num + den) <= (n + m) * (den - num))
    )


def bits_apart(num: int, den: int) -> int:
    """The least number of differing bits that two sets just alike exceed with odds under 1e-8."""
    p, n = (1 - num / den) / 2, 2 * PERMUTATIONS
    over, k = 1.0, -1
    while over > 1e-8:
        k += 1
        over = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1, n + 1))
    return k


class _Search:
    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs.select("doc_id", "text"), width, num, den
        self.context = docs.sparkSession.sparkContext
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.signs = stored(
            self.docs.mapInArrow(_signatures(width), f"doc_id {kind}, {SIGNS}"), "minmax-signs"
        )
        self.sets = stored(
            self.signs.where("sid IS NOT NULL").groupBy("sid").agg(
                F.min("doc_id").alias("least_id"), F.first("n").alias("n"),
                F.first("sketch").alias("sketch"), F.first("parity").alias("parity"), F.first("bands").alias("bands"),
            ),
            "minmax-sets",
        )

    def shared_buckets(self) -> DataFrame:
        """`bucket`, `sid`, `lead` of the buckets that at least two sets are in."""
        entries = self.sets.select("sid", F.explode("bands").alias("bucket"))
        first = F.struct(F.xxhash64("sid", "bucket").alias("h"), "sid")
        ends = entries.groupBy("bucket").agg(
            F.min(first).alias("lead"), F.min("sid").alias("least"), F.max("sid").alias("most")
        ).where("least <> most").select("bucket", F.col("lead.sid").alias("lead"))
        return stored(attach(entries, ends, "bucket", "inner"), "minmax-shared")

    def nearest(self, pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Of each `y` the NEAREST pairs (x, y) whose sizes and sketches leave them alike, stored."""
        for end in ("y", "x"):
            side = self.sets.select(F.col("sid").alias(end), F.struct("n", "sketch", "parity").alias(f"s{end}"))
            pairs = attach(stored(pairs, "minmax-met"), side, end, "inner")
        order = Window.partitionBy("y").orderBy("apart", "x")
        near = pairs.where(_may_be_alike("sx", "sy", self.num, self.den)).select(
            "x", "y", _apart("parity", PARITY, "sx", "sy").alias("apart")
        )
        if known is not None:
            near = near.join(known, ["x", "y"], "left_anti")
        return stored(
            near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEAREST).select("x", "y"),
            "minmax-pairs",
        )

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored pairs (x, y) whose whole sets are alike, as links a, b."""
        kept = self.context.broadcast(self.wanted(pairs))
        sets = self.docs.select("text").mapInArrow(
            _whole_sets(self.width, kept), "sid long, members array<long>"
        ).groupBy("sid").agg(F.first("members").alias("members"))
        for end in ("y", "x"):
            side = sets.select(F.col("sid").alias(end), F.col("members").alias(f"m{end}"))
            pairs = pairs.join(side, end)
        shared = F.size(F.array_intersect("mx", "my"))
        alike = _alike(shared, F.size("mx") + F.size("my"), self.num, self.den)
        return stored(pairs.where(alike).select(F.col("x").alias("a"), F.col("y").alias("b")), "minmax-links")

    def wanted(self, pairs: DataFrame) -> np.ndarray:
        """One slot per low end of an identity: which sets are wanted. Others may fall into a slot."""
        size = min(max(1 << (32 * pairs.count()).bit_length(), SIEVE[0]), SIEVE[1])
        slot = (F.col("sid").bitwiseAND(F.lit(size - 1)) + 1).alias("slot")
        maps = (
            pairs.select(F.explode(F.array("x", "y")).alias("sid")).select(slot)
            .groupBy(F.bitmap_bucket_number("slot").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        )
        out = np.zeros((size // 32768, 32768), bool)
        for row in maps.collect():
            out[row.part - 1] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        return out.ravel()

    def placed(self, shared: DataFrame, roots: DataFrame) -> DataFrame:
        """Entries of the buckets that still hold several components: `bucket`, `sid`, `part`, `major`."""
        parts = roots.select(F.col("node").alias("sid"), "root")
        entries = attach(shared, parts, "sid").select("bucket", "sid", F.coalesce("root", "sid").alias("part"))
        sizes = entries.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("k"))
        mixed = (
            sizes.groupBy("bucket")
            .agg(F.max(F.struct("k", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("bucket", F.col("top.part").alias("major"))
        )
        return stored(entries.join(mixed, "bucket"), "minmax-placed")

    def more_leaders(self, placed: DataFrame, turn: int) -> DataFrame:
        """Sets outside their buckets' largest component, with a leader from it and one from another."""
        draw = F.struct(F.xxhash64("sid", "bucket", F.lit(turn)).alias("h"), "sid", "part")
        leads = placed.groupBy("bucket").agg(
            F.min(F.when(F.col("part") == F.col("major"), draw)).alias("inside"),
            F.min(F.when(F.col("part") != F.col("major"), draw)).alias("outside"),
        )
        rest = placed.where("part <> major").select("bucket", F.col("sid").alias("y"), F.col("part").alias("own"))
        return (
            attach(rest, leads, "bucket", "inner")
            .select("y", "own", F.explode(F.array("inside", "outside")).alias("lead"))
            .where("lead.part <> own").select(F.col("lead.sid").alias("x"), "y").distinct()
        )

    def across(self, placed: DataFrame) -> DataFrame:
        """All pairs of one bucket and two components that sizes and sketches leave alike."""
        rows = placed.join(self.sets.select("sid", "n", "sketch", "parity"), "sid")
        p, q = rows.where("part <> major").alias("p"), rows.alias("q")
        return p.join(
            q,
            (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.part") != F.col("q.part"))
            & ((F.col("q.part") == F.col("q.major")) | (F.col("p.sid") < F.col("q.sid")))
            & _may_be_alike("p", "q", self.num, self.den),
        ).select(F.least("p.sid", "q.sid").alias("x"), F.greatest("p.sid", "q.sid").alias("y")).distinct()

    def joined(self, roots: DataFrame, links: DataFrame) -> DataFrame:
        """Roots after further links; one link between two components says what any number would."""
        for end in ("a", "b"):
            side = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            links = links.join(side, end, "left")
        between = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).distinct()
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(between))

    def roots(self) -> DataFrame:
        """`node`, `root` of every set that is linked and is not the smallest of its component."""
        shared = self.shared_buckets()
        met = shared.where("sid <> lead").select(F.col("lead").alias("x"), F.col("sid").alias("y")).distinct()
        known = self.nearest(met)
        roots = components(self.confirmed(known))
        shared = shared.select("bucket", "sid")
        for turn in range(1, TURNS + 1):
            pairs = self.nearest(self.more_leaders(self.placed(shared, roots), turn), known)
            if pairs.isEmpty():
                break
            known = known.union(pairs)
            roots = self.joined(roots, self.confirmed(pairs))
        tried = known.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        last = stored(self.across(self.placed(shared, roots)).join(tried, ["x", "y"], "left_anti"), "minmax-pairs")
        return roots if last.isEmpty() else self.joined(roots, self.confirmed(last))


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id and kept.

    Rows link when shared / united shingles >= num / den. `component_id` is the smallest doc_id
    reachable by links, the row's own included; null ids take part, but are not the smallest while
    there is another. `kept` says that the row's id is that one (null equals null). Rows without words
    are components of their own and kept; equal rows get equal answers. An empty table gives no
    rows. Other columns are ignored.
    """
    search = _Search(docs, width, num, den)
    parts = search.roots().select(F.col("node").alias("sid"), "root")
    placed = stored(
        search.sets.select("sid", "least_id").join(parts, "sid", "left")
        .select("sid", "least_id", F.coalesce("root", "sid").alias("part")),
        "minmax-parts",
    )
    smallest = placed.groupBy("part").agg(F.min("least_id").alias("component_id"))
    answers = attach(placed.select("sid", "part"), smallest, "part").select("sid", "component_id")
    rows = attach(search.signs.select("doc_id", "n", "sid"), answers, "sid")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )
