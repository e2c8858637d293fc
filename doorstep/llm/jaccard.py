"""Texts whose word n-gram sets are alike: rare-first prefix join, verified once per pair.

A set is ordered rarest n-gram first. Two sets with Jaccard similarity t share an n-gram among
the first |x| - ceil(t|x|) + 1 of each, so only those prefixes are joined.

1. Frequencies: all n-grams of all texts are counted in a table of fixed size (2**20 counters).
   Any order that is the same for all texts keeps the join exact; the counts make it rare-first.
2. Each text gives its set's identity (equal sets are one node from here on), size, ordered
   prefix, and how many of its n-grams fall into each of 64 ranges of hashes.
3. A prefix n-gram with many sets is not expanded into pairs: one of them is its leader, and a
   set is compared with two of its n-grams' leaders. Linked sets then form components, and a
   second round compares all sets of different components: per n-gram, those outside its
   largest component with all others. A
   pair inside a component can change nothing. So no link between components is lost and a
   group of near copies costs as much as its size.
4. Pairs pass the length filter, the positional filter (what can still be shared after this
   n-gram), and the suffix filter (the ranges' counts bound the intersection). Those left are
   verified on whole sets, which are recomputed from the texts for the sets in question only.

A text with fewer than n words is one n-gram; a text without words, or null, links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.components import components
from doorstep.llm.store import packed, pieces, stored
from doorstep.llm.words import mix, shingle_hashes, split_words

COUNTERS = 1 << 20
BLOCKS = 64
RANGES = 64
SIEVE = 1 << 24


def _sets(piece: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    hashes, edge = shingle_hashes(split_words(piece.column("text")), width)
    for begin, end in zip(edge[:-1], edge[1:]):
        yield np.unique(hashes[begin:end])


def _identity(members: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = mix(members).sum(dtype=np.uint64)
        return int(mix(np.array([total ^ np.uint64(len(members))]))[0].astype(np.int64))


def frequencies(docs: DataFrame, width: int) -> np.ndarray:
    """A rarity class (0 to 255) per counter; the counters' number does not depend on the input."""

    def count(batches):
        total = np.zeros(COUNTERS, np.int64)
        for piece in pieces(batches, "text"):
            hashes, _ = shingle_hashes(split_words(piece.column("text")), width)
            total += np.bincount((hashes & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if total.any():
            blocks = total.reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([b.astype("<u4").tobytes() for b in blocks])],
                names=["block", "counts"],
            )

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(counts, "<u4").astype(np.int64)
                held[block] = held[block] + part if block in held else part
        if held:
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([v.tobytes() for v in held.values()])],
                names=["block", "counts"],
            )

    summed = (
        docs.select("text").mapInArrow(count, "block int, counts binary")
        .repartition("block").mapInArrow(add, "block int, counts binary")
    )
    total = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.int64)
    for row in summed.collect():
        total[row.block] = np.frombuffer(row.counts, np.int64)
    return np.minimum(np.round(6 * np.log2(1 + total.ravel())), 255).astype(np.uint8)


SIGNS = "n int, sid long, prefix array<long>, ranges array<int>"


def _signatures(width: int, num: int, den: int, rarity):
    def run(batches):
        ranks = rarity.value
        for piece in pieces(batches, "text"):
            sizes, sids, prefixes, ranges = [], [], [], []
            for members in _sets(piece, width):
                n = len(members)
                sizes.append(n)
                sids.append(_identity(members) if n else None)
                rank = ranks[(members & np.uint64(COUNTERS - 1)).astype(np.int64)]
                order = np.argsort(rank, kind="stable")
                length = n - (num * n + den - 1) // den + 1 if n else 0
                prefixes.append(members[order[:length]].view(np.int64))
                ranges.append(np.bincount((members >> np.uint64(58)).astype(np.int64), minlength=RANGES))
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            steps = np.arange(0, RANGES * len(sizes) + 1, RANGES, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), piece.column("text_hash"), pa.array(sizes, pa.int32()),
                    pa.array(sids, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefixes))),
                    pa.ListArray.from_arrays(pa.array(steps), pa.array(np.concatenate(ranges).astype(np.int32))),
                ],
                names=["doc_id", "text_hash", "n", "sid", "prefix", "ranges"],
            )

    return run


def _whole_sets(width: int, sieve):
    def run(batches):
        wanted = sieve.value
        for piece in pieces(batches, "text"):
            sids, sets = [], []
            for members in _sets(piece, width):
                if len(members):
                    sid = _identity(members)
                    if wanted[sid & (SIEVE - 1)]:
                        sids.append(sid)
                        sets.append(members.view(np.int64))
            if sids:
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sids), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=["sid", "members"],
                )

    return run


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """`pairs` (x, y) plus `columns` of both ends."""
    for end in ("y", "x"):
        side = table.select(F.col("sid").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
        pairs = pairs.join(side, end)
    return pairs


def _reaches(shared: Column, total: Column, num: int, den: int) -> Column:
    """shared / (total - shared) >= num / den, in whole numbers."""
    return shared.cast("bigint") * (num + den) >= total.cast("bigint") * num


class _Join:
    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.docs, self.width, self.num, self.den = docs, width, num, den
        self.context = docs.sparkSession.sparkContext
        kind = docs.schema["doc_id"].dataType.simpleString()
        rarity = self.context.broadcast(frequencies(docs, width))
        self.signs = stored(
            docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
            .mapInArrow(
                _signatures(width, num, den, rarity), f"doc_id {kind}, text_hash long, {SIGNS}"
            ),
            "ngram-signs",
        )
        self.sketches = (
            self.signs.where("sid IS NOT NULL").groupBy("sid")
            .agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"))
        )

    def shared_grams(self) -> DataFrame:
        """Prefix n-grams that at least two sets have, with their leader.

        The leader is the set in whose order the n-gram comes first, so that the positional
        filter leaves it as many partners as can be.
        """
        grams = self.signs.where("sid IS NOT NULL").select(
            "sid", "n", F.posexplode("prefix").alias("pos", "gram")
        )
        ends = grams.groupBy("gram").agg(
            F.min(F.struct("pos", "sid")).alias("lead"), F.min("sid").alias("least"), F.max("sid").alias("most")
        )
        ends = ends.where("least <> most").select("gram", F.col("lead.sid").alias("lead"))
        return stored(
            grams.join(ends.hint("shuffle_hash"), "gram").dropDuplicates(["gram", "sid"]), "ngram-shared"
        )

    def may_link(self, a: str, b: str) -> Column:
        """Length and positional filter for two prefix entries of one n-gram.

        At the first n-gram two sets share nothing was shared before, so what follows in both
        bounds the intersection there; a pair that is alike passes at that n-gram at least.
        """
        n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
        rest = 1 + F.least(n - F.col(f"{a}.pos") - 1, m - F.col(f"{b}.pos") - 1)
        return (
            (F.least(n, m).cast("bigint") * self.den >= F.greatest(n, m).cast("bigint") * self.num)
            & _reaches(rest, n + m, self.num, self.den)
        )

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (x, y) whose sets are alike, as links a, b."""
        bound = F.aggregate(
            F.zip_with("ranges_x", "ranges_y", lambda a, b: F.least(a, b)), F.lit(0), lambda s, v: s + v
        )
        likely = stored(
            _both(pairs, self.sketches, "n", "ranges")
            .where(_reaches(bound, F.col("n_x") + F.col("n_y"), self.num, self.den)).select("x", "y"),
            "ngram-likely",
        )
        sets = self.docs.select("text").mapInArrow(
            _whole_sets(self.width, self.context.broadcast(self.sieve(likely))), "sid long, members array<long>"
        ).groupBy("sid").agg(F.first("members").alias("members"))
        shared = F.size(F.array_intersect("members_x", "members_y"))
        whole = F.size("members_x") + F.size("members_y")
        return stored(
            _both(likely, sets, "members").where(_reaches(shared, whole, self.num, self.den))
            .select(F.col("x").alias("a"), F.col("y").alias("b")),
            "ngram-links",
        )

    def sieve(self, pairs: DataFrame) -> np.ndarray:
        """A bit per low end of an identity (2 MB whatever the input): which sets are wanted."""
        slot = (F.col("sid").bitwiseAND(F.lit(SIEVE - 1)) + 1).alias("slot")
        maps = (
            pairs.select(F.explode(F.array("x", "y")).alias("sid")).select(slot)
            .groupBy(F.bitmap_bucket_number("slot").alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
        )
        wanted = np.zeros((SIEVE // 32768, 32768), bool)
        for row in maps.collect():
            wanted[row.part - 1] = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little")
        return wanted.ravel()

    def roots(self) -> DataFrame:
        """`node`, `root` of every set that is linked and is not the smallest of its component."""
        shared = self.shared_grams()
        leaders = shared.where("sid = lead").select("gram", "sid", "n", "pos")
        # A set's leaders are many where copies differ in many places. Two of them are enough
        # here: the one met at most n-grams and the smallest. The second round sees to the rest.
        met = (
            shared.alias("p").join(leaders.alias("q"), (F.col("p.gram") == F.col("q.gram")) & self.may_link("p", "q"))
            .where("p.sid <> q.sid").select(F.col("q.sid").alias("x"), F.col("p.sid").alias("y"))
            .groupBy("y", "x").agg(F.count(F.lit(1)).alias("times"))
        )
        first = stored(
            met.groupBy("y").agg(F.max(F.struct("times", "x")).alias("most"), F.min("x").alias("least"))
            .select(F.explode(F.array_distinct(F.array("most.x", "least"))).alias("x"), "y"),
            "ngram-pairs",
        )
        links = self.verified(first)
        roots = components(links)

        placed = shared.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select(
            "gram", "sid", "n", "pos", F.coalesce("root", "sid").alias("part")
        )
        parts = placed.groupBy("gram", "part").agg(F.count(F.lit(1)).alias("k"))
        mixed = (
            parts.groupBy("gram")
            .agg(F.max(F.struct("k", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("gram", F.col("top.part").alias("major"))
        )
        placed = stored(placed.join(mixed, "gram"), "ngram-placed")
        rest = placed.where("part <> major")
        second = (
            rest.alias("p").join(
                placed.alias("q"),
                (F.col("p.gram") == F.col("q.gram")) & (F.col("p.part") != F.col("q.part"))
                & ((F.col("q.part") == F.col("q.major")) | (F.col("p.sid") < F.col("q.sid")))
                & self.may_link("p", "q"),
            )
            .select(F.least("p.sid", "q.sid").alias("x"), F.greatest("p.sid", "q.sid").alias("y")).distinct()
        )
        known = first.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        second = stored(second.join(known, ["x", "y"], "left_anti"), "ngram-pairs")
        if second.isEmpty():
            return roots
        # One link between two components says what any number of them would.
        more = self.verified(second)
        for end in ("a", "b"):
            side = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
            more = more.join(side, end, "left")
        between = more.select(
            F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
        ).distinct()
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(between))


def similar_texts(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n_shingles and component_id.

    Rows link when shared / united n-grams >= num / den. `component_id` is the smallest doc_id
    reachable by links, the row's own included (null where none of them has an id). Equal sets are alike; null ids
    take part like any other. Other columns are ignored.
    """
    join = _Join(docs, width, num, den)
    roots = join.roots()
    placed = join.signs.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").select(
        "doc_id", "text_hash", F.col("n").cast("bigint").alias("n_shingles"),
        F.coalesce("root", "sid").alias("part"),
    )
    smallest = placed.where("part IS NOT NULL").groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "part", "left").select(
        "doc_id", "text_hash", "n_shingles",
        F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.col("part"),
    )


def one_of_each(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row of each component, its smallest by (doc_id, hash of text), nulls last.

    Rows without words stand alone and all stay. Columns are those of `docs`.
    """
    found = similar_texts(docs, width, num, den)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    chosen = found.where("part IS NOT NULL").groupBy("part").agg(F.min(order).alias("least")).select(
        F.col("least.doc_id").alias("chosen_id"), F.col("least.text_hash").alias("chosen_hash")
    )
    text = F.coalesce("text", F.lit(""))
    rows = packed(docs, own_id=F.col("doc_id"), own_hash=F.xxhash64(text), words=text.rlike(r"[^\x20\x09-\x0D]"))
    same = F.col("own_id").eqNullSafe(F.col("chosen_id")) & (F.col("own_hash") == F.col("chosen_hash"))
    kept = rows.where("words").join(chosen, same, "left_semi").dropDuplicates(["own_id", "own_hash"])
    return kept.unionByName(rows.where("NOT words")).select("row.*")
