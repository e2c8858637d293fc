"""Language model scoring by a hashed maximum-entropy model with class-factored softmax.

1. Words of all training texts are counted (one aggregate). The most frequent, at most `words`,
   are known to every task: a histogram of the counts gives the least count that keeps the bound.
   Rarer words are met by a join on the cell of their hash.
2. The most frequent words have a class and a place in it by rank; rarer ones fall into bands by
   rank. In a band a word's hash digits choose class after class, as many levels as leave about
   eight to some hundred words in a cell, so the classes grow with the vocabulary. Inside a cell
   the counts' own distribution holds. p(word) is the product of the softmaxes on the way.
   Contexts give hashed features of the words' own hashes: the word before, the two before, and
   the one before that alone (a skip); in bands the word before. Rows of the weight tables follow
   the number of distinct words, between `buckets` and `most_buckets`.
3. Weights start at zero over the counts' distribution. Training texts are split into rounds by
   a hash of doc_id. In a round every task takes gradient steps on its texts from the same
   weights; each row's steps are averaged by how often the tasks met it, so that a context that
   few tasks meet is not thinned out by the others. Every training text is used once.
4. Scoring looks weights up for batches of tokens in numpy. Rare words' counts are joined in.

Words' identity is a 64-bit hash. Null texts are empty and have the end token only. Words of
equal count at the bound are all beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.store import pieces, stored
from doorstep.llm.words import mix, split_words

END = np.uint64(0x1D8AF066E8C1B2D7)
BLOCKS = 64
#: Tokens scored at a time: their rows stay in a core's cache.
CACHED = 1 << 12
LN10 = float(np.log(10))


@dataclass(frozen=True)
class Shape:
    words: int = 1 << 18  # most words with counts in every task
    classes: int = 32
    per_class: int = 32  # a power of two
    bands: tuple[int, ...] = (8192, 65536)  # ranks where bands of rarer words end
    cell: int = 8  # words that a band's cell holds at least, on average
    buckets: int = 1 << 12  # rows of each weight table, at least
    most_buckets: int = 1 << 15  # and at most: every task holds the tables
    rounds: int = 3
    rate: float = 0.3
    batch: int = 1 << 14

    @property
    def modelled(self) -> int:
        return self.classes * self.per_class

    @property
    def groups(self) -> int:
        """Classes and bands: between the edges, up to `words`, and beyond."""
        return self.classes + len(self.bands) + 2

    @property
    def bits(self) -> int:
        return self.per_class.bit_length() - 1

    def depth(self, members: int) -> int:
        """Levels of classes below a band of so many words."""
        depth = 0
        while self.cell * self.per_class ** (depth + 1) <= members:
            depth += 1
        return depth

    def rows(self, distinct: int) -> int:
        """Rows of each weight table: a sixteenth of the distinct words, as a power of two."""
        return min(max(1 << (max(distinct, 1) // 16).bit_length(), self.buckets), self.most_buckets)


@dataclass(frozen=True)
class Counts:
    """What the corpus counts give every task: at most `Shape.words` entries."""

    shape: Shape
    tokens: int
    distinct: int
    least: int  # known words have this count or more
    hashes: np.ndarray = field(repr=False)  # sorted
    ranks: np.ndarray = field(repr=False)  # of `hashes`
    seen: np.ndarray = field(repr=False)  # count by rank
    group: np.ndarray = field(repr=False)  # by rank, one more entry for the rest
    group_log: np.ndarray = field(repr=False)  # log share of each group
    place_log: np.ndarray = field(repr=False)  # classes x places, log share inside the class
    depth: np.ndarray = field(repr=False)  # levels of hash digits by group
    prior: np.ndarray = field(repr=False)  # log shares of a band's digits, row by row
    prior_at: np.ndarray = field(repr=False)  # first row by group and level; -1: even shares
    inside_log: np.ndarray = field(repr=False)  # by rank, log share inside a cell

    @property
    def buckets(self) -> int:
        return self.shape.rows(self.distinct)


def _packed(counts: Counts) -> dict:
    """Plain values to send to tasks that have no copy of this package."""
    return {**vars(counts), "shape": vars(counts.shape)}


def _unpacked(values: dict) -> Counts:
    return Counts(**{**values, "shape": Shape(**values["shape"])})


def is_training(parts: int = 5, held_out: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts != held_out, F.lit(True))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words, times = np.unique(split_words(piece.column("text")).hashes, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(words, END).view(np.int64)), pa.array(np.append(times, piece.num_rows))],
            names=["word", "n"],
        )


def word_counts(docs: DataFrame) -> DataFrame:
    """`word` (hash), `n` of all tokens of the training texts, ends included."""
    counted = docs.where(is_training()).select("text").mapInArrow(_count, "word long, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


def known_counts(counts: DataFrame, shape: Shape = Shape()) -> Counts:
    steps = counts.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.min("n").alias("least")
    )
    steps = sorted(steps.collect(), key=lambda r: -r.step)  # at most 64 steps a doubling
    tokens, distinct = sum(r.n for r in steps), sum(r.v for r in steps)
    least, held = (steps[0].least + 1 if steps else 1), 0
    for r in steps:
        held += r.v
        if held > shape.words:
            break
        least = r.least
    rows = counts.where(F.col("n") >= least).toPandas()
    rows = rows.sort_values(["n", "word"], ascending=[False, True])
    words = rows["word"].to_numpy(np.int64).view(np.uint64)
    seen = rows["n"].to_numpy(np.float64)
    k, m, base = len(words), shape.modelled, shape.per_class
    edges = [e for e in (m, *shape.bands)]
    group = np.empty(k + 1, np.int32)
    rank = np.arange(k)
    group[:k] = np.where(rank < m, rank // base, shape.classes + np.searchsorted(edges, rank, side="right") - 1)
    group[k] = shape.groups - 1
    size = np.bincount(group[:k], seen, minlength=shape.groups)
    size[-1] = tokens - seen.sum()
    share = size + 0.5
    places = np.full(m, 1e-3)
    places[: min(k, m)] = seen[:m] + 0.5
    places = places.reshape(shape.classes, base)
    depth = np.zeros(shape.groups, np.int32)
    inside = np.zeros(k)
    prior, prior_at = [], {}
    for g in range(shape.classes, shape.groups - 1):
        at = np.flatnonzero(group[:k] == g)
        depth[g] = shape.depth(len(at))
        for level in range(depth[g]):
            tail = words[at] & np.uint64(base ** (level + 1) - 1)
            total = np.bincount(tail.astype(np.int64), seen[at] + 0.5, minlength=base ** (level + 1)) + 1e-3
            total = total.reshape(base, -1).T  # by the digits before it, then by this digit
            prior_at[g, level] = sum(map(len, prior))
            prior.append(np.log(total / total.sum(1, keepdims=True)))
        cell = (words[at] & np.uint64(base ** int(depth[g]) - 1)).astype(np.int64)
        total = np.bincount(cell, seen[at] + 0.5)
        inside[at] = np.log((seen[at] + 0.5) / total[cell])
    depth[-1] = shape.depth(distinct - k)
    starts = np.full((shape.groups, max(int(depth.max()), 1)), -1, np.int64)
    for (g, level), at in prior_at.items():
        starts[g, level] = at
    order = np.argsort(words)
    return Counts(
        shape, tokens, distinct, least, words[order], rank[order].astype(np.int32), seen, group,
        np.log(share / share.sum()).astype(np.float32),
        np.log(places / places.sum(1, keepdims=True)).astype(np.float32),
        depth, np.concatenate([*prior, np.zeros((1, base))]).astype(np.float32), starts, inside,
    )


def token_ranks(column: pa.Array, counts: Counts):
    """Ranks of all tokens, ends included; the rest have rank k. Also hashes and edges per text."""
    words = split_words(column)
    texts = len(words.edge) - 1
    owner = np.repeat(np.arange(texts), np.diff(words.edge))
    hashes = np.full(len(owner) + texts, END)
    hashes[np.arange(len(owner)) + owner] = words.hashes
    edge = words.edge + np.arange(texts + 1)
    if not len(counts.hashes):
        return np.zeros(len(hashes), np.int32), hashes, edge
    at = np.minimum(np.searchsorted(counts.hashes, hashes), len(counts.hashes) - 1)
    ranks = np.where(counts.hashes[at] == hashes, counts.ranks[at], len(counts.hashes))
    return ranks, hashes, edge


def features(hashes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Context hashes of every token, one row per feature."""
    first = np.zeros(len(hashes), bool)
    first[edge[:-1]] = True
    start = np.uint64(1 << 40)
    one = np.empty_like(hashes)
    one[0:1], one[1:] = start, hashes[:-1]
    one[first] = start
    two = np.empty_like(hashes)
    two[0:1], two[1:] = start, one[:-1]
    two[first] = start
    return np.stack([mix(one), mix(mix(one) ^ two), mix(two ^ np.uint64(1 << 50))])


#: Sums of this size are within what exp can take in 32 bits, and so are their rows' totals.
SAFE = 60.0


def _softmax(z: np.ndarray, hit: np.ndarray, whole: bool):
    """Log probability of `hit` in each row, and, if `whole`, the probabilities; `z` is used up.

    Rows are moved to a maximum of 0 only where a value is beyond `SAFE` on either side.
    """
    if z.max(initial=0) > SAFE or z.min(initial=0) < -SAFE:
        z -= z.max(1, keepdims=True)
    logs = z[np.arange(len(z)), hit]
    p = np.exp(z, out=z)
    total = p @ np.ones(p.shape[1], np.float32)
    logs -= np.log(total)
    if not whole:
        return logs, None
    p *= (1 / total)[:, None]
    return logs, p


class Weights:
    """The two weight tables: features by group, features and node by place or digit."""

    def __init__(self, counts: Counts, flat: np.ndarray | None = None):
        self.shape, self.buckets = counts.shape, counts.buckets
        width = self.shape.groups + self.shape.per_class
        flat = np.zeros((self.buckets, width), np.float32) if flat is None else flat
        # Tables of their own: rows are taken from them as whole stretches of memory.
        self.group, self.place = (t.copy() for t in np.split(flat, [self.shape.groups], axis=1))

    @property
    def flat(self) -> np.ndarray:
        return np.concatenate([self.group, self.place], axis=1)

    def _sums(self, table, start, rows):
        total = table.take(rows[0], 0, mode="clip")
        for one in rows[1:]:
            total += table.take(one, 0, mode="clip")
        total += start
        return total

    def forward(self, counts: Counts, hashes, ranks, context, whole: bool = True):
        """Log probabilities, and (is it the group table, rows, hits, probabilities) by softmax.

        Probabilities are None unless `whole`.
        """
        shape, size = self.shape, np.uint64(self.buckets - 1)
        rows = (context & size).astype(np.int64)
        group = counts.group[ranks]
        logs, p = _softmax(self._sums(self.group, counts.group_log, rows), group, whole)
        logs = logs.astype(np.float64)
        met = [(True, rows, group, p)]
        inner = np.flatnonzero(group < shape.classes)
        if len(inner):
            rows = (mix(context[:, inner] ^ group[inner].astype(np.uint64)) & size).astype(np.int64)
            hit = ranks[inner] % shape.per_class
            more, p = _softmax(self._sums(self.place, counts.place_log[group[inner]], rows), hit, whole)
            logs[inner] += more
            met.append((False, rows, hit, p))
        depth = counts.depth[group]
        for level in range(int(depth.max(initial=0))):
            at = np.flatnonzero(depth > level)
            g, word, shift = group[at], hashes[at], np.uint64(shape.bits * level)
            before = word & ((np.uint64(1) << shift) - np.uint64(1))
            hit = ((word >> shift) & np.uint64(shape.per_class - 1)).astype(np.int64)
            node = mix((before << np.uint64(8)) ^ g.astype(np.uint64) ^ np.uint64((level + 1) << 58))
            rows = (mix(context[:1, at] ^ node) & size).astype(np.int64)
            first = counts.prior_at[g, level]
            prior = counts.prior[np.where(first < 0, -1, first + np.where(first < 0, 0, before.astype(np.int64)))]
            more, p = _softmax(self._sums(self.place, prior, rows), hit, whole)
            logs[at] += more
            met.append((False, rows, hit, p))
        known = np.flatnonzero((ranks >= shape.modelled) & (ranks < len(counts.seen)))
        logs[known] += counts.inside_log[ranks[known]]
        return logs, met


def _add_rows(table, rows, values, speed, met, rate):
    """One adaptive step: rows of `values` summed by table row; `met` counts them."""
    order = np.argsort(rows.astype(np.uint16) if len(table) <= 1 << 16 else rows, kind="stable")
    sorted_rows = rows[order]
    first = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    size = np.diff(np.append(first, len(rows)))
    target = sorted_rows[first]
    total = values.take(order[first], 0, mode="clip")  # a row met once is its own sum
    twice = np.flatnonzero(size == 2)
    total[twice] += values.take(order[first[twice] + 1], 0, mode="clip")
    several = np.flatnonzero(size > 2)
    if len(several):
        begin = np.cumsum(size[several]) - size[several]
        inside = np.repeat(size > 2, size)
        total[several] = np.add.reduceat(values.take(order[inside], 0, mode="clip"), begin, axis=0)
    speed[target] += np.einsum("ij,ij->i", total, total) / np.float32(total.shape[1])
    met[target] += size
    total *= (np.float32(rate) / np.sqrt(speed[target] + np.float32(1)))[:, None]
    total += table.take(target, 0, mode="clip")
    table[target] = total


def _train(counts, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = _unpacked(counts.value), weights.value
        shape = known.shape
        own = Weights(known, start)
        speed = np.zeros((2, own.buckets), np.float32)
        met = np.zeros((own.buckets, 2), np.float32)
        for piece in pieces(batches, "text"):
            ranks, hashes, edge = token_ranks(piece.column("text"), known)
            context = features(hashes, edge)
            for at in range(0, len(ranks), shape.batch):
                part = slice(at, at + shape.batch)
                _, softmaxes = own.forward(known, hashes[part], ranks[part], context[:, part])
                for top, rows, hit, p in softmaxes:
                    p *= -1
                    p[np.arange(len(p)), hit] += 1
                    table, k = (own.group, 0) if top else (own.place, 1)
                    for one in rows:
                        _add_rows(table, one, p, speed[k], met[:, k], shape.rate)
        if met.any():
            step = np.split((own.flat - start).astype(np.float16), BLOCKS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([b.tobytes() for b in step]),
                 pa.array([b.tobytes() for b in np.split(met, BLOCKS)])],
                names=["block", "step", "met"],
            )

    return run


def _add_blocks(groups: int, places: int):
    """Each row's steps averaged by how often they were met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for block, step, met in zip(*(batch.column(c) for c in ("block", "step", "met"))):
                met = np.frombuffer(met.as_buffer(), np.float32).reshape(-1, 2)
                step = np.frombuffer(step.as_buffer(), np.float16).reshape(len(met), -1).astype(np.float32)
                step[:, :groups] *= met[:, :1]
                step[:, groups:] *= met[:, 1:]
                total = held.setdefault(block.as_py(), [np.zeros(step.shape), np.zeros(met.shape)])
                total[0] += step
                total[1] += met
        for block, (step, met) in held.items():
            step /= np.maximum(np.repeat(met, [groups, places], axis=1), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([step.astype(np.float32).tobytes()])], names=["block", "step"]
            )

    return run


def train(docs: DataFrame, counts: Counts) -> np.ndarray:
    """Weights after one pass over the training texts, in rounds."""
    context = docs.sparkSession.sparkContext
    shape = counts.shape
    flat = Weights(counts).flat
    known = context.broadcast(_packed(counts))
    added = _add_blocks(shape.groups, shape.per_class)
    for k in range(shape.rounds):
        rows = docs.where(is_training() & (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shape.rounds)) == k))
        steps = rows.select("text").mapInArrow(
            _train(known, context.broadcast(flat)), "block int, step binary, met binary"
        )
        parts = flat.reshape(BLOCKS, -1).copy()
        for row in steps.repartition("block").mapInArrow(added, "block int, step binary").collect():
            parts[row.block] += np.frombuffer(row.step, np.float32)
        flat = parts.reshape(flat.shape)
    return flat


def _score(counts, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _unpacked(counts.value)
        model = Weights(known, weights.value)
        size = np.log10(known.tokens + 0.5 * (known.distinct + 1))
        base_log = np.append(np.log10(known.seen + 0.5) - size, 0.0)
        for piece in pieces(batches, "text"):
            ranks, hashes, edge = token_ranks(piece.column("text"), known)
            context = features(hashes, edge)
            logs = np.empty(len(ranks))
            for at in range(0, len(ranks), CACHED):
                part = slice(at, at + CACHED)
                logs[part], _ = model.forward(known, hashes[part], ranks[part], context[:, part], whole=False)
            rare = ranks >= len(known.seen)
            far = np.append(0, np.cumsum(rare))[edge]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("row"), piece.column("doc_id"), piece.column("held_out"),
                    pa.array(np.diff(edge).astype(np.int64)),
                    pa.array(np.add.reduceat(base_log[ranks], edge[:-1])),
                    pa.array(np.add.reduceat(logs, edge[:-1]) / LN10),
                    pa.ListArray.from_arrays(pa.array(far.astype(np.int32)), pa.array(hashes[rare].view(np.int64))),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "base", "score", "rare"],
            )

    return run


def score_texts(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` of every row."""
    counts = word_counts(docs)
    known = known_counts(counts, shape)
    weights = train(docs, known)
    context = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (~is_training()).alias("held_out"), "text"
    ).mapInArrow(
        _score(context.broadcast(_packed(known)), context.broadcast(weights)),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, base double, score double, rare array<long>",
    )
    rows = stored(rows, "lm-scores")  # row numbers are fixed from here on
    size = float(np.log10(known.tokens + 0.5 * (known.distinct + 1)))
    cell = F.col("word").bitwiseAND(F.lit(shape.per_class ** int(known.depth[-1]) - 1)).alias("cell")
    cells = counts.where(F.col("n") < known.least).groupBy(cell).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("words"),
        (F.sum("n") + 0.5 * (F.count("n") + 1)).alias("size"),
    )
    seen = F.element_at("words", F.col("word"))
    weight = F.log10(F.coalesce(seen, F.lit(0)) + 0.5)
    met = (
        rows.select("row", F.explode("rare").alias("word")).select("row", "word", cell).join(cells, "cell", "left")
        .groupBy("row").agg(
            F.sum(weight).alias("logs"), F.sum(weight - F.log10(F.coalesce("size", F.lit(0.5)))).alias("inside"),
            F.count(seen).alias("met"),
        )
    )
    rare = F.size("rare")
    logs, inside, found = (F.coalesce(c, F.lit(0)) for c in ("logs", "inside", "met"))
    return rows.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_tokens") - rare + found).alias("n_known"),
        F.lit(known.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + logs - rare * size).alias("base_score"),
        (F.col("score") + inside).alias("score"),
    )
