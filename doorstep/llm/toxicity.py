"""Toxic texts by multiple-instance learning: a text is toxic when any sentence is.

Sentences are bags of words and of word beginnings (a stem with any ending). A sentence's score
is a logistic function of their weights, a text's score is the noisy-or of its sentences,
1 - prod(1 - s). Weights are learned from labels of whole texts only, so the sentences that
carry a text's score can be pointed out.

Training reads a bounded sample of labelled rows (`Fit.rows`, the first by a hash of doc_id).
Each round is one Spark job: tasks add up gradients of their texts over the same weights, the
driver sums one vector per task and takes a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.store import pieces, stored
from doorstep.llm.words import LETTERS, hash_spans, split_words

_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True
#: Lengths in bytes of the word beginnings that count besides the word.
BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class Fit:
    """Bounds and steps of the training."""

    rows: int = 20_000  # labelled rows read at most
    features: int = 1 << 13  # words with a weight at most
    least: int = 4  # labelled texts a word must be in
    rounds: int = 40
    rate: float = 0.5
    decay: float = 2e-4
    tasks: int = 8  # tasks of one round


@dataclass(frozen=True)
class Model:
    """Sorted word hashes and their weights; `bias` is a sentence without any of them."""

    words: np.ndarray = field(repr=False)
    weights: np.ndarray = field(repr=False)
    bias: float


def training_rows(held_out_remainder: int = 2, parts: int = 4) -> Column:
    """Rows that may be learned from: crc32 of the id as text leaves another remainder."""
    return F.crc32(F.col("doc_id").cast("string")) % parts != held_out_remainder


def sentence_words(column: pa.Array):
    """Feature hashes, the sentence of each, the text of each sentence, words and their sentences.

    Sentences are numbered over all texts of the run. A word gives itself and its first bytes.
    """
    words = split_words(column, LETTERS)
    text = np.repeat(np.arange(len(words.edge) - 1), np.diff(words.edge))
    part = np.cumsum(_STOP[words.data])[words.starts] if len(text) else np.zeros(0, np.int64)
    fresh = np.ones(len(text), bool)
    fresh[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
    sentence = np.cumsum(fresh) - 1
    hashes, owners = [words.hashes], [sentence]
    for size in BEGINNINGS:
        longer = np.flatnonzero(words.stops - words.starts > size)
        at = words.starts[longer]
        hashes.append(~hash_spans(words.data, at, at + size))
        owners.append(sentence[longer])
    return np.concatenate(hashes), np.concatenate(owners), text[fresh], words, sentence


def _known(hashes: np.ndarray, sorted_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes have a weight, and its place."""
    if not len(sorted_words):
        return np.zeros(len(hashes), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_words, hashes), len(sorted_words) - 1)
    hit = sorted_words[at] == hashes
    return hit, at[hit]


def sample(docs: DataFrame, labels: DataFrame, fit: Fit) -> DataFrame:
    """At most `fit.rows` labelled texts; the id list is small by that bound and is sent to all."""
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training_rows())
        .groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(fit.rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", F.col("_toxic").cast("int").alias("toxic")
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts each word is in, by label, per run of texts."""
    for piece in pieces(batches, "text"):
        hashes, sentence, owner, *_ = sentence_words(piece.column("text"))
        toxic = piece.column("toxic").to_numpy(zero_copy_only=False)
        pairs = np.unique(np.stack([hashes, owner[sentence].astype(np.uint64)]), axis=1)
        word, first = np.unique(pairs[0], return_index=True)
        marks = toxic[pairs[1].astype(np.int64)].astype(np.int64)
        if len(word):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(word.view(np.int64)),
                    pa.array(np.diff(np.append(first, len(marks)))),
                    pa.array(np.add.reduceat(marks, first)),
                ],
                names=["word", "texts", "toxic"],
            )


def vocabulary(rows: DataFrame, fit: Fit) -> np.ndarray:
    """The words most tied to either label by their log likelihood ratio."""
    counts = (
        rows.mapInArrow(_word_counts, "word long, texts long, toxic long")
        .groupBy("word").agg(F.sum("texts").alias("n"), F.sum("toxic").alias("k"))
        .where(F.col("n") >= fit.least)
    )
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k")).first()
    rate = min(max((total["k"] or 0) / max(total["n"], 1), 1e-9), 1 - 1e-9)

    def part(seen: Column, share: float) -> Column:
        return F.when(seen > 0, seen * F.log(seen / (F.col("n") * share))).otherwise(0.0)

    gain = part(F.col("k"), rate) + part(F.col("n") - F.col("k"), 1 - rate)
    best = (
        counts.select("word", gain.alias("gain"))
        .orderBy(F.desc("gain"), "word").limit(fit.features)
    )
    return np.sort(np.array([r.word for r in best.collect()], np.int64).view(np.uint64))


def _features(known: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            hashes, sentence, owner, *_ = sentence_words(piece.column("text"))
            order = np.argsort(sentence, kind="stable")
            hashes, sentence = hashes[order], sentence[order]
            hit, place = _known(hashes, known)
            sizes = np.bincount(sentence[hit], minlength=len(owner)).astype(np.int64)
            per_text = np.bincount(owner, minlength=piece.num_rows)
            cuts = np.append(0, np.cumsum(per_text))
            ends = np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("toxic"),
                    pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(sizes.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends[cuts].astype(np.int32)), pa.array(place.astype(np.int32))),
                ],
                names=["toxic", "sizes", "places"],
            )

    return run


def gradient(toxic, sizes, owner, places, weights, bias):
    """Gradient and loss of noisy-or log likelihood over texts laid end to end."""
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    z = bias + np.bincount(sentence, weights[places], minlength=len(sizes))
    z = np.clip(z, -30, 30)
    s = 1 / (1 + np.exp(-z))
    log_none = np.bincount(owner, -np.logaddexp(0, z), minlength=len(toxic))
    none = np.exp(np.minimum(log_none, -1e-9))
    # d/dz of log p is s * none / (1 - none); of log(1 - p) it is -s.
    push = np.where(toxic[owner] == 1, s * (none / (1 - none))[owner], -s)
    grad = np.bincount(places, push[sentence], minlength=len(weights))
    loss = -np.where(toxic == 1, np.log1p(-none), log_none).sum()
    return grad, push.sum(), loss


def _round(weights: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rest = np.zeros(len(weights)), np.zeros(3)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
            sizes = batch.column("sizes").flatten().to_numpy(zero_copy_only=False)
            counts = pc.list_value_length(batch.column("sizes")).to_numpy(zero_copy_only=False)
            places = batch.column("places").flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(toxic)), counts)
            grad, b, loss = gradient(toxic, sizes, owner, places, weights, bias)
            total += grad
            rest += (b, loss, len(toxic))
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.tobytes()]), pa.array([rest.tobytes()])], names=["grad", "rest"]
        )

    return run


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Model:
    """Weights from labels of whole texts. Without both labels every text scores the floor."""
    rows = stored(sample(docs, labels, fit), "toxic-sample")
    known = vocabulary(rows, fit)
    features = stored(
        rows.mapInArrow(_features(known), "toxic int, sizes array<int>, places array<int>")
        .repartition(fit.tasks), "toxic-features",
    )
    weights, bias = np.zeros(len(known)), -6.0
    speed, speed_b = np.full(len(known), 1e-8), 1e-8
    for step in range(fit.rounds if len(known) else 0):
        got = features.mapInArrow(_round(weights, bias), "grad binary, rest binary").collect()
        grad = np.sum([np.frombuffer(r.grad) for r in got], axis=0)
        b, _, n = np.sum([np.frombuffer(r.rest) for r in got], axis=0)
        grad, b = grad / max(n, 1) - fit.decay * weights, b / max(n, 1)
        speed = 0.8 * speed + 0.2 * grad**2
        speed_b = 0.8 * speed_b + 0.2 * b**2
        weights = weights + fit.rate * 0.93**step * grad / (np.sqrt(speed) + 1e-3)
        bias = float(np.clip(bias + fit.rate * 0.93**step * b / (np.sqrt(speed_b) + 1e-3), -14, -2))
    heavy = np.abs(weights) > 1e-3
    return Model(known[heavy], weights[heavy], bias)


def offending(mass: np.ndarray, owner: np.ndarray, texts: np.ndarray, cut: float) -> np.ndarray:
    """Of each of `texts`, the fewest sentences without which its noisy-or is under `cut`.

    `mass` is a sentence's -log(1 - s), its share of the text's sum. The strongest go first, the
    earlier of equals; the strongest is always among them.
    """
    found = [np.zeros(0, np.int64)]
    for begin, end in zip(np.searchsorted(owner, texts), np.searchsorted(owner, texts, side="right")):
        order = np.argsort(-mass[begin:end], kind="stable")
        left = np.cumsum(mass[begin:end][order][::-1])[::-1]
        found.append(begin + np.sort(order[: max(1, int((1 - np.exp(-left) >= cut).sum()))]))
    return np.concatenate(found)


def _scores(model: Model, spans: bool, cut: float = 0.3):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            hashes, sentence, owner, words, of_word = sentence_words(piece.column("text"))
            hit, place = _known(hashes, model.words)
            z = model.bias + np.bincount(
                sentence[hit], model.weights[place], minlength=len(owner)
            )
            z = np.clip(z, -30, 30)
            score = 1 - np.exp(np.bincount(owner, -np.logaddexp(0, z), minlength=piece.num_rows))
            score = np.clip(score, 0.0, 1.0)
            columns = [piece.column(c) for c in piece.schema.names if c != "text"]
            names = [c for c in piece.schema.names if c != "text"]
            if spans:
                loud = offending(np.logaddexp(0, z), owner, np.flatnonzero(score >= cut), cut)
                first = np.searchsorted(of_word, loud)
                last = np.searchsorted(of_word, loud, side="right") - 1
                by_text = [[] for _ in range(piece.num_rows)]
                for k, a, b in zip(loud, first, last):
                    text, base = owner[k], words.offsets[owner[k]]
                    by_text[text].append({
                        "start": int(words.starts[a] - base), "stop": int(words.stops[b] - base),
                        "score": float(1 / (1 + np.exp(-z[k]))),
                    })
                found = pa.array(by_text, pa.list_(pa.struct(
                    [("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))
                columns, names = [*columns, found], [*names, "sentences"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*names, "score"])

    return run


def score_texts(docs: DataFrame, model: Model, spans: bool = False, cut: float = 0.3) -> DataFrame:
    """`doc_id`, `score` of every row; with `spans`, also the offending sentences.

    Those are, of a text that scores `cut` or more, the fewest without which it would not.

    A span gives UTF-8 byte positions of a sentence's first and last word. A null or empty
    text has no sentence and scores 0. Repeated rows score alike; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    extra = ", sentences array<struct<start: long, stop: long, score: double>>" if spans else ""
    return docs.select("doc_id", "text").mapInArrow(
        _scores(model, spans, cut), f"doc_id {kind}{extra}, score double"
    )


def verdicts(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), cut: float = 0.3) -> DataFrame:
    """`doc_id`, `held_out`, `score`, `predicted` of every text; a null id is held out.

    `n_located` counts its offending sentences and `located_sha256` digests their `start:stop`.
    """
    scored = score_texts(docs, train(docs, labels, fit), spans=True, cut=cut)
    places = F.transform("sentences", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string")))
    return scored.select(
        "doc_id", F.coalesce(~training_rows(), F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
        F.size("sentences").alias("n_located"), F.sha2(F.array_join(places, ","), 256).alias("located_sha256"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), cut: float = 0.3) -> DataFrame:
    """Rows of `docs` whose text scores under `cut`, with their own columns.

    The texts travel through the scoring task once; nothing is joined back.
    """
    model = train(docs, labels, fit)

    def run(batches):
        for piece in pieces(batches, "text"):
            table = pa.RecordBatch.from_arrays([piece.column("text")], names=["text"])
            score = pa.concat_arrays([b.column("score") for b in _scores(model, False)(iter([table]))])
            yield piece.filter(pc.less(score, cut))

    return docs.mapInArrow(run, docs.schema)
