"""Product codes of vectors: a small codebook per part, refined in rounds, with bounds that spare scans.

Components become whole numbers, so that every distance and every mean is exact and results do not
depend on partitions. In a round each part of each vector is assigned to its nearest codebook
entry; then entries become the floored means of their parts.

Each part keeps two bounds from its last exact scan: an upper one on the distance to its own
entry, a lower one on that to every other, each with the round it was taken in (its stamp). All
codebooks so far are kept, so a bound is brought up to date by the true net displacement of the
entries between its round and now, not by the sum of their moves: an entry that went away and
came back costs nothing. Where the upper bound stays below the lower one, the assignment stands
without a scan; where it does not, the distance to the own entry is taken anew, and only if
that does not settle it, all entries are scanned. Bounds are rounded outwards, and ties are always scanned.

Vectors and their state are rows in the shared folder, written once a round; the round's sums
come from the same pass, so a lost task repeats one pass over its rows. The codebooks so far
(rounds x parts x entries) are all that is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doorstep.llm.spread import attach
from doorstep.llm.store import discard, stored

SCALE = 4096
#: Components beyond this are taken as this (vectors of over 32,768 in one direction), so that
#: squared distances fit 64 bits.
LIMIT = 1 << 27


def whole(vector: Column) -> Column:
    """Components as whole numbers, floored."""
    return F.transform(
        vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int")
    )


def usable(vector: Column) -> Column:
    """Not null, and no component null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of n parts (n, width) to the entries of a book (entries, width)."""
    out = np.empty((len(parts), len(book)), np.int64)
    for entry, values in enumerate(book):
        gap = parts - values
        out[:, entry] = np.einsum("nw,nw->n", gap, gap)
    return out


def _up(x: np.ndarray) -> np.ndarray:
    return x * (1 + 1e-12)


def _down(x: np.ndarray) -> np.ndarray:
    return x * (1 - 1e-12)


def displacements(history: np.ndarray) -> np.ndarray:
    """How far each entry is now from where it was in each round: (rounds, parts, entries)."""
    gap = (history[-1][None] - history).astype(np.float64)
    return _up(np.sqrt(np.einsum("rpew,rpew->rpe", gap, gap)))


#: A part's state: its entry, the bounds' rounds, and the bounds.
STATE = np.dtype([("entry", "u1"), ("own_round", "u1"), ("rest_round", "u1"), ("own", "<f8"), ("rest", "<f8")])


def assign(vectors: np.ndarray, state: np.ndarray | None, history: np.ndarray) -> tuple[np.ndarray, int]:
    """The state of (n, parts, width) vectors after assigning them to the last of `history`, and the parts scanned."""
    now = len(history) - 1
    book = history[-1]
    n, parts, _ = vectors.shape
    if state is None:
        state = np.zeros((n, parts), STATE)
        suspects = [np.arange(n)] * parts
    else:
        state = state.copy()
        moved = displacements(history)
        # The farthest that any entry but the own one has come, by the lower bound's round.
        order = np.sort(moved, axis=2)
        most, second = order[:, :, -1], order[:, :, -2] if order.shape[2] > 1 else order[:, :, -1] * 0
        suspects = []
        for part in range(parts):
            s = state[:, part]
            farthest = most[s["rest_round"], part]
            drift = np.where(moved[s["rest_round"], part, s["entry"]] == farthest, second[s["rest_round"], part], farthest)
            lower = _down(s["rest"] - drift)
            open_ = np.flatnonzero(_up(s["own"] + moved[s["own_round"], part, s["entry"]]) >= lower)
            gap = vectors[open_, part].astype(np.int64) - book[part][s["entry"][open_]]
            own = _up(np.sqrt(np.einsum("nw,nw->n", gap, gap).astype(np.float64)))
            s["own"][open_], s["own_round"][open_] = own, now
            suspects.append(open_[own >= lower[open_]])
    for part, rows in enumerate(suspects):
        if len(rows):
            s = state[:, part]
            found = distances(vectors[rows, part].astype(np.int64), book[part])
            best = found.argmin(axis=1)  # the first of equals
            root = np.sqrt(found.astype(np.float64))
            s["entry"][rows], s["own_round"][rows], s["rest_round"][rows] = best, now, now
            s["own"][rows] = _up(root[np.arange(len(rows)), best])
            root[np.arange(len(rows)), best] = np.inf
            s["rest"][rows] = _down(root.min(axis=1))
    return state, sum(map(len, suspects))


def _rows(column: pa.Array, kind) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _binary(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    wide = values.itemsize * values.shape[1]
    ends = np.arange(0, wide * len(values) + 1, wide, dtype=np.int32) if wide else np.zeros(len(values) + 1, np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(values), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]
    )


def _pass(history: np.ndarray, kind: str, first: bool):
    """Assign all rows to the last codebook; a batch's first row carries its sums and scans."""
    _, parts, entries, width = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _rows(batch.column("q"), "<i4").reshape(batch.num_rows, parts, width)
            old = None if first else _rows(batch.column("state"), STATE).reshape(batch.num_rows, parts)
            state, scanned = assign(vectors, old, history)
            sums = np.zeros((parts, entries, width + 1), np.int64)
            for part in range(parts):
                np.add.at(sums[part, :, :width], state["entry"][:, part], vectors[:, part])
                sums[part, :, width] = np.bincount(state["entry"][:, part], minlength=entries)
            tally = np.append(sums.ravel(), scanned)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("label"), batch.column("q"), _binary(state),
                    pa.array([tally.tolist(), *[None] * (batch.num_rows - 1)], pa.list_(pa.int64())),
                ],
                names=["vec_id", "label", "q", "state", "sums"],
            )

    return run, f"{kind}, q binary, state binary, sums array<long>"


def _codes(history: np.ndarray, kind: str):
    """Codes and exact errors under the last codebook."""
    _, parts, entries, width = history.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = history[-1]
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _rows(batch.column("q"), "<i4").reshape(batch.num_rows, parts, width)
            state, _ = assign(vectors, _rows(batch.column("state"), STATE).reshape(batch.num_rows, parts), history)
            gap = vectors.astype(np.int64) - book[np.arange(parts), state["entry"]]
            error = np.einsum("npw,npw->n", gap, gap)
            codes = [bytes(row).hex() for row in np.ascontiguousarray(state["entry"])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(error)],
                names=["vec_id", "label", "code", "error"],
            )

    return run, f"{kind}, code string, error long"


def _totals(state: DataFrame) -> np.ndarray:
    """Sums of all batches: parts x entries x (width + 1) numbers and one, whatever the rows."""
    rows = (
        state.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "v"))
        .groupBy("at").agg(F.sum("v").alias("v")).collect()
    )
    out = np.zeros(len(rows), np.int64)
    for row in rows:
        out[row["at"]] = row["v"]
    return out


def next_book(book: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Floored means of the assigned parts; entries without any stay."""
    width = book.shape[2]
    count = sums[:, :, width:]
    return np.where(count > 0, sums[:, :, :width] // np.maximum(count, 1), book)


def prepared(vectors: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """Stored `vec_id`, `label`, `q` (whole components, little-endian) and the width of a part."""
    kept = vectors.where(usable(F.col("embedding"))).select("vec_id", "label", whole(F.col("embedding")).alias("v"))
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    fill = F.concat("v", F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            values = column.flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(len(column), -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), _binary(values)], names=["vec_id", "label", "q"]
            )

    kind = _kind(vectors)
    return stored(kept.select("vec_id", "label", fill.alias("v")).mapInArrow(run, f"{kind}, q binary"), "codebooks-vectors"), width


def _kind(vectors: DataFrame) -> str:
    return ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in ("vec_id", "label"))


def first_book(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids, null ids last; equal ids go by their bytes."""
    least = rows.select("vec_id", "q").orderBy(F.asc_nulls_last("vec_id"), "q").limit(entries).collect()
    book = np.array([np.frombuffer(r.q, "<i4") for r in least], np.int64).reshape(len(least), parts, width)
    return book.transpose(1, 0, 2)


def trained(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6
) -> tuple[DataFrame | None, np.ndarray, list[int]]:
    """The state after all rounds, the codebooks of all rounds, and the parts scanned in each."""
    rows, width = prepared(vectors, parts)
    history = first_book(rows, parts, entries, width)[None]
    if not history.shape[2]:
        return None, history, []
    state, scans = rows, []
    for turn in range(rounds):
        run, schema = _pass(history, _kind(vectors), turn == 0)
        columns = ["vec_id", "label", "q", *(["state"] if turn else [])]
        fresh = stored(state.select(*columns).mapInArrow(run, schema), "codebooks-state")
        discard(state)
        totals = _totals(fresh)
        scans.append(int(totals[-1]))
        sums = totals[:-1].reshape(parts, -1, width + 1)
        state, history = fresh, np.concatenate([history, next_book(history[-1], sums)[None]])
    return state, history, scans


def compressed(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """Per usable row of `vectors` (vec_id, embedding, label): code, error, label_error, codebooks_sha256.

    Rows whose vector is null, or holds a null or non-finite component, take no part. Vectors shorter
    than the longest, or than a multiple of `parts`, are filled up with zeros. With fewer rows than
    `entries` the codebooks are as small. Equal rows are rows of their own, null labels are one
    label, null ids come last among the first entries. An empty table gives no rows. Other columns
    are ignored.
    """
    if rounds < 1 or not 1 <= entries <= 256:
        raise ValueError("at least one round and 1 to 256 entries")
    own = vectors.select("vec_id", "label", "embedding")
    state, history, _ = trained(own, parts, entries, rounds)
    if state is None:
        empty = f"{_kind(own)}, code string, error long"
        rows = own.sparkSession.createDataFrame([], empty)
    else:
        run, schema = _codes(history, _kind(own))
        rows = stored(state.select("vec_id", "label", "q", "state").mapInArrow(run, schema), "codebooks-codes")
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest()
    return attach(rows, sums, "label").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
