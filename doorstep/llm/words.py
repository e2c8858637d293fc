"""Words of many texts at once, as numpy arrays over the UTF-8 bytes.

A word's identity is a 64-bit hash of its bytes, eight bytes at a time through a strong mixer.
Two of n different words collide with odds of about n*n / 2**65 (under one in a million for
five million words).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = b" \t\n\x0b\x0c\r"
#: Bytes that belong to words: everything but the six white space bytes.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACE)] = False
#: Letters and digits, and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[128:] = True
for first, last in (b"09", b"AZ", b"az"):
    LETTERS[first : last + 1] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = x + _GOLD
    x = (x ^ (x >> _S30)) * _A
    x = (x ^ (x >> _S27)) * _B
    return x ^ (x >> _S31)


@dataclass
class Words:
    """Words of a run of texts: `edge[d]:edge[d + 1]` are those of text `d`."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    edge: np.ndarray

    @property
    def hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.stops)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end and where each begins; null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, ends, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return whole, offsets - offsets[0]


def split_words(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = True) -> Words:
    data, offsets = text_bytes(column)
    inside = kind[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(
        _LOWER[data] if lower else data, offsets, starts, stops, np.searchsorted(starts, offsets)
    )


def hash_spans(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = stops - starts
    out = mix(size.astype(np.uint64))
    at, rows = 0, np.arange(len(starts))
    while len(rows):
        left = np.minimum(size[rows] - at, 8)
        chunk = eight[starts[rows] + at] & _MASK[left]
        out[rows] = mix(out[rows] ^ chunk)
        at += 8
        rows = rows[size[rows] > at]
    return out


def shingle_hashes(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `width`-word windows and the edges per text; a shorter text is one window."""
    hashes = words.hashes
    count = np.diff(words.edge)
    n = len(hashes)
    windows = mix(hashes)  # so that the order of words counts
    for k in range(1, min(width, n)):
        windows[: n - k] = mix(windows[: n - k] + hashes[k:])
    last = np.repeat(words.edge[1:], count)
    whole = np.arange(n) + width <= last
    short = np.flatnonzero((count > 0) & (count < width))
    for text in short:
        h = np.uint64(count[text])
        for w in hashes[words.edge[text] : words.edge[text + 1]]:
            h = mix(np.array([h ^ w], np.uint64))[0]
        windows[words.edge[text]] = h
        whole[words.edge[text]] = True
    kept = np.flatnonzero(whole)
    return windows[kept], np.searchsorted(kept, words.edge)
