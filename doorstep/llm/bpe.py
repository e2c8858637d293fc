"""Byte-pair encoding of whole texts by a trie of words, and decoding.

The encoding of a prefix ends in exactly one token, and what stands before that token is the
encoding of the shorter prefix. So each trie node needs one state, its last token: the token
that ends here and may follow the last token of the node where it begins. Words of a run of
texts are put into a trie in sorted order, and states are passed down depth first; what words
share at their beginnings is worked out once. Reading states backwards from a word's last node
gives its tokens.

Two tokens may stand side by side when merging their bytes alone leaves exactly the two. The
answers are kept, as tokens meet again and again.

Documents are encoded where they are read: no shuffle. A task's trie and answers are bounded
(`NODES`, `PAIRS`); beyond that they start anew, which changes no result.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from doorstep.llm.store import pieces

#: The split pattern of byte-level tokenizers (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NODES = 1_500_000
PAIRS = 1_000_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The visible letter of each byte: itself where it prints, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Coder:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, spec: str):
        import regex

        file = json.loads(spec)
        letters = byte_letters()
        vocab = file["model"]["vocab"]
        self.id_of = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.bytes_of = {i: t for t, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for text, i in self.special.items():
            self.bytes_of.setdefault(i, text.encode())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: rank, left part, right part
        self.token_of: dict[tuple[int, int], int] = {}
        for rank, (left, right) in enumerate(pairs):
            a, b = (bytes(letters[c] for c in x) for x in (left, right))
            pair, token = (self.id_of[a], self.id_of[b]), self.id_of[a + b]
            self.rank.setdefault(pair, rank)
            self.token_of.setdefault(pair, token)
            self.made.setdefault(token, (rank, *pair))
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        # Longest token for each ending of three bytes: what is longer needs no look.
        self.reach: dict[bytes, int] = {}
        for t in self.id_of:
            self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.words = regex.compile(PATTERN).findall
        marks = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.restart()

    def restart(self) -> None:
        self.next: dict[int, int] = {}  # node * 256 + byte: child
        self.last = array("i", [-1])  # last token of the prefix that ends in the node
        self.begin = array("i", [0])  # node where that token begins
        self.codes: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers

    def merged(self, data: bytes) -> list[int]:
        """The merge rules applied to a few bytes, lowest rank first."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            found = [(self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
            if not found:
                break
            _, at = min(found)
            ids[at : at + 2] = [self.token_of[ids[at], ids[at + 1]]]
        return ids

    def may_follow(self, left: int, right: int) -> bool:
        """Whether no merge would ever join the two tokens' bytes across their border.

        Merging is undone from its end, latest first: the pieces that then meet at the border
        were neighbours for a while, and a rule for them must not have come before the rules
        that took them further.
        """
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b, until_a, until_b, free = left, right, NEVER, NEVER, True
        while True:
            rule = self.rank.get((a, b))
            if rule is not None and rule < until_a and rule <= until_b:
                free = False
                break
            made_a, made_b = self.made.get(a), self.made.get(b)
            if made_a is None and made_b is None:
                break
            if made_b is None or (made_a is not None and made_a[0] > made_b[0]):
                until_a, a = made_a[0], made_a[2]
            else:
                until_b, b = made_b[0], made_b[1]
        self.pairs[left, right] = free
        return free

    def is_own(self, token: int) -> bool:
        """Whether the token's bytes, alone, merge into it."""
        known = self.own.get(token)
        if known is None:
            known = self.own[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def state(self, path: list[int], word: bytes, stop: int) -> tuple[int, int]:
        """Last token of `word[:stop]` and the node where it begins, from the states above."""
        id_of, last = self.id_of, self.last
        reach = max(self.reach.get(word[max(0, stop - 3) : stop], 0), 2)
        for start in range(max(0, stop - reach), stop):
            token = id_of.get(word[start:stop])
            if token is None:
                continue
            before = path[start]
            if self.is_own(token) if start == 0 else self.may_follow(last[before], token):
                return token, before
        raise ValueError(f"no token ends {word[:stop]!r}")

    def insert(self, fresh: list[str]) -> None:
        """Sorted words into the trie; neighbours share the path down to where they part."""
        path, previous = [0], b""
        following, last, begin = self.next, self.last, self.begin
        for text in fresh:
            word = text.encode()
            same, most = 0, min(len(previous), len(word))
            while same < most and previous[same] == word[same]:
                same += 1
            del path[same + 1 :]
            node = path[-1]
            for depth in range(same, len(word)):
                edge = node * 256 + word[depth]
                child = following.get(edge)
                if child is None:
                    token, start = self.state(path, word, depth + 1)
                    following[edge] = child = len(last)
                    last.append(token)
                    begin.append(start)
                path.append(child)
                node = child
            previous = word
            ids = []
            while node:
                ids.append(last[node])
                node = begin[node]
            self.codes[text] = array("i", reversed(ids)).tobytes()

    def parts(self, text: str) -> list[str]:
        return self.cut.split(text) if self.cut else [text]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as 32-bit numbers; strings of special tokens become those tokens."""
        if len(self.last) > NODES:
            self.restart()
        split = [
            [p if k % 2 else self.words(p) for k, p in enumerate(self.parts(t))] for t in texts
        ]
        fresh: set[str] = set()
        for text in split:
            for words in text[::2]:
                fresh |= set(words).difference(self.codes)
        self.insert(sorted(fresh, key=str.encode))
        code = self.codes.__getitem__
        out = []
        for text in split:
            whole = b"".join(map(code, text[0]))
            for mark, words in zip(text[1::2], text[2::2]):
                whole += array("i", [self.special[mark]]).tobytes() + b"".join(map(code, words))
            out.append(whole)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[int, Coder] = {}


def _coder(spec: str) -> Coder:
    """One coder per worker and vocabulary; a worker runs many tasks."""
    key = hash(spec)
    if key not in _CODERS:
        _CODERS[key] = Coder(spec)
    return _CODERS[key]


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` plus `ids` (array of int), the tokens of each whole text.

    `vocabulary` is the path of a byte-level tokenizer file on the driver; its content (some
    megabytes, whatever the documents) is sent to the tasks. Null and empty texts give no ids.
    """
    with open(vocabulary) as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for piece in pieces(batches, text, 1 << 20):
            texts = [t or "" for t in piece.column(text).to_pylist()]
            found = coder.encode_all(texts)
            ends = (np.cumsum([0, *map(len, found)]) // 4).astype(np.int32)
            flat = np.frombuffer(b"".join(found), "<i4")
            yield pa.RecordBatch.from_arrays(
                [*piece.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))],
                names=[*piece.schema.names, ids],
            )

    base = docs.drop(ids)
    kind = T.StructType([*base.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return base.mapInArrow(run, kind)


def decode(rows: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`rows` plus `text`, the decoded tokens; bytes that are no UTF-8 become U+FFFD."""
    with open(vocabulary) as file:
        spec = rows.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for batch in batches:
            texts = [coder.decode(x or ()) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text]
            )

    base = rows.drop(text)
    kind = T.StructType([*base.schema.fields, T.StructField(text, T.StringType())])
    return base.mapInArrow(run, kind)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per row: `doc_id`, number and sha256 of its ids, and sha256 of the text they decode to.

    Ids are hashed as little-endian unsigned 32-bit integers. Encoding and decoding follow each
    other in one task, so ids and texts of a row do not travel.
    """
    with open(vocabulary) as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(spec.value)
        for piece in pieces(batches, "text", 1 << 20):
            found = coder.encode_all([t or "" for t in piece.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found]),
                    pa.array([
                        hashlib.sha256(coder.decode(np.frombuffer(x, "<i4").tolist()).encode()).hexdigest()
                        for x in found
                    ]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
