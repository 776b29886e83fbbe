"""Byte-level BPE encoding and decoding by corpus-level merge replay.

All distinct pre-tokens of a block of documents lie in one symbol array. An inverted index maps each
merge rank to the positions whose pair has it; ranks are replayed in order through a heap, each
applied to all of its positions at once, and only the neighbours of a merged pair are looked up anew.

Nulls and empty texts give no tokens. Very long texts are read whole, each a block of its own; repeated
rows are encoded like any others; extra columns stay, clashing ones raise ValueError; an empty table
gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import CHUNK_BYTES, Numbering, released, text_chunks

NONE = np.int32(2**31 - 1)
#: Distinct pre-tokens that a worker keeps encoded; beyond it, it starts afresh.
CACHE_WORDS = 250_000


@cache
def load(path: str) -> MergeTable:
    """The merge table of a file of ``base64 rank`` lines, once for each process."""
    with open(path, "rb") as f:
        return MergeTable({base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())})


class MergeTable:
    """Ranks of byte strings and, for every pair of tokens whose joined bytes have one, that rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pieces = {r: b for b, r in ranks.items()}
        self.bytes_to_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.width = np.int64(max(ranks.values()) + 1)
        keys, to = array("q"), array("i")
        for piece, r in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(self.width) + b)
                    to.append(r)
        order = np.argsort(np.frombuffer(keys, dtype=np.int64), kind="stable")
        self.keys = np.append(np.frombuffer(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.to = np.append(np.frombuffer(to, dtype=np.int32)[order], NONE)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, NONE where there is none."""
        key = a.astype(np.int64) * self.width + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], NONE)

    def one(self, word: bytes) -> list[int]:
        """A single word, pair by pair: lowest rank first, leftmost among equals."""
        tok = [int(self.bytes_to_id[c]) for c in word]
        n = len(tok)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        rank_of = lambda i: self.ranks.get(self.pieces[tok[i]] + self.pieces[tok[nxt[i]]]) if nxt[i] >= 0 else None
        cur = [rank_of(i) for i in range(n)]
        heap = [(r, i) for i, r in enumerate(cur) if r is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if cur[i] != r:
                continue
            j = nxt[i]
            tok[i], nxt[i], cur[j] = r, nxt[j], None
            if nxt[i] >= 0:
                prv[nxt[i]] = i
            for k in (i, prv[i]):
                if k >= 0:
                    cur[k] = rank_of(k)
                    if cur[k] is not None:
                        heapq.heappush(heap, (cur[k], k))
        out, i = [], 0
        while i >= 0 and n:
            out.append(tok[i])
            i = nxt[i]
        return out

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of every word (each distinct word once is enough): the merges of all words,
        replayed rank by rank over the inverted index."""
        out: list[list[int] | None] = [[r] if (r := self.ranks.get(w)) is not None else None if w else [] for w in words]
        todo = [i for i, x in enumerate(out) if x is None]
        if not todo:
            return out
        raw = np.frombuffer(b"".join(words[i] for i in todo), dtype=np.uint8)
        size = np.array([len(words[i]) for i in todo], dtype=np.int64)
        ends = np.cumsum(size)
        tok = self.bytes_to_id[raw]
        n = len(tok)
        word = np.repeat(np.arange(len(todo), dtype=np.int32), size)
        nxt = np.arange(1, n + 1, dtype=np.int32)
        nxt[ends - 1] = -1
        prv = np.arange(-1, n - 1, dtype=np.int32)
        prv[ends - size] = -1
        cur = np.full(n, NONE, dtype=np.int32)
        live = np.ones(n, dtype=bool)
        at = np.flatnonzero(nxt >= 0)
        cur[at] = self.pair_rank(tok[at], tok[nxt[at]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(where: np.ndarray) -> None:
            where = where[cur[where] != NONE]
            if not len(where):
                return
            where = where[np.argsort(cur[where], kind="stable")]
            r = cur[where]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            for first, part in zip(r[np.r_[0, cuts]].tolist(), np.split(where, cuts), strict=True):
                if first in index:
                    index[first].append(part)
                else:
                    index[first] = [part]
                    heapq.heappush(heap, first)

        post(at)
        redo: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
            pos = np.unique(pos[cur[pos] == r])
            if not len(pos):
                continue
            if len(pos) > 1:  # of overlapping pairs (aaa), every other one from the left
                follows = nxt[pos[:-1]] == pos[1:]
                if follows.any():
                    k = np.arange(len(pos))
                    start = np.maximum.accumulate(np.where(np.r_[True, ~follows], k, 0))
                    pos = pos[(k - start) % 2 == 0]
            right = nxt[pos]
            after = nxt[right]
            tok[pos] = r
            nxt[pos] = after
            live[right] = False
            cur[right] = NONE
            has = after >= 0
            prv[after[has]] = pos[has]
            left = prv[pos]
            touched = np.unique(np.concatenate([pos, left[left >= 0]]))
            ended = nxt[touched] < 0
            cur[touched[ended]] = NONE
            touched = touched[~ended]
            cur[touched] = self.pair_rank(tok[touched], tok[nxt[touched]])
            back = touched[cur[touched] < r]
            if len(back):  # a lower rank appeared while others of r were applied too: order may matter within the word
                redo.update(word[back].tolist())
            post(touched)
        ids = tok[live]
        counts = np.bincount(word[live], minlength=len(todo))
        for k, part in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
            out[todo[k]] = part.tolist()
        for k in redo:
            out[todo[k]] = self.one(words[todo[k]])
        return out


class Encoder:
    """Encodes texts by a merge table and a pre-token pattern, keeping the pre-tokens it has met."""

    def __init__(self, path: str, pattern: str):
        self.table, self.split = load(path), regex.compile(pattern).findall
        self.clear()

    def clear(self) -> None:
        self.number, self.ids, self.text = Numbering(), [], []
        self.lengths = array("i")

    def words(self, texts: list[str], most: int = CACHE_WORDS) -> list[list[int]]:
        """Numbers of the pre-tokens of each text; all of them encoded. Known ones are forgotten once
        they are more than ``most``."""
        if len(self.number) > most:
            self.clear()
        number = self.number
        out = [[number[w] for w in self.split(x)] for x in texts]
        if len(number) > len(self.ids):
            new = list(number)[len(self.ids) :]
            ids = self.table.replay([w.encode() for w in new])
            self.ids += ids
            self.text += [" ".join(map(str, x)) for x in ids]
            self.lengths.extend(map(len, ids))
        return out

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.table.pieces
        return b"".join([pieces[i] for i in ids])

    def decoded_words(self) -> list[bytes]:
        """The bytes that the ids of each known pre-token stand for."""
        return [self.decode(x) for x in self.ids]


@cache
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _appended(df: DataFrame, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    if clash := {n for n, _ in fields} & set(df.columns):
        raise ValueError(f"the input already has columns {sorted(clash)}; name them otherwise")
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """df with the array of token ids of a text column. A clash of names raises ValueError."""
    schema = _appended(df, [(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in text_chunks(batches, column):
            words = e.words([x or "" for x in b.column(b.schema.get_field_index(column)).to_pylist()])
            made = pa.array([[i for w in x for i in e.ids[w]] for x in words], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, made], [*b.schema.names, ids])
        e.clear()

    return df.mapInArrow(released(run), schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that an array of token ids stands for; a null array gives empty bytes."""
    schema = _appended(df, [(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path).pieces
        for b in batches:
            made = [b"".join([pieces[i] for i in x or ()]) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], [*b.schema.names, out])

    return df.mapInArrow(released(run), schema)


def digests(df: DataFrame, path: str, pattern: str, column: str = "text", cache_words: int = CACHE_WORDS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """df without the text, with n_tokens, ids_sha256 and decoded_sha256: encode() and decode() in one
    pass, hashing each text's ids and decoded bytes piece by piece instead of shipping them. A smaller cache and
    smaller chunks take less memory and more time."""
    rest = [c for c in df.columns if c != column]
    schema = _appended(df.select(*rest), [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for b in text_chunks(batches, column, chunk_bytes):
            words = e.words([x or "" for x in b.column(b.schema.get_field_index(column)).to_pylist()], cache_words)
            text, size = e.text, np.frombuffer(e.lengths, dtype=np.int32).copy() if len(e.lengths) else np.zeros(0, np.int32)
            used = {w for x in words for w in x}
            back = {w: e.decode(e.ids[w]) for w in used}
            n = [int(size[x].sum()) if x else 0 for x in words]
            one = [hashlib.sha256(" ".join([text[w] for w in x]).encode()).hexdigest() for x in words]
            two = [hashlib.sha256(b"".join([back[w] for w in x])).hexdigest() for x in words]
            kept = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(one), pa.array(two)], [*rest, "n_tokens", "ids_sha256", "decoded_sha256"])
        e.clear()

    return df.select(*rest, column).mapInArrow(released(run), schema)
