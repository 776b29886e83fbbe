"""Token counts by a linear longest-match automaton.

The vocabulary lies in a trie. Every node has a failure link and the number of tokens that following
the link pops, both worked out once; a word then takes one step for each byte, and its greedy
longest-match length is the sum of the pops. No piece is ever built. All distinct words of a block
walk the trie together, one byte position at a time.

A word that some byte outside the vocabulary keeps from being covered counts as one unknown token.
Nulls and empty texts have no words. Repeated rows count alike; extra columns stay.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestar.llm.common import Numbering, ragged, released, text_chunks, texts_of

CACHE_WORDS = 250_000


class LongestMatch:
    """Trie with failure links over byte tokens. root 0 starts a word, ``inner`` goes on within it;
    both are one node unless inner tokens are marked by a prefix such as ``##``."""

    def __init__(self, tokens: list[bytes], inner_mark: bytes = b"", ids: list[int] | None = None):
        child: dict[tuple[int, int], int] = {}
        parent, via, token, depth = [-1], [-1], [False], [0]

        def insert(at: int, word: bytes) -> int:
            for c in word:
                to = child.get((at, c))
                if to is None:
                    to = child[at, c] = len(parent)
                    parent.append(at)
                    via.append(c)
                    token.append(False)
                    depth.append(depth[at] + 1)
                at = to
            return at

        self.inner = insert(0, inner_mark)
        name: dict[int, int] = {}
        for i, t in enumerate(tokens):
            if t and t != inner_mark:
                at = insert(0, t)
                token[at] = True
                name[at] = ids[i] if ids else i
        n = len(parent)
        fail, pops = [-1] * n, [0] * n
        popped: list[tuple[int, ...]] = [()] * n
        for v in sorted(range(1, n), key=depth.__getitem__):
            if v == self.inner:
                continue
            if token[v]:
                fail[v], pops[v], popped[v] = self.inner, 1, (name[v],)
                continue
            z, f = fail[parent[v]], popped[parent[v]]
            while z >= 0 and (z, via[v]) not in child:
                f += popped[z]
                z = fail[z]
            if z >= 0:
                fail[v], pops[v], popped[v] = child[z, via[v]], len(f), f
        self.fail, self.pops = np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int32)
        self.popped = np.fromiter((t for f in popped for t in f), np.int32)
        self.popped_at = np.cumsum(self.pops) - self.pops
        keys = np.array([a * 256 + c for a, c in child], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.to = np.append(np.array(list(child.values()), dtype=np.int32)[order], -1)

    def _walk(self, words: list[bytes], seen=None) -> np.ndarray:
        """Tokens of each word; seen(words, nodes), if given, is told of all pops in their order."""
        size = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        raw = np.frombuffer(b"".join([words[i] for i in order]), dtype=np.uint8)
        start = np.cumsum(size) - size
        state, count = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)

        def pop(at: np.ndarray) -> None:
            count[at] += self.pops[state[at]]
            if seen:
                seen(order[at], state[at])
            state[at] = self.fail[state[at]]

        for j in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -j, side="left"))  # words longer than j
            at = np.flatnonzero(state[:live] >= 0)
            c = raw[start[at] + j].astype(np.int64)
            while len(at):
                key = state[at] * 256 + c
                k = np.searchsorted(self.keys, key)
                found = self.keys[k] == key
                state[at[found]] = self.to[k[found]]
                at, c = at[~found], c[~found]
                pop(at)
                going = state[at] >= 0
                at, c = at[going], c[going]
        at = np.flatnonzero((state >= 0) & (state != self.inner) & (size > 0))
        while len(at):
            pop(at)
            at = at[(state[at] >= 0) & (state[at] != self.inner)]
        count[(state < 0)] = 1
        out = np.zeros(len(words), dtype=np.int64)
        out[order] = count
        return out

    def lengths(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word by greedy longest match; 1 for a word that cannot be covered, 0 for an
        empty one."""
        return self._walk(words)

    def pieces(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the tokens of all words, one after another, and how many each word has. All words
        must be coverable, as they are where every byte is a token."""
        who, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = self._walk(words, lambda w, v: (who.append(w), nodes.append(v)))
        w, v = np.concatenate(who), np.concatenate(nodes)
        v = v[np.argsort(w, kind="stable")]
        return self.popped[ragged(self.popped_at[v], self.pops[v].astype(np.int64))], size


@cache
def load(path: str) -> LongestMatch:
    with open(path, "rb") as f:
        rows = [x.split() for x in f if x.strip()]
        return LongestMatch([base64.b64decode(a) for a, _ in rows], ids=[int(b) for _, b in rows])


@cache
def _tokens(path: str) -> dict[int, bytes]:
    with open(path, "rb") as f:
        return {int(b): base64.b64decode(a) for a, b in (x.split() for x in f if x.strip())}


def ids(path: str) -> int:
    """One more than the largest id of a vocabulary."""
    return max(_tokens(path)) + 1


def starts(path: str, before: bytes) -> np.ndarray:
    """For each id, and one beyond, whether its token begins with ``before``; the one beyond does."""
    tokens = _tokens(path)
    return np.array([tokens.get(i, before).startswith(before) for i in range(ids(path) + 1)])


class _Known:
    """Lengths of the words that a worker has met."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton
        self.clear()

    def clear(self) -> None:
        self.number, self.size = Numbering(), np.zeros(0, dtype=np.int64)

    def counts(self, texts: list[bytes], before: bytes) -> tuple[list[int], list[int]]:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        number = self.number
        codes = [[number[w] for w in x.split()] for x in texts]
        if len(number) > len(self.size):
            new = [before + w for w in list(number)[len(self.size) :]]
            self.size = np.append(self.size, self.automaton.lengths(new))
        return [len(x) for x in codes], [int(self.size[x].sum()) if x else 0 for x in codes]


@cache
def _known(path: str) -> _Known:
    return _Known(load(path))


def count_tokens(df: DataFrame, path: str, column: str = "text", before: bytes = b" ", words: str = "n_words", tokens: str = "n_tokens") -> DataFrame:
    """df without its text but with the number of words (runs of anything but ASCII white space) and
    of greedy longest-match tokens, each word led by ``before``. The text itself is dropped so that
    it does not travel back; join on the key for it."""
    rest = [c for c in df.columns if c != column]
    if {words, tokens} & set(rest):
        raise ValueError(f"the input already has a column {words} or {tokens}; name them otherwise")
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(words, T.LongType()), T.StructField(tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(path)
        for b in text_chunks(batches, column):
            n, m = known.counts(texts_of(b, column), before)
            kept = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n, pa.int64()), pa.array(m, pa.int64())], [*rest, words, tokens])
        known.clear()

    return df.select(*rest, column).mapInArrow(released(run), schema)
