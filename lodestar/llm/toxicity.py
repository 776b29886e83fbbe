"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs are words, each as an embedding of the word (or of the unknown word) beside the final states
of a character network, itself a bidirectional gated recurrence over the word's bytes. A second such
recurrence reads windows of words; attention pools its states into one logit a window. A text is
scored by all of its overlapping windows; its score is the highest one's.

Training uses a bounded sample of labelled rows (``SAMPLE`` of each class, chosen by a hash of the
key): first on random windows under their text's label, then on the window that scores highest in
each text. Scoring reads every whole text. Words are runs of letters and digits, A-Z lower-cased;
those over ``PIECE`` bytes are read in pieces.

Nulls and texts without words score 0; of very long texts every window counts. Rows with a null label
are not learned from; of repeated labels the highest counts, of several texts of a sampled key the one
of the least hash; without both classes in the sample every score is 0. Repeated rows are scored like
any others; extra columns stay, and one that clashes with the score raises ValueError; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.common import Numbering, released, text_chunks, texts_of

#: Labelled rows that training uses at most: toxic ones, others.
SAMPLE = (1000, 1500)
WINDOW, STRIDE, PIECE = 32, 16, 24
VOCABULARY, EMBED, CHAR_EMBED, CHAR_STATE, STATE = 8000, 12, 8, 12, 12
CACHE_WORDS = 80_000
BLOCK = 1024
#: ASCII to lower-case letters and digits, all other ASCII to spaces; bytes beyond stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    out = text.translate(FOLD).split()
    if out and max(map(len, out)) > PIECE:
        out = [w[i : i + PIECE] for w in out for i in range(0, len(w), PIECE)]
    return out


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap and cover n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0] if n else []
    out = list(range(0, n - WINDOW, STRIDE))
    return [*out, n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """out[at[i]] += rows[i] of all i."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out[at[first]] += np.add.reduceat(rows[order], first, axis=0)


class Gru:
    """One direction over time-major gate inputs of sequences sorted by falling length; ``live[t]``
    sequences are longer than t."""

    @staticmethod
    def forward(gates, live: list[int], u: np.ndarray, b: np.ndarray, keep: bool):
        """gates(t, n): the input's share of step t for the first n sequences. Returns the states of
        every step (T, B, H), zero after a sequence's end, the final states, and what backward needs."""
        h = u.shape[0]
        last = np.zeros((live[0], h), dtype=np.float32)
        states = np.zeros((len(live), live[0], h), dtype=np.float32)
        saved = []
        for t, n in enumerate(live):
            x, old = gates(t, n), last[:n]
            r = old @ u
            r += b
            zr = _sigmoid(x[:, : 2 * h] + r[:, : 2 * h])
            c = np.tanh(x[:, 2 * h :] + zr[:, h:] * r[:, 2 * h :])
            new = c + zr[:, :h] * (old - c)
            if keep:
                saved.append((old.copy(), zr, c, r[:, 2 * h :].copy()))
            last[:n] = new
            states[t, :n] = new
        return states, last, saved

    @staticmethod
    def backward(d_states: np.ndarray, d_last: np.ndarray, saved, live: list[int], u: np.ndarray):
        """Gradients of the gate inputs of every step, of u and of b."""
        h = u.shape[0]
        du, db, dx, d = np.zeros_like(u), np.zeros(3 * h, np.float32), [None] * len(live), d_last.copy()
        for t in range(len(live) - 1, -1, -1):
            n = live[t]
            old, zr, c, rc = saved[t]
            z, r = zr[:, :h], zr[:, h:]
            g = d[:n] + d_states[t, :n]
            dc = g * (1 - z) * (1 - c * c)
            dz = g * (old - c) * z * (1 - z)
            dr = dc * rc * r * (1 - r)
            du_in = np.concatenate([dz, dr, dc * r], axis=1)
            du += old.T @ du_in
            db += du_in.sum(0)
            dx[t] = np.concatenate([dz, dr, dc], axis=1)
            d[:n] = g * z + du_in @ u.T
        return dx, du, db


def _by_length(size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    return order, [int(np.searchsorted(falling, -t, side="left")) for t in range(int(size.max()))]


class Model:
    """Parameters and passes of both recurrences and the attention."""

    def __init__(self, vocabulary: dict[bytes, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        d = 2 * CHAR_STATE + EMBED
        self.p = {"ce": mat(256, CHAR_EMBED) * 16, "we": mat(len(vocabulary) + 1, EMBED) * 0.1, "av": mat(STATE, 1), "aw": mat(2 * STATE, STATE), "ab": np.zeros(STATE, np.float32), "o": mat(2 * STATE, 1), "ob": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"cw{side}": mat(CHAR_EMBED, 3 * CHAR_STATE), f"cu{side}": mat(CHAR_STATE, 3 * CHAR_STATE), f"cb{side}": np.zeros(3 * CHAR_STATE, np.float32)}
            self.p |= {f"ww{side}": mat(d, 3 * STATE), f"wu{side}": mat(STATE, 3 * STATE), f"wb{side}": np.zeros(3 * STATE, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def features(self, words: list[bytes], keep: bool = False):
        """Vectors of words: final character states of both directions and the word's embedding."""
        p = self.p
        size = np.array([len(w) for w in words], dtype=np.int64)
        order, live = _by_length(size)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        start = (np.cumsum(size) - size)[order]
        long = size[order]
        out, saved = [], []
        for side in "fb":
            table = p["ce"] @ p[f"cw{side}"]
            chars = [raw[start[:n] + (t if side == "f" else long[:n] - 1 - t)] for t, n in enumerate(live)]
            _, last, s = Gru.forward(lambda t, n, c=chars, x=table: x[c[t]], live, p[f"cu{side}"], p[f"cb{side}"], keep)
            back = np.empty_like(last)
            back[order] = last
            out.append(back)
            saved.append((chars, s))
        ids = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        return np.concatenate([*out, p["we"][ids]], axis=1), (order, live, saved, ids)

    def _features_back(self, d: np.ndarray, kept, grad: dict) -> None:
        order, live, saved, ids = kept
        p = self.p
        _add_rows(grad["we"], ids, d[:, 2 * CHAR_STATE :])
        for k, side in enumerate("fb"):
            chars, s = saved[k]
            last = d[order, k * CHAR_STATE : (k + 1) * CHAR_STATE]
            dx, du, db = Gru.backward(np.zeros((len(live), live[0], CHAR_STATE), np.float32), last, s, live, p[f"cu{side}"])
            grad[f"cu{side}"] += du
            grad[f"cb{side}"] += db
            by_char = np.zeros((256, 3 * CHAR_STATE), np.float32)
            _add_rows(by_char, np.concatenate(chars), np.concatenate(dx))
            grad[f"cw{side}"] += p["ce"].T @ by_char
            grad["ce"] += by_char @ p[f"cw{side}"].T

    def logits(self, tables: tuple[np.ndarray, np.ndarray], index: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows: rows of word numbers (B, WINDOW) and their lengths. tables: each
        direction's gate inputs of all words."""
        p = self.p
        order, live = _by_length(size)
        index, size = index[order], size[order]
        t_max, b = len(live), len(index)
        states = np.zeros((t_max, b, 2 * STATE), np.float32)
        saved = []
        for k, side in enumerate("fb"):
            at = [index[:n, t] if side == "f" else index[np.arange(n), size[:n] - 1 - t] for t, n in enumerate(live)]
            s, _, kept = Gru.forward(lambda t, n, at=at, x=tables[k]: x[at[t]], live, p[f"wu{side}"], p[f"wb{side}"], keep)
            if side == "b":  # back to the order of the text
                for t, n in enumerate(live):
                    states[size[:n] - 1 - t, np.arange(n), STATE:] = s[t, :n]
            else:
                states[:, :, :STATE] = s
            saved.append((at, kept))
        hidden = np.tanh(states @ p["aw"] + p["ab"])
        e = (hidden @ p["av"])[:, :, 0]
        e[np.arange(t_max)[:, None] >= size[None, :]] = -np.inf
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tb,tbh->bh", a, states)
        out = np.empty(b, np.float32)
        out[order] = (pooled @ p["o"])[:, 0] + p["ob"]
        return out, (order, live, size, states, hidden, a, pooled, saved)

    def train(self, words: list[bytes], index: np.ndarray, size: np.ndarray, y: np.ndarray, rate: float) -> float:
        """One step of Adam on windows whose rows number ``words``."""
        p = self.p
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        x, kept_words = self.features(words, keep=True)
        tables = (x @ p["wwf"], x @ p["wwb"])
        z, (order, live, size, states, hidden, a, pooled, saved) = self.logits(tables, index, size, keep=True)
        q = 1 / (1 + np.exp(-z))
        g = ((q - y) / len(y)).astype(np.float32)[order]
        grad["o"] += pooled.T @ g[:, None]
        grad["ob"] += g.sum()
        dp = g[:, None] * p["o"][:, 0]
        ds = a[:, :, None] * dp[None]
        da = np.einsum("tbh,bh->tb", states, dp)
        de = a * (da - (a * da).sum(0))
        grad["av"] += np.einsum("tbh,tb->h", hidden, de)[:, None]
        dh = de[:, :, None] * p["av"][:, 0] * (1 - hidden * hidden)
        grad["aw"] += np.einsum("tbi,tbj->ij", states, dh)
        grad["ab"] += dh.sum((0, 1))
        ds += dh @ p["aw"].T
        dx = np.zeros_like(x)
        zero = np.zeros((len(order), STATE), np.float32)
        for k, side in enumerate("fb"):
            at, s = saved[k]
            d = ds[:, :, :STATE]
            if side == "b":
                d = np.zeros((len(live), len(order), STATE), np.float32)
                for t, n in enumerate(live):
                    d[t, :n] = ds[size[:n] - 1 - t, np.arange(n), STATE:]
            dg, du, db = Gru.backward(d, zero, s, live, p[f"wu{side}"])
            grad[f"wu{side}"] += du
            grad[f"wb{side}"] += db
            by_word = np.zeros((len(words), 3 * STATE), np.float32)
            _add_rows(by_word, np.concatenate(at), np.concatenate(dg))
            grad[f"ww{side}"] += x.T @ by_word
            dx += by_word @ p[f"ww{side}"].T
        self._features_back(dx, kept_words, grad)
        self.steps += 1
        for k, v in p.items():
            m, s = self.moments[k]
            m += 0.1 * (grad[k] - m)
            s += 0.002 * (grad[k] ** 2 - s)
            v -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.998**self.steps)) + 1e-7)
        return float(-np.mean(np.log(np.where(y > 0, q, 1 - q) + 1e-9)))


def fit(rows: list[tuple[list[bytes], int]], seed: int = 7, epochs: int = 6) -> Model | None:
    """A model of (words, label) rows; None if they have one class only."""
    rows = [(w, y) for w, y in rows if w]
    if len({y for _, y in rows}) < 2:
        return None
    seen = Counter(x for w, _ in rows for x in set(w))
    model = Model({w: i + 1 for i, (w, n) in enumerate(sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:VOCABULARY]) if n > 2}, seed)
    rng = np.random.default_rng(seed)
    starts = [window_starts(len(w)) for w, _ in rows]

    def step(chosen: list[tuple[int, int]], rate: float) -> float:
        number = Numbering()
        index, size = np.zeros((len(chosen), WINDOW), np.int64), np.zeros(len(chosen), np.int64)
        for i, (r, s) in enumerate(chosen):
            part = [number[w] for w in rows[r][0][s : s + WINDOW]]
            index[i, : len(part)], size[i] = part, len(part)
        y = np.array([rows[r][1] for r, _ in chosen], np.float32)
        return model.train(list(number), index, size, y, rate)

    steps = max(1, len(rows) * 3 // 128)
    rounds = max(epochs, -(-200 // steps))  # small samples go round more often
    for e in range(rounds):
        if e < rounds * 2 // 3:
            picked = [(r, s[int(k)]) for r, s in enumerate(starts) for k in rng.integers(0, len(s), 3)]
        else:
            best = _Scorer(model).highest([w for w, _ in rows])
            picked = [(r, starts[r][b]) for r, b in enumerate(best)] * 2 + [(r, s[int(rng.integers(0, len(s)))]) for r, s in enumerate(starts) if not rows[r][1]]
        picked = [picked[i] for i in rng.permutation(len(picked))]
        for i in range(0, len(picked), 128):
            step(picked[i : i + 128], 0.01 * (1 - e / rounds) + 0.001)
    model.moments = {}
    return model


class _Scorer:
    """Scores texts with a fitted model, keeping the gate inputs of the words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.number = Numbering()
        self.tables = [np.zeros((0, 3 * STATE), np.float32)] * 2

    def _meet(self) -> None:
        new = list(self.number)[len(self.tables[0]) :]
        if not new:
            return
        made: tuple[list, list] = ([], [])
        for i in range(0, len(new), 4096):
            x, _ = self.model.features(new[i : i + 4096])
            for k, side in enumerate("fb"):
                made[k].append(x @ self.model.p[f"ww{side}"])
        self.tables = [np.concatenate([self.tables[k], *made[k]]) for k in range(2)]

    def highest(self, texts: list[list[bytes]], at_once: int = 256) -> list[int]:
        """The number of the highest window of each text, given as words."""
        number, out = self.number, []
        for i in range(0, len(texts), at_once):
            codes = [[number[w] for w in words] for words in texts[i : i + at_once]]
            out += [int(np.argmax(z)) if len(z) else 0 for z in self._logits(codes)]
        return out

    def _logits(self, texts: list[list[int]]) -> list[np.ndarray]:
        self._meet()
        n = np.array([len(x) for x in texts], np.int64)
        flat = np.fromiter((i for x in texts for i in x), np.int64, int(n.sum()))
        base = np.cumsum(n) - n
        windows = [window_starts(k) for k in n.tolist()]
        count = np.array([len(x) for x in windows], np.int64)
        start = np.fromiter((s for x in windows for s in x), np.int64, int(count.sum())) + np.repeat(base, count)
        size = np.minimum(np.repeat(n, count), WINDOW)
        out = np.zeros(len(start), np.float32)
        for i in range(0, len(start), BLOCK):
            s, k = start[i : i + BLOCK], size[i : i + BLOCK]
            at = np.minimum(s[:, None] + np.arange(WINDOW), len(flat) - 1)
            out[i : i + BLOCK] = self.model.logits(tuple(self.tables), flat[at], k)[0]
        return np.split(out, np.cumsum(count)[:-1]) if len(count) else []

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHE_WORDS:
            self.clear()
        number = self.number
        codes = [[number[w] for w in words_of(x)] for x in texts]
        top = np.array([float(z.max()) if len(z) else -np.inf for z in self._logits(codes)], np.float64)
        return 1 / (1 + np.exp(-top))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: tuple[int, int] = SAMPLE) -> Model | None:
    """Fit on a bounded sample of the labelled rows. labels: key and label (0 or 1), already without
    what must not be learned from."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("y"))
    take = lambda y, n: one.where(F.col("y") == y).orderBy(F.xxhash64(key), key).limit(n)
    chosen = take(1, sample[0]).union(take(0, sample[1]))
    spark = docs.sparkSession
    chosen = spark.createDataFrame(chosen.collect(), chosen.schema)  # at most sum(sample) rows

    # one text of each sampled key, so that a repeated key does not multiply what is collected
    joined = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(F.broadcast(chosen.withColumnRenamed(key, "k")), "k")
    rows = joined.groupBy("k").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.max("y").alias("y")).collect()
    return fit([(words_of(r["t"].encode()), r["y"]) for r in sorted(rows, key=lambda r: r["k"])])


def score(docs: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the score of each whole text; a clash of names raises ValueError."""
    if out in docs.columns:
        raise ValueError(f"the input already has a column {out}; name it otherwise")
    if model is None:
        return docs.withColumn(out, F.lit(0.0))
    rest = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in text_chunks(batches, text, 2_000_000):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scorer.scores(texts_of(b, text)))], [*rest, out])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def score_ids(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text", out: str = "score") -> DataFrame:
    """Like score(), but only with the columns to keep, so that texts do not travel back."""
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for b in text_chunks(batches, text, 2_000_000):
            kept = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(scorer.scores(texts_of(b, text)))], [*keep, out])

    return docs.select(*keep, text).mapInArrow(released(run), T.StructType([*(docs.schema[c] for c in keep), T.StructField(out, T.DoubleType())]))
