"""A causal self-attention model over subword ids, in numpy.

A token is predicted as a group of classes, then a class of the group, then an id of the class.
Frequent ids are classes of their own, the others share classes by frequency and by whether they
begin a word; within a class, ids go by their counts in the corpus. The logits of groups and of a
group's classes are a table of the previous id, counted over the corpus, plus what one attention
layer over the window gives, so a token costs two small softmaxes.
Windows overlap: each token is scored once, by the window that sees the most of what lies before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Inputs of a window, and those of them that only give context (but in a text's first window).
WINDOW, CONTEXT = 32, 6
WIDTH, HIDDEN, GROUPS, MEMBERS, SHARED = 16, 24, 32, 32, 64
OWN = GROUPS * MEMBERS - SHARED
INPUTS, BUCKETS = 6000, 64
#: Windows scored at once.
BLOCK = 512
#: Windows of a step, and its rate, where all documents are learned from.
LEARN, RATE = 512, 0.001
#: Scores that stay within it need no maximum taken off before their exponentials, in single precision.
SAFE = 60.0
_ONES = np.ones((32, 1), np.float32)  # WINDOW, GROUPS and MEMBERS are this many


class Attention:
    """ids are 0 .. size-1, of which the last one ends a text; ``initial`` marks ids that begin a
    word. counts: how often the corpus has each id."""

    def __init__(self, counts: np.ndarray, initial: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.size = len(counts)
        order = np.lexsort((np.arange(self.size), -counts))
        self.cls = np.zeros(self.size, np.int32)
        top = order[:OWN]
        self.cls[top[np.lexsort((np.arange(len(top)), initial[top]))]] = np.arange(len(top))
        for half, kind in enumerate((False, True)):
            rest = order[OWN:][initial[order[OWN:]] == kind]
            mass = np.cumsum(counts[rest] + 0.1)
            band = np.minimum((mass / mass[-1] * (SHARED // 2)).astype(np.int32), SHARED // 2 - 1) if len(rest) else np.zeros(0, np.int32)
            self.cls[rest] = OWN + half * (SHARED // 2) + band
        self.classes = OWN + SHARED
        soft = counts + 0.1
        self.within = np.log(soft / np.bincount(self.cls, weights=soft, minlength=self.classes)[self.cls]).astype(np.float32)
        self.input = np.full(self.size + 1, INPUTS, np.int32)  # the last is the begin of a text
        self.input[order] = np.where(np.arange(self.size) < INPUTS, np.arange(self.size), INPUTS + order % BUCKETS)
        self.input[self.size] = INPUTS + BUCKETS
        n = INPUTS + BUCKETS + 1
        mat = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"e": mat(n, WIDTH) * np.sqrt(n).astype(np.float32) * 0.5, "pos": mat(WINDOW, WIDTH), "q": mat(WIDTH, WIDTH), "k": mat(WIDTH, WIDTH), "v": mat(WIDTH, WIDTH), "o": mat(WIDTH, HIDDEN), "s": mat(WIDTH, HIDDEN), "ob": np.zeros(HIDDEN, np.float32), "c": mat(HIDDEN, GROUPS) * np.float32(0.1), "d": np.concatenate([mat(HIDDEN, MEMBERS)[None] for _ in range(GROUPS)]) * np.float32(0.1), "table": np.zeros((n, GROUPS), np.float32), "below": np.zeros((n * GROUPS, MEMBERS), np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items() if k not in ("table", "below")}
        self.steps = 0
        self.large = True
        self.mask = np.where(np.tri(WINDOW, dtype=bool), 0, -1e9).astype(np.float32)

    def count(self, pairs: np.ndarray) -> None:
        """The tables: smoothed log frequencies of groups and classes after each input. pairs: how
        often the corpus has each class after each input."""
        pair = pairs.reshape(len(self.p["table"]), self.classes).astype(np.float32)
        base = pair.sum(0, dtype=np.float64).astype(np.float32) + np.float32(0.5)
        pair += 8 * base / base.sum()
        groups = pair.reshape(len(pair), GROUPS, MEMBERS).sum(2)
        self.p["table"] = np.log(groups / groups.sum(1, keepdims=True))
        self.p["below"] = np.log(pair.reshape(-1, MEMBERS) / groups.reshape(-1, 1))

    def _tables(self):
        """Each input's query, key and value side by side, the positions' queries and keys, and each input's direct path."""
        p, scale = self.p, np.float32(1 / np.sqrt(WIDTH))
        pos = np.concatenate([p["pos"] @ p["q"] * scale, p["pos"] @ p["k"], np.zeros_like(p["pos"])], 1)
        return p["e"] @ np.concatenate([p["q"] * scale, p["k"], p["v"]], 1), pos, p["e"] @ p["s"] + p["ob"]

    def _bound(self, tables) -> None:
        """Whether exponentials need their maximum taken off."""
        of, pos = tables[0], tables[1]
        q, k, qp, kp = (float(np.sqrt(np.einsum("ij,ij->i", x, x).max())) for x in (of[:, :WIDTH], of[:, WIDTH : 2 * WIDTH], pos[:, :WIDTH], pos[:, WIDTH:]))
        # hidden values are within -1 .. 1, and each row of the tables sums to one before its logarithm
        shift = max(float(np.abs(self.p["c"]).sum(0).max()), float(np.abs(self.p["d"]).sum(1).max()))
        self.large = not max((q + qp) * (k + kp), shift) <= SAFE

    def prepare(self) -> None:
        """Work out the tables that scoring uses."""
        self.moments = {}
        self.ready = self._tables()
        self._bound(self.ready)

    def _attend(self, x: np.ndarray, tables):
        """Of windows of inputs: queries, keys and values, the weights, and what they gather."""
        of = tables[0].take(x.ravel(), 0).reshape(*x.shape, 3 * WIDTH)
        of += tables[1]
        a = of[:, :, :WIDTH] @ of[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)
        a += self.mask
        if self.large:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        a *= 1 / (a @ _ONES)
        return of, a, (a @ of[:, :, 2 * WIDTH :]).reshape(-1, WIDTH)

    def _by_group(self, cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of class targets by their groups, and each group with its part of that order."""
        group = (cls // MEMBERS).astype(np.uint8)
        cut = np.r_[0, np.cumsum(np.bincount(group, minlength=GROUPS))].tolist()
        return np.argsort(group, kind="stable"), [(g, cut[g], cut[g + 1]) for g in range(GROUPS) if cut[g + 1] > cut[g]]

    def _soft(self, z: np.ndarray, target) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials in place of logits; the logits at target, and the sums of the exponentials."""
        if self.large:
            z -= z.max(1, keepdims=True)
        at = z[target].copy()
        np.exp(z, out=z)
        return at, z @ _ONES[:, 0]

    def score(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each sequence of ids; 0 for an empty one."""
        out = np.zeros(len(sequences))
        n = np.array([len(x) for x in sequences], np.int64)
        if n.sum():
            some = n > 0
            out[some] = self.score_joined(np.concatenate(sequences), (np.cumsum(n) - n)[some])
        return out

    def score_joined(self, target: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The same of sequences one after another, none of them empty; base: where each begins."""
        n = np.diff(np.r_[base, len(target)])
        out = np.zeros(len(n))
        inputs = np.empty(len(target), np.int64)
        inputs[1:] = target[:-1]
        inputs[base] = self.size
        inputs = self.input[inputs]
        step = WINDOW - CONTEXT
        count = 1 + np.maximum(0, -(-(n - WINDOW) // step))
        owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = base[owner] + k * step
        end = (base + n)[owner]
        for i in range(0, len(start), BLOCK):
            s, e, f = start[i : i + BLOCK], end[i : i + BLOCK], k[i : i + BLOCK]
            at = s[:, None] + np.arange(WINDOW)
            x = inputs.take(at, mode="clip")
            c = self._attend(x, self.ready)[2]
            scored = np.flatnonzero((at < e[:, None]) & ((np.arange(WINDOW) >= CONTEXT) | (f == 0)[:, None]))
            y = target[at.ravel()[scored]]
            cls = self.cls[y]
            order, parts = self._by_group(cls)
            scored, cls = scored[order], cls[order]
            x, member = x.ravel()[scored], cls % MEMBERS
            h = c.take(scored, 0) @ self.p["o"]
            h += self.ready[2].take(x, 0)
            np.tanh(h, out=h)
            logp = self.within[y[order]]
            for g, l, r in parts:
                z = h[l:r] @ self.p["c"]
                z += self.p["table"].take(x[l:r], 0)
                one, total = self._soft(z, (slice(None), g))
                logp[l:r] += one - np.log(total)
                np.matmul(h[l:r], self.p["d"][g], out=z)
                z += self.p["below"].take(x[l:r] * GROUPS + g, 0)
                one, total = self._soft(z, (np.arange(r - l), member[l:r]))
                logp[l:r] += one - np.log(total)
            out += np.bincount(owner[i : i + BLOCK][scored // WINDOW], weights=logp, minlength=len(n))
        return out / np.log(10)

    def windows(self, target: np.ndarray, base: np.ndarray, order) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Batches of inputs, class targets and a mask for sequences one after another, none of them empty; base: where
        each begins. They are the windows that scoring sees, and the mask takes each token once. order: of n windows."""
        n = np.diff(np.r_[base, len(target)])
        before = np.r_[self.size, target[:-1]]
        before[base] = self.size
        inputs, cls = self.input[before], self.cls[target]
        count = 1 + np.maximum(0, -(-(n - WINDOW) // (WINDOW - CONTEXT)))
        owner = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        chosen = order(len(owner))
        for i in range(0, len(chosen), LEARN):
            w = chosen[i : i + LEARN]
            at = (base[owner[w]] + k[w] * (WINDOW - CONTEXT))[:, None] + np.arange(WINDOW)
            live = (at < (base + n)[owner[w]][:, None]) & ((np.arange(WINDOW) >= CONTEXT) | (k[w] == 0)[:, None])
            at = np.minimum(at, len(target) - 1)
            yield inputs[at], cls[at], live

    def copy(self) -> Attention:
        """The same model to train further; the counted tables are shared."""
        out = Attention.__new__(Attention)
        out.__dict__ |= self.__dict__
        out.p = {k: v if k in ("table", "below") else v.copy() for k, v in self.p.items()}
        out.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in out.p.items() if k not in ("table", "below")}
        out.steps, out.seen, out.ready = 0, np.zeros(len(out.p["e"]), np.int64), None
        return out

    def sums(self) -> np.ndarray:
        """The trained weights times the tokens seen, rows of inputs times the times that each was seen, and these numbers."""
        tokens = float(self.seen.sum())
        rest = [self.p[k].ravel() * tokens for k in sorted(self.p) if k not in ("table", "below", "e")]
        return np.concatenate([(self.p["e"] * self.seen[:, None].astype(np.float64)).ravel(), self.seen, *rest, [tokens]])

    def mean(self, sums: np.ndarray) -> None:
        """Take the means that sums() of several copies, added up, give; inputs that none saw stay."""
        rows, at = len(self.p["e"]), self.p["e"].size
        seen, tokens = sums[at : at + rows], sums[-1]
        if not tokens:
            return
        some = seen > 0
        self.p["e"][some] = sums[:at].reshape(rows, -1)[some] / seen[some, None]
        at += rows
        for k in sorted(self.p):
            if k not in ("table", "below", "e"):
                v = self.p[k]
                self.p[k] = (sums[at : at + v.size] / tokens).reshape(v.shape).astype(np.float32)
                at += v.size

    def train(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, rate: float) -> float:
        """One step of Adam on windows of inputs x, class targets y and a mask; the tables stay as counted."""
        p, scale = self.p, np.float32(1 / np.sqrt(WIDTH))
        tables = self._tables()
        if self.steps % 8 == 0:  # a few steps change little beside what SAFE leaves
            self._bound(tables)
        of, a, c = self._attend(x, tables)
        flat, at = x.ravel(), np.flatnonzero(live)
        n = np.float32(len(at))
        order, parts = self._by_group(y.ravel()[at])
        at = at[order]
        member, xs, cs = y.ravel()[at] % MEMBERS, flat[at], c.take(at, 0)
        h = cs @ p["o"]
        h += tables[2].take(xs, 0)
        np.tanh(h, out=h)
        g = {k: np.zeros_like(p[k]) for k in ("c", "d")}
        dh, right, sums = np.empty_like(h), np.empty((2, len(h)), np.float32), np.empty((2, len(h)), np.float32)
        for k, l, r in parts:
            hs, every = h[l:r], (np.arange(r - l), member[l:r])
            z = hs @ p["c"]
            z += p["table"].take(xs[l:r], 0)
            right[0, l:r], sums[0, l:r] = self._soft(z, (slice(None), k))
            z *= (1 / sums[0, l:r])[:, None]
            z[:, k] -= 1
            g["c"] += hs.T @ z
            np.matmul(z, p["c"].T, out=dh[l:r])
            np.matmul(hs, p["d"][k], out=z)
            z += p["below"].take(xs[l:r] * GROUPS + k, 0)
            right[1, l:r], sums[1, l:r] = self._soft(z, every)
            z *= (1 / sums[1, l:r])[:, None]
            z[every] -= 1
            np.matmul(hs.T, z, out=g["d"][k])
            dh[l:r] += z @ p["d"][k].T
        loss = float((np.log(sums) - right).sum(dtype=np.float64))
        h *= h
        np.subtract(1, h, out=h)
        dh *= h
        g["o"], g["ob"] = cs.T @ dh, dh.sum(0)
        both = np.zeros((len(flat), 2 * WIDTH), np.float32)  # of what attention gathers, and of the direct path
        both[at] = dh @ np.concatenate([p["o"], p["s"]]).T
        own = np.einsum("ij,ij->i", c, both[:, :WIDTH]).reshape(*x.shape, 1)
        dc, q, k, v = both.reshape(*x.shape, -1)[:, :, :WIDTH], of[:, :, :WIDTH], of[:, :, WIDTH : 2 * WIDTH], of[:, :, 2 * WIDTH :]
        d = np.empty_like(of)
        np.matmul(a.transpose(0, 2, 1), dc, out=d[:, :, 2 * WIDTH :])
        da = dc @ v.transpose(0, 2, 1)
        da -= own
        da *= a
        np.matmul(da, k, out=d[:, :, :WIDTH])
        np.matmul(da.transpose(0, 2, 1), q, out=d[:, :, WIDTH : 2 * WIDTH])
        # the scale belongs to the weights of queries; those that keys meet carry it already
        of = np.concatenate([p["q"] * scale, p["k"], p["v"]], 1)
        places = d.sum(0)
        d = d.reshape(len(flat), -1)
        every = p["e"].take(flat, 0).T @ d + p["pos"].T @ (places * (np.arange(3 * WIDTH) < 2 * WIDTH))
        every[:, :WIDTH] *= scale
        g["q"], g["k"], g["v"] = np.split(every, 3, 1)
        g["s"], g["pos"] = p["e"].take(xs, 0).T @ dh, places[:, : 2 * WIDTH] @ of[:, : 2 * WIDTH].T
        de = d @ of.T
        de += both[:, WIDTH:]
        order = np.argsort(flat.astype(np.uint16), kind="stable")
        flat = flat[order]
        first = np.flatnonzero(np.diff(flat, prepend=-1))
        self.steps += 1
        self._adam("e", np.add.reduceat(de.take(order, 0), first, axis=0) / n, rate, flat[first])
        for name, value in g.items():
            self._adam(name, value / n, rate)
        return loss / float(n)

    def _adam(self, name: str, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        m, s = self.moments[name]
        m[rows] = one = 0.9 * m[rows] + 0.1 * grad
        s[rows] = two = 0.99 * s[rows] + 0.01 * grad * grad
        self.p[name][rows] -= rate / (1 - 0.9**self.steps) * one / (np.sqrt(two / (1 - 0.99**self.steps)) + 1e-8)


def fit(model: Attention, pairs: np.ndarray, sequences: list[np.ndarray], steps: int = 900, batch: int = 64, seed: int = 5) -> Attention:
    """The model with tables by the corpus's pairs and the attention layer fitted around them on sequences."""
    model.count(pairs)
    sequences = [x for x in sequences if len(x)]
    if sequences:
        rng = np.random.default_rng(seed)
        windows = [(i, s) for i, x in enumerate(sequences) for s in range(0, max(1, len(x) - WINDOW // 2), WINDOW // 2)]
        for step in range(steps):
            chosen = rng.integers(0, len(windows), batch)
            x, y, live = np.full((batch, WINDOW), model.size, np.int64), np.zeros((batch, WINDOW), np.int64), np.zeros((batch, WINDOW), bool)
            for r, w in enumerate(chosen.tolist()):
                i, s = windows[w]
                part = sequences[i][s : s + WINDOW]
                n = len(part)
                y[r, :n], live[r, :n] = part, True
                x[r, 1:n] = part[: n - 1]
                x[r, 0] = sequences[i][s - 1] if s else model.size
            model.train(model.input[x], model.cls[y], live, 0.004 * (1 - step / steps) + 0.0002)
    model.prepare()
    return model
