"""Exact top-k by inner product with M-trees and best-first search.

Vectors x become points (x, sqrt(M^2 - |x|^2)), M the largest norm, queries (q, 0): the nearer a
point, the larger the inner product, so a metric tree answers the search exactly. Rows are dealt to
chunks by a hash of their id; every chunk's tree is built once, in pages of entries that store the
distance to their parent and, above the leaves, a covering radius, and written to the shared folder.
Blocks of queries meet every chunk and go through its tree together: pages wait in a heap by their
least possible distance to any query of the block, each with the queries that it may still serve, and
stored distances rule entries out by the triangle inequality before any is computed; what is left of a
page and its queries is one product of matrices. Bounds carry a slack over rounding; scores are
integers, compared exactly. Trees and blocks hold vectors in the least integer type that fits them.

Vectors null, empty or holding null or non-finite components take no part, nor do those of another
length than the query set's most frequent. Repeated ids are rows of their own (a query passes over
all rows of its id); ties go to the smaller id; empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import drop, materialise, released
from lodestar.llm.vectors import matrix, usable

PAGE, CHUNK_ROWS, BLOCK_QUERIES = 64, 8192, 1024


class MTree:
    """Pages: page p has the entries first[p] .. first[p+1]-1. An entry of an inner page routes to
    child[e] >= 0 with a radius; an entry of a leaf is row object[e]. to_parent[e] is the distance to
    the routing object of the page's own entry (0 in the root page, which has none)."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: float, rng=None):
        self.ids, self.x = ids, narrow(x)
        x = x.astype(np.float64)
        self.points = np.c_[x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))]
        self.most = most
        pages: list[list[tuple[int, float, float, int]]] = []
        rng = rng or np.random.default_rng(3)

        def build(rows: np.ndarray, parent: int) -> int:
            """The page of these rows below the routing object ``parent`` (-1: none)."""
            at = len(pages)
            pages.append([])
            up = self._dist(rows, parent) if parent >= 0 else np.zeros(len(rows))
            if len(rows) <= PAGE:
                pages[at] = [(int(r), float(d), 0.0, -1) for r, d in zip(rows, up, strict=True)]
                return at
            k = min(PAGE, -(-len(rows) // (PAGE * 3 // 4)))
            routing = rng.choice(rows, k, replace=False)
            near = np.argmin(((self.points[rows] ** 2).sum(1)[:, None] - 2 * self.points[rows] @ self.points[routing].T + (self.points[routing] ** 2).sum(1)[None]), axis=1)
            groups = [rows[near == g] for g in range(k)]
            if max(map(len, groups)) == len(rows):  # equal points: nothing to tell them apart
                groups = np.array_split(rows, k)
            entries = []
            for g, part in enumerate(groups):
                if len(part):
                    o = int(routing[g])
                    entries.append((o, float(self._dist(np.array([o]), parent)[0]) if parent >= 0 else 0.0, float(self._dist(part, o).max()), build(part, o)))
            pages[at] = entries
            return at

        if len(ids):
            build(np.arange(len(ids)), -1)
        flat = [e for p in pages for e in p]
        self.first = np.cumsum([0, *map(len, pages)])
        self.object, self.child = (np.array([e[i] for e in flat], np.int64) for i in (0, 3))
        self.to_parent, self.radius = (np.array([e[i] for e in flat], np.float64) for i in (1, 2))

    def _dist(self, rows: np.ndarray, one: int) -> np.ndarray:
        d = self.points[rows] - self.points[one]
        return np.sqrt((d * d).sum(1))

    def top(self, q: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best rows of each query but those of its own id: query (its row in q), score, id; best first."""
        n = len(q)
        if not n or not len(self.ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        # no partial sum of an inner product passes the largest norm, so doubles are exact below 2^53
        exact = self.most < 2**53
        points, x = q.astype(np.float64), self.x.astype(np.float64)
        asked, rows, none = (points, x, -np.inf) if exact else (q.astype(np.int64), self.x.astype(np.int64), np.iinfo(np.int64).min)
        norm = (points * points).sum(1) + self.most
        slack = 1e-6 * (1 + np.sqrt(norm))
        score, ids = np.full((n, k), none), np.full((n, k), np.iinfo(np.int64).max)  # best first; what is not found yet last
        reach = np.full(n, np.inf)
        every = np.arange(n)
        # least distance of any query, order, page, its queries, their least distances and those to its routing object
        heap = [(0.0, 0, 0, every, np.zeros(n), None)]
        pushed = 0
        while heap and heap[0][0] <= reach.max():
            _, _, page, who, least, up = heapq.heappop(heap)
            near = least <= reach[who]
            who = who[near]
            if not len(who):
                continue
            e = np.arange(self.first[page], self.first[page + 1])
            if up is not None:  # entries that the stored distances rule out for all of these queries
                up, far = up[near], reach[who].max() + self.radius[e]
                e = e[(self.to_parent[e] - up.max() <= far) & (up.min() - self.to_parent[e] <= far)]
                if not len(e):
                    continue
            o = self.object[e]
            if self.child[e[0]] >= 0:
                d = np.sqrt(np.maximum(0.0, norm[who] - 2 * (x[o] @ points[who].T)))
                least = np.maximum(0.0, d - self.radius[e][:, None] - slack[who])
                some = least <= reach[who]
                for i in np.flatnonzero(some.any(1)).tolist():
                    pushed += 1
                    at = some[i]
                    heapq.heappush(heap, (float(least[i, at].min()), pushed, int(self.child[e[i]]), who[at], least[i, at], d[i, at]))
                continue
            s = asked[who] @ rows[o].T
            a, b = np.nonzero(s >= score[who, -1][:, None])
            found, w, v = s[a, b], who[a], self.ids[o[b]]
            fine = ((found > score[w, -1]) | (v < ids[w, -1])) & (v != own[w])
            if not fine.any():
                continue
            found, w, v = found[fine], w[fine], v[fine]
            met = np.unique(w)
            w, found, v = np.r_[w, np.repeat(met, k)], np.r_[found, score[met].ravel()], np.r_[v, ids[met].ravel()]
            order = np.lexsort((v, -found if exact else np.bitwise_not(found), w))
            first = np.searchsorted(w[order], met)
            order = order[(first[:, None] + np.arange(k)).ravel()]
            score[met], ids[met] = found[order].reshape(-1, k), v[order].reshape(-1, k)
            kth = score[met, -1]
            full = kth != none
            reach[met[full]] = np.sqrt(np.maximum(0.0, norm[met[full]] - 2 * kth[full].astype(np.float64))) + slack[met[full]]
        there = score != none
        return np.repeat(every, there.sum(1)), score[there].astype(np.int64), ids[there]

    def pack(self) -> bytes:
        head = np.array([*self.x.shape, self.x.itemsize, len(self.object), len(self.first)], np.int64)
        return b"".join(a.tobytes() for a in (head, np.array([self.most]), self.ids, self.object, self.child, self.to_parent, self.radius, self.first.astype(np.int64), self.x))

    @classmethod
    def unpack(cls, raw: bytes) -> MTree:
        """A tree to search; points served to build it only."""
        self = cls.__new__(cls)
        n, d, size, e, p = np.frombuffer(raw, np.int64, 5).tolist()
        self.most = float(np.frombuffer(raw, np.float64, 1, 40)[0])
        at = 48
        for name, kind, count in (("ids", np.int64, n), ("object", np.int64, e), ("child", np.int64, e), ("to_parent", np.float64, e), ("radius", np.float64, e), ("first", np.int64, p)):
            setattr(self, name, np.frombuffer(raw, kind, count, at))
            at += 8 * count
        self.x = np.frombuffer(raw, f"i{size}", n * d, at).reshape(n, d)
        return self


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the least type that holds them all."""
    lo, hi = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return x.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max))


def pack_queries(ids: np.ndarray, x: np.ndarray) -> bytes:
    x = narrow(x)
    return np.array([*x.shape, x.itemsize], np.int64).tobytes() + ids.tobytes() + x.tobytes()


def unpack_queries(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, d, size = np.frombuffer(raw, np.int64, 3).tolist()
    return np.frombuffer(raw, np.int64, n, 24), np.frombuffer(raw, f"i{size}", n * d, 24 + 8 * n).reshape(n, d)


def _packs(batches: Iterator[pa.RecordBatch], rows: int, make) -> Iterator[pa.RecordBatch]:
    """Gather runs of equal first column, up to ``rows`` each (a fuller run goes on in another), and
    pack each by make(ids, matrix)."""
    now, ids, parts = None, [], []

    def close():
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([make(np.concatenate(ids), np.concatenate(parts))], pa.binary())], ["part", "blob"])

    for b in batches:
        part = b.column(0).to_numpy()
        cuts = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1, len(part)]
        key, x = b.column(1).to_numpy(), matrix(b.column(2)) if len(part) else None
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            for i in range(a, z, rows):
                j = min(z, i + rows)
                if now != part[i] or sum(map(len, ids)) + j - i > rows:
                    yield from close()
                    now, ids, parts = int(part[i]), [], []
                ids.append(key[i:j])
                parts.append(x[i:j])
    yield from close()


def top_k(spark: SparkSession, df: DataFrame, key: str, vector: str, every: int = 50, k: int = 5, scale: int = 256, chunk_rows: int = CHUNK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(scale * x) for
    every row whose key is divisible by ``every``, against all other rows."""
    rows = usable(df, key, vector).select("key", F.transform("v", lambda x: F.floor(x * scale)).alias("v"))
    is_query = F.col("key") % every == 0
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("most"))
    best = dims.orderBy(F.desc("q"), F.desc("n"), "d").first()
    if best is None:
        best = (0, 0, 0, 0.0)
    dim, n, q, most = best
    rows = rows.where(F.size("v") == dim)
    chunks, blocks = max(1, -(-n // chunk_rows)), max(1, -(-q // block_queries))
    dealt = lambda d, m: d.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(m))).select("part", "key", "v")
    by_part = lambda d, m: d.repartition(m, "part").sortWithinPartitions("part", "key")
    trees = by_part(dealt(rows, chunks), chunks).mapInArrow(released(lambda it: _packs(it, 2 * chunk_rows, lambda i, x: MTree(i, x, float(most)).pack())), "part long, blob binary")
    trees, p_trees = materialise(spark, trees, "mtree-pages")
    queries = by_part(dealt(rows.where(is_query), blocks), blocks).mapInArrow(lambda it: _packs(it, block_queries, pack_queries), "part long, blob binary")
    queries, p_queries = materialise(spark, queries, "mtree-queries")
    sent = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("part"), F.lit(1).alias("kind"), "blob")
    # a part's trees come first and stay while its blocks of queries pass, so no row holds both
    met = trees.select("part", F.lit(0).alias("kind"), "blob").union(sent).repartition(chunks, "part").sortWithinPartitions("part", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, []
        for b in batches:
            for part, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if part != now:
                    now, trees = part, []
                if kind == 0:
                    trees.append(MTree.unpack(blob.as_py()))
                    continue
                ids, x = unpack_queries(blob.as_py())
                for tree in trees:
                    q, s, v = tree.top(x, ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    found = met.mapInArrow(released(search), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    out = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out, _ = materialise(spark, out, "mtree-result")
    drop(spark, p_trees, p_queries)
    return out
