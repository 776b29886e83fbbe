"""N-gram Jaccard join: T-occurrence search over inverted lists, by DivideSkip.

Two sets link when 100 * overlap >= percent * union; both then share at least T = percent/100 of the
larger set. A set's inverted lists are divided by length: the long ones (the most frequent shingles)
are never merged, only probed for candidates; the short ones are merged to find candidates, which
must occur on them as often as T less the number of long lists.

1. ``_scan`` shingles every text. Of each set the part that comes first in hash order (an l-prefix)
   goes to shards, packed; a shingle that several sets of a block share is settled there and leaves
   only a marker, so a very common shingle is a few rows however many documents hold it. A set whose
   prefix meets too few shared shingles cannot link with anything and leaves.
2. For the rest, exact list lengths order each set from rare to frequent; sets with fewer than T
   shared shingles leave. Sets of equal size and equal shared shingles have the same links and go on
   as one class.
3. Two sets that link share one of the |R|-T+1 rarest shingles of each; components over these lists
   are buckets, outside which nothing links. A bucket of more than ``UNIT_SHINGLES`` shingles is cut
   into blocks by hash, and each pair of blocks is a unit of work.
4. In a unit, every set searches an inverted index of the sets that none has reached yet: short lists
   are merged through a heap that skips by bisection, for candidates on at least T less the number of
   long lists; the long lists are then probed by bisection, and sets that reach the overlap leave the
   index. A group of m like sets is reached by a few searches; the links that come out are a star a
   component, never all pairs.

Equal sets are one set throughout (64-bit fingerprints). Null and empty texts have no shingles and
link with nothing; rows with a null key get their n_shingles and no component; repeated rows and keys
are rows of their own; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, materialise, mix64, Numbering, ragged, released, small, text_chunks, texts_of
from lodestar.llm.components import components

#: Part of a set by which its prefix is longer than one occurrence would ask for.
EXTRA = 8
#: Prefix shingles that a task packs at once.
FLUSH = 400_000
#: Weight of a list's length when lists are divided into long and short.
MU = 0.0085
#: Shared shingles of a block of sets; two blocks are searched at once.
UNIT_SHINGLES = 1_000_000
#: Parts into which the sets of a component are dealt.
SALTS = 16


def merge_skip(lists: list[list[int]], need: int) -> tuple[list[int], list[int]]:
    """Ids that occur on at least ``need`` of the sorted lists, and their counts: a heap of the lists'
    heads; where the smallest head occurs too seldom, need - 1 heads are taken off and skip by
    bisection to the next head left."""
    place = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    ids, counts = [], []
    while len(heap) >= need:
        top, off = heap[0][0], []
        while heap and heap[0][0] == top:
            off.append(heapq.heappop(heap)[1])
        if len(off) >= need:
            ids.append(top)
            counts.append(len(off))
            for i in off:
                place[i] += 1
        else:
            while heap and len(off) < need - 1:
                off.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
            for i in off:
                place[i] = bisect_left(lists[i], to, place[i])
        for i in off:
            if place[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][place[i]], i))
    return ids, counts


def divide(count: int, need: int, longest: int) -> int:
    """How many of ``count`` lists are long, and probed instead of merged, when ``need`` occurrences are
    asked for: more of them the shorter the longest list is."""
    return min(count - 1, need - 1, int(need / (MU * np.log2(max(longest, 2)) + 1)))


class Unit:
    """Sets with an inverted index of those not yet reached, searched by DivideSkip."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray, n: np.ndarray, percent: int):
        self.n, self.percent, self.base = n, percent, np.cumsum(lengths) - lengths
        self.lengths, self.owner = lengths, np.repeat(np.arange(len(n)), lengths)
        self.tokens, self.codes = np.unique(values, return_inverse=True)
        self.left = np.ones(len(n), dtype=bool)
        self.merged = 0
        self._index()

    def _index(self) -> None:
        kept = self.left[self.owner]
        codes, owner = self.codes[kept], self.owner[kept]
        self.who = owner[np.argsort(codes, kind="stable")]
        self.cut = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(self.tokens)))]
        self.indexed = int(self.left.sum())

    def search(self, r: int) -> np.ndarray:
        """The sets not yet reached that link with set r."""
        codes = self.codes[self.base[r] : self.base[r] + self.lengths[r]]
        size = self.cut[codes + 1] - self.cut[codes]
        codes, size = codes[size > 0], size[size > 0]
        need = int(_required(self.n[r], self.percent))
        if len(codes) < need:
            return np.zeros(0, dtype=np.int64)
        codes = codes[np.argsort(size, kind="stable")]
        lists = [self.who[self.cut[c] : self.cut[c + 1]] for c in codes.tolist()]
        long = divide(len(lists), need, int(size.max()))
        short = [x.tolist() for x in lists[: len(lists) - long]]
        self.merged += sum(map(len, short))
        ids, both = (np.array(x, dtype=np.int64) for x in merge_skip(short, need - long))
        alive = self.left[ids]
        ids, both = ids[alive], both[alive]
        for x in lists[len(lists) - long :] if len(ids) else ():
            at = np.minimum(np.searchsorted(x, ids), len(x) - 1)
            both += x[at] == ids
        return ids[100 * both >= self.percent * (self.n[r] + self.n[ids] - both)]

    def components(self) -> np.ndarray:
        """The component of each set: a search goes out from every set once, against those that none
        has reached, so that a group of like sets leaves the index after a few searches."""
        comp = np.full(len(self.n), -1, dtype=np.int64)
        for first in range(len(self.n)):
            if not self.left[first]:
                continue
            self.left[first], comp[first], front = False, first, [first]
            while front and self.indexed:
                found = self.search(front.pop())
                self.left[found], comp[found] = False, first
                front += found.tolist()
                if 2 * int(self.left.sum()) < self.indexed:
                    self._index()
        return comp


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of hashed shingles, one after another and each ascending, and their lengths."""
    number = Numbering()
    words = [[number[w] for w in x.lower().split()] for x in texts]
    n = np.array([len(x) for x in words], dtype=np.int64)
    codes = np.fromiter((c for x in words for c in x), dtype=np.int64, count=int(n.sum()))
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in number] or [0], dtype=np.uint64)
    hashes, ends = table[codes], np.cumsum(n)
    starts = ends - n

    def chain(first: np.ndarray, k: int) -> np.ndarray:
        h = np.full(len(first), k, dtype=np.uint64)
        for j in range(k):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + hashes[first + j])
        return h

    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    base = np.cumsum(count) - count
    full = np.flatnonzero(n >= size)
    out[ragged(base[full], count[full])] = chain(ragged(starts[full], count[full]), size)
    for k in range(1, size):
        some = np.flatnonzero(n == k)
        if len(some):
            out[base[some]] = chain(starts[some], k)
    first = np.zeros(len(out), dtype=bool)
    for a, b in zip(base.tolist(), (base + count).tolist(), strict=True):
        out[a:b].sort()
        if b > a:
            first[a] = True
    keep = first.copy()
    keep[1:] |= out[1:] != out[:-1]
    lengths = np.bincount(np.repeat(np.arange(len(texts)), count)[keep], minlength=len(texts)) if len(out) else count
    return out[keep], lengths.astype(np.int64)


def fingerprint(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(np.ascontiguousarray(values))).view(np.int64))


def _required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that a partner of a set of n has at least."""
    return -(-n * percent // 100)


def _scan(batches: Iterator[pa.RecordBatch], key: str, text: str, size: int, percent: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Packed rows (shard, kind, blob): kind 0 documents, 1 settled counts, 2 postings."""
    schema = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
    tokens, owners, held, turn = [], [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal tokens, owners, held, turn
        if not held:
            return
        t, f = np.concatenate(tokens), np.concatenate(owners)
        tokens, owners, held = [], [], 0
        order = np.lexsort((f, t))
        t, f = t[order], f[order]
        keep = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])]
        t, f = t[keep], f[keep]
        run = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[run, len(t)])
        several = np.repeat(length > 1, length)
        who, n = np.unique(f[several], return_counts=True)
        single, of, marks = t[~several], f[~several], t[run[length > 1]]
        s1, s2 = ((x >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32) for x in (single, marks))
        cut1, cut2 = (np.searchsorted(s, np.arange(shards + 1, dtype=np.uint64)) for s in (s1, s2))  # t ascends, so shards do
        where, kind, blobs = [turn % shards], [1], [who.tobytes() + n.astype(np.uint32).tobytes()]
        low1, low2 = single.astype(np.uint32), marks.astype(np.uint32)
        for s in range(shards):
            a, b, c, d = cut1[s], cut1[s + 1], cut2[s], cut2[s + 1]
            if b > a or d > c:
                where.append(s)
                kind.append(2)
                blobs.append(np.array([b - a, d - c], dtype=np.int64).tobytes() + of[a:b].tobytes() + low1[a:b].tobytes() + low2[c:d].tobytes())
        turn += 1
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(kind, pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    for batch in text_chunks(batches, text, 3_000_000):
        sets, n = shingle_sets(texts_of(batch, text), size)
        ends = np.cumsum(n)
        prints = np.array([fingerprint(sets[b - k : b]) if k else 0 for b, k in zip(ends.tolist(), n.tolist(), strict=True)], dtype=np.int64)
        ids = batch.column(batch.schema.get_field_index(key))
        known = np.asarray(ids.is_valid())
        docs = np.asarray(ids.fill_null(0), dtype=np.int64).tobytes() + prints.tobytes() + n.tobytes() + known.astype(np.int8).tobytes()
        turn = turn or int(prints.view(np.uint64).sum() % np.uint64(shards))
        yield pa.RecordBatch.from_arrays([pa.array([turn % shards], pa.int32()), pa.array([0], pa.int32()), pa.array([docs], pa.binary())], schema=schema)
        _, once = np.unique(prints, return_index=True)
        once = once[(n[once] > 0) & known[once]]
        p = np.minimum(n[once], n[once] - _required(n[once], percent) + np.maximum(1, n[once] // EXTRA))
        tokens.append(mix64(sets[ragged((ends - n)[once], p)] + np.uint64(1)))
        owners.append(np.repeat(prints[once], p))
        held += int(p.sum())
        if held > FLUSH:
            yield from flush()
    yield from flush()


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, n, print, shared, kind): kind 0 documents, kind 1 a set's shared prefix shingles in these shards."""
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("print", pa.int64()), ("shared", pa.int64()), ("kind", pa.int32())])
    who, count, shard, blobs = [], [], None, []

    def close() -> None:
        of, tok, marks = [], [], []
        for x in blobs:
            k, m = np.frombuffer(x, dtype=np.int64, count=2).tolist()
            of.append(np.frombuffer(x, dtype=np.int64, count=k, offset=16))
            tok.append(np.frombuffer(x, dtype=np.uint32, count=k, offset=16 + 8 * k))
            marks.append(np.frombuffer(x, dtype=np.uint32, count=m, offset=16 + 12 * k))
        if not of:
            return
        f, t, marks = np.concatenate(of), np.concatenate(tok), np.unique(np.concatenate(marks))
        order = np.lexsort((f, t))
        f, t = f[order], t[order]
        if not len(t):
            return
        keep = np.r_[True, (t[1:] != t[:-1]) | (f[1:] != f[:-1])]
        f, t = f[keep], t[keep]
        run = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        length = np.diff(np.r_[run, len(t)])
        shared = np.repeat((length > 1) | np.isin(t[run], marks), length)
        a, n = np.unique(f[shared], return_counts=True)
        who.append(a)
        count.append(n)

    for batch in batches:
        for s, kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind == 0:
                k = len(x) // 25
                doc, prints, n = (np.frombuffer(x, dtype=np.int64, count=k, offset=8 * k * i) for i in range(3))
                known = np.frombuffer(x, dtype=np.int8, count=k, offset=24 * k) > 0
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=~known), pa.array(n), pa.array(prints, mask=n == 0), pa.nulls(k, pa.int64()), pa.array(np.zeros(k, dtype=np.int32))], schema=schema)
            elif kind == 1:
                k = len(x) // 12
                who.append(np.frombuffer(x, dtype=np.int64, count=k))
                count.append(np.frombuffer(x, dtype=np.uint32, count=k, offset=8 * k).astype(np.int64))
            else:
                if s != shard:
                    close()
                    shard, blobs = s, []
                blobs.append(x)
    close()
    if who:
        a, at = np.unique(np.concatenate(who), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate(count)).astype(np.int64)
        for i in range(0, len(a), 100_000):
            p, c = a[i : i + 100_000], n[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.int64()), pa.array(p), pa.array(c), pa.array(np.ones(len(p), dtype=np.int32))], schema=schema)


def _sets(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    for batch in text_chunks(batches, text, 3_000_000):
        values, n = shingle_sets(texts_of(batch, text), size)
        offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
        prints = [fingerprint(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(prints, pa.int64()), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))], ["print", "n", "shingles"])


def _search(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, unit, print, n, shingles), sorted by unit: links (a, b), a star for each component
    of a unit."""
    now, prints, n, parts = None, [], [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(prints) > 1:
            ids = np.array(prints, dtype=np.int64)
            comp = Unit(np.concatenate(parts), np.array([len(x) for x in parts]), np.array(n, dtype=np.int64), percent).components()
            at = np.flatnonzero(comp != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[comp[at]]), pa.array(ids[at])], ["a", "b"])

    for batch in batches:
        shingles = batch.column(4)
        flat, ends = shingles.flatten().to_numpy(), np.r_[0, np.cumsum(shingles.value_lengths().to_numpy())]
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if key != now:
                yield from close()
                now, prints, n, parts = key, [], [], []
            prints.append(batch.column(2)[i].as_py())
            n.append(batch.column(3)[i].as_py())
            parts.append(flat[ends[i] : ends[i + 1]].copy())
    yield from close()


def jaccard_components(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 75) -> DataFrame:
    """Per row of docs: key (long), n_shingles and component_id, the smallest key that links reach
    (the row's own where there is none)."""
    shards = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text))
    packed = docs.mapInArrow(released(lambda it: _scan(it, key, text, size, percent, shards)), "shard int, kind int, blob binary")
    facts = packed.repartition(shards // 4, "shard").sortWithinPartitions("shard").mapInArrow(released(_settle), "doc long, n long, print long, shared long, kind int")
    facts, p_facts = materialise(spark, facts, "jaccard-facts")
    rows = facts.where("kind = 0").select("doc", "n", "print")
    need = lambda n: F.ceil(n * percent / F.lit(100)).cast("long")
    some = facts.where("print is not null and (kind = 1 or doc is not null)").groupBy("print").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.sum("shared").alias("shared"))
    some = some.where(F.col("shared") >= F.greatest(F.lit(1), F.floor(need(F.col("n")) / EXTRA))).select(F.col("doc").alias(key), F.col("print"))
    some, p_some = materialise(spark, some, "jaccard-some")
    # the whole sets of what is left, one document for each
    again = docs.join(small(some.select(key).distinct(), some.count()), key, "left_semi")
    sets = again.select(text).mapInArrow(released(lambda it: _sets(it, text, size)), "print long, n long, shingles array<long>").where("n > 0").dropDuplicates(["print"])
    sets, p_sets = materialise(spark, sets, "jaccard-sets")
    each = sets.select("print", "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(often, "shingle").groupBy("print").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("s"))
    shared = shared.where(F.size("s") >= need(F.col("n"))).select("print", "n", F.col("s.shingle").alias("shingles"))
    shared, p_shared = materialise(spark, shared, "jaccard-shared")
    links, p_links = materialise(spark, _links(spark, shared, percent), "jaccard-links")
    comps = components(spark, links).withColumnRenamed("node", "print")
    least = rows.where("doc is not null and print is not null").groupBy("print").agg(F.min("doc").alias("least"))
    linked, p_linked = materialise(spark, comps.join(least, "print"), "jaccard-linked")
    # a component may hold a third of all sets: both sides are salted
    salt = F.pmod(F.xxhash64("print"), F.lit(SALTS)).alias("salt")
    groups = linked.groupBy("comp").agg(F.min("least").alias("component")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    of = least.join(linked.select("print", "comp", salt).join(groups, ["comp", "salt"]).select("print", "component"), "print", "left").select("print", F.coalesce("component", "least").alias("component"))
    # rows of one set are many where a text has many copies; the other side has one row for each set
    out = rows.join(of, "print", "left").select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))
    out, _ = materialise(spark, out, "jaccard-result")
    drop(spark, p_facts, p_some, p_sets, p_shared, p_links, p_linked)
    return out


def _links(spark: SparkSession, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links (a, b) that have the components of all links. sets: print, n and the shared
    shingles from rare to frequent."""
    same = [F.col("n"), F.xxhash64("shingles").alias("h1"), F.xxhash64(F.lit(1), "shingles").alias("h2")]
    sets, p_hashed = materialise(spark, sets.select("print", "shingles", *same), "jaccard-hashed")
    classes = sets.groupBy("n", "h1", "h2").agg(F.min("print").alias("rep"), F.count("*").alias("members"))
    members = sets.join(classes.where("members > 1"), ["n", "h1", "h2"]).select("rep", "print", "n", F.size("shingles").alias("shared"))
    members, p_members = materialise(spark, members, "jaccard-members")
    sets = sets.join(members.where("rep <> print").select("print"), "print", "left_anti").select("print", "n", "shingles")
    sets, p_sets = materialise(spark, sets, "jaccard-classes")
    # sets that link share a shingle among the size - T + 1 rarest of both: such lists join them to buckets
    lists = sets.select("print", F.explode(F.expr(f"slice(shingles, 1, greatest(0, cast(size(shingles) - ceil(n * {percent} / 100D) + 1 as int)))")).alias("shingle"))
    lists, p_lists = materialise(spark, lists, "jaccard-lists")
    firsts = lists.groupBy("shingle").agg(F.min("print").alias("a"), F.count("*").alias("k")).where("k > 1").select("shingle", "a")
    near = lists.join(firsts, "shingle").where("print <> a").select("a", F.col("print").alias("b")).distinct()
    buckets = components(spark, near).select(F.col("node").alias("print"), F.col("comp").alias("bucket"))
    dealt, p_dealt = materialise(spark, sets.join(buckets, "print"), "jaccard-buckets")
    large = dealt.groupBy("bucket").agg(F.ceil(F.sum(F.size("shingles")) / UNIT_SHINGLES).cast("long").alias("k")).where("k > 1")
    large, p_large = materialise(spark, large, "jaccard-large")
    # a large bucket is k blocks; each pair of its blocks is a unit
    dealt = dealt.join(small(large, large.count()), "bucket", "left").withColumn("i", F.pmod(F.xxhash64("print"), F.coalesce("k", F.lit(1))))
    units = F.when(F.col("k").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("k") - 1), lambda j: j != F.col("i")), lambda j: F.least("i", j) * F.col("k") + F.greatest("i", j)))
    dealt = dealt.select("bucket", F.explode(units).alias("unit"), "print", "n", "shingles")
    found = dealt.repartition("bucket", "unit").sortWithinPartitions("bucket", "unit", "print").mapInArrow(released(lambda it: _search(it, percent)), "a long, b long")
    found, p_found = materialise(spark, found, "jaccard-found")
    # members of a class link with each other, or through whatever their class links with
    ends = found.select(F.col("a").alias("rep")).union(found.select("b")).distinct().withColumn("linked", F.lit(True))
    self_linked = F.col("shared") * 100 >= F.lit(percent) * (2 * F.col("n") - F.col("shared"))
    inner = members.where("rep <> print").join(ends, "rep", "left").where(self_linked | F.col("linked")).select(F.col("rep").alias("a"), F.col("print").alias("b"))
    out, _ = materialise(spark, found.union(inner), "jaccard-both")
    drop(spark, p_hashed, p_members, p_sets, p_lists, p_dealt, p_large, p_found)
    return out
