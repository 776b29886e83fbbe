"""Language-model scoring: a causal self-attention model beside a word-count base.

Every text is split and cut into subword ids once, by greedy longest match. That one pass writes each
document's ids, the id counts of the training documents, and for each block of documents and shard of
words the words' counts in the training documents and which documents hold them how often. Where a
shard's counts meet, each document's part of the base score is summed and sent back by block. The most
frequent words of a bounded sample (``FREQUENT``; a choice of route, not of result) go another way: a
document keeps their numbers beside its ids, and their totals, bounded in number, go to the scoring tasks.

The model's tables of pairs (what follows an id) and its id distributions within classes are counts
of all training documents. The attention layer around them starts from a fit on the driver on that
sample; then a copy in every task learns from each token of its training documents once, and the
copies' weights are averaged by the tokens (rows of inputs by the times) that each has seen. So the
weights depend a little on how the documents are dealt to tasks. Scoring reads all whole texts, as ids.

Nulls and empty texts are one end token. A null key counts as held out. Repeated rows are scored
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import attention, token_counts
from lodestar.llm.common import drop, held_out, kept, materialise, Numbering, ragged, released, text_chunks, texts_of

#: Training documents that the attention weights start from, and steps of that fit.
SAMPLE_DOCS, STEPS = 3000, 5000
#: Words that a document keeps beside its ids instead of sending them.
FREQUENT = 4096
CACHE_WORDS = 300_000
#: Blocks of documents whose sums a task holds at once.
HELD_BLOCKS = 3000
_PACKED = "shard int, kind int, block long, blob binary"
_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("blob", pa.binary())])
_CUT = _PACKED + ", doc long, row long, held boolean, ids binary, often binary"
_CUT_SCHEMA = pa.schema([*_SCHEMA, ("doc", pa.int64()), ("row", pa.int64()), ("held", pa.bool_()), ("ids", pa.binary()), ("often", pa.binary())])


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _wide(rows: int, **columns) -> pa.RecordBatch:
    """Rows of _CUT; the columns that are not named are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in _CUT_SCHEMA], schema=_CUT_SCHEMA)


def row_key(text: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(text)).view(np.int64))


def _where_type(docs: int) -> type:
    return np.uint16 if docs <= 2**16 else np.uint32


def _scan(batches: Iterator[pa.RecordBatch], path: str, shards: int, frequent: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a block's documents. Kind 1: a block's words of one shard. Kind 3: counts of ids in the
    training documents. Kind 5: those of frequent words. Kind 8: a document's ids and frequent words."""
    block = (TaskContext.get().partitionId() << 32) - 1
    subwords, kind = _Subwords(path, frequent, shards), _ids_type(path)
    ids, often = np.zeros(subwords.end + 1, np.int64), np.zeros(len(frequent), np.int64)
    for batch in text_chunks(batches, most=4_000_000):
        block += 1
        texts = texts_of(batch)
        held = np.asarray(batch.column(2), dtype=bool)
        flat, n = subwords.meet(texts)
        doc, keys = batch.column(0).cast(pa.int64()), np.array([row_key(x) for x in texts], np.int64)
        docs = [np.asarray(doc.fill_null(0), np.int64), keys, n + 1, np.asarray(doc.is_valid()).astype(np.int64), held.astype(np.int64)]
        yield _wide(1, shard=[block % shards], kind=[0], block=[block], blob=[np.concatenate(docs).tobytes()])
        x, first = subwords.together(flat, n)
        ids += np.bincount(x[np.repeat(~held, np.diff(np.r_[first, len(x)]))], minlength=len(ids))
        at = np.repeat(np.arange(len(n)), n)
        common = subwords.often[flat]
        rare = common < 0
        often += np.bincount(common[~rare & ~held[at]], minlength=len(often))
        per = np.bincount(at[~rare], minlength=len(n))
        cuts = np.split(x.astype(kind), first[1:]), np.split(common[~rare].astype(np.uint16), np.cumsum(per)[:-1])
        yield _wide(len(n), kind=np.full(len(n), 8), doc=doc, row=keys, held=held, ids=[v.tobytes() for v in cuts[0]], often=[v.tobytes() for v in cuts[1]])
        flat, at = flat[rare], at[rare]
        if not len(flat):
            continue
        met = np.zeros(len(subwords.words), bool)
        met[flat] = True
        words = np.flatnonzero(met)
        words = words[np.argsort(subwords.shard[words], kind="stable")]
        place = np.empty(len(met), np.int64)
        place[words] = np.arange(len(words))
        flat = place[flat]
        pair, times = np.unique(flat * len(n) + at, return_counts=True)
        per = np.bincount(pair // len(n), minlength=len(words)).astype(np.uint32)
        counts = np.bincount(flat[~held[at]], minlength=len(words)).astype(np.uint32)
        where, times = (pair % len(n)).astype(_where_type(len(n))), times.astype(np.uint32)
        cut = np.searchsorted(subwords.shard[words], np.arange(shards + 1)).tolist()
        ends = np.r_[0, np.cumsum(per, dtype=np.int64)]
        to, blobs = [], []
        for s in range(shards):
            a, b = cut[s], cut[s + 1]
            if b > a:
                c, d = int(ends[a]), int(ends[b])
                head = np.array([b - a, d - c, len(n)], np.int64).tobytes()
                to.append(s)
                blobs.append(head + counts[a:b].tobytes() + per[a:b].tobytes() + times[c:d].tobytes() + where[c:d].tobytes() + b" ".join([subwords.words[i] for i in words[a:b].tolist()]))
        yield _wide(len(to), shard=to, kind=np.full(len(to), 1), block=np.full(len(to), block), blob=blobs)
    for what, found in ((3, ids), (5, often)):
        at = np.flatnonzero(found)
        if len(at):
            yield _wide(1, kind=[what], blob=[at.tobytes() + found[at].tobytes()])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: documents, as they came. Kind 2: parts of a block's sums. Kind 4: training tokens and
    distinct ones, but for frequent words."""
    sums: dict[int, np.ndarray] = {}
    total = np.zeros(2, np.int64)
    shard, blobs = None, []

    def part() -> list[tuple[int, int, int, bytes]]:
        out = []
        for block, x in sums.items():
            at = np.flatnonzero(x.any(0))
            if len(at):
                out.append((0, 2, block, at.astype(np.int64).tobytes() + x[:, at].tobytes()))
        sums.clear()
        return out

    def close() -> Iterator[pa.RecordBatch]:
        number, seen, c = Numbering(), [], np.zeros(0, np.int64)
        for block, x in blobs:
            k, m, docs = np.frombuffer(x, np.int64, 3).tolist()
            kind = _where_type(docs)
            counts, per = np.frombuffer(x, np.uint32, k, 24), np.frombuffer(x, np.uint32, k, 24 + 4 * k)
            at = 24 + 8 * k
            times, where = np.frombuffer(x, np.uint32, m, at), np.frombuffer(x, kind, m, at + 4 * m)
            at += (4 + np.dtype(kind).itemsize) * m
            codes = np.array([number[w] for w in x[at:].split(b" ")], np.int64)
            if len(number) > len(c):
                c = np.append(c, np.zeros(max(len(number) - len(c), len(c)), np.int64))
            c[codes] += counts
            seen.append((block, docs, codes, per, where, times))
        if not seen:
            return
        c = c[: len(number)]
        value, known = np.log10(c + 0.1), c > 0
        for block, docs, codes, per, where, times in seen:
            if block not in sums:
                if len(sums) >= HELD_BLOCKS:
                    yield _rows(part())
                sums[block] = np.zeros((2, docs))
            code = np.repeat(codes, per)
            sums[block][0] += np.bincount(where, weights=value[code] * times, minlength=docs)
            sums[block][1] += np.bincount(where, weights=known[code] * times, minlength=docs)
        total[0] += c.sum()
        total[1] += known.sum()

    for batch in batches:
        for s, kind, block, x in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if kind == 0:
                yield _rows([(0, 0, block, x)])
                continue
            if s != shard:
                yield from close()
                shard, blobs = s, []
            blobs.append((block, x))
    yield from close()
    yield _rows([*part(), (0, 4, 0, total.tobytes())])


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are sorted by block; each block's documents with their sums."""
    now, docs, parts = None, None, []

    def close() -> Iterator[pa.RecordBatch]:
        if docs is None:
            return
        x = np.frombuffer(docs, np.int64).reshape(5, -1)
        s = np.zeros((2, x.shape[1]))
        for p in parts:
            k = len(p) // 24
            s[:, np.frombuffer(p, np.int64, k)] += np.frombuffer(p, np.float64, 2 * k, 8 * k).reshape(2, k)
        yield pa.RecordBatch.from_arrays([pa.array(x[0], mask=x[3] == 0), pa.array(x[1]), pa.array(x[2]), pa.array(x[4] > 0), pa.array(s[0]), pa.array(s[1].round().astype(np.int64))], ["doc", "row", "n_tokens", "held", "part", "known"])

    for batch in batches:
        for kind, block, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if block != now:
                yield from close()
                now, docs, parts = block, None, []
            if kind == 0:
                docs = x
            else:
                parts.append(x)
    yield from close()


class _Subwords:
    """The words that a worker has met: their subword ids, their shards and, of frequent ones, their numbers."""

    def __init__(self, path: str, frequent: dict[bytes, int], shards: int = 1):
        self.table, self.frequent, self.shards = token_counts.load(path), frequent, shards
        self.end = token_counts.ids(path)
        self.clear()

    def clear(self) -> None:
        self.number, self.words = Numbering(), []
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.often, self.shard = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The codes of the words of all texts, one after another, and how many each text has."""
        if len(self.number) > CACHE_WORDS:
            self.clear()
        words = [x.lower().split() for x in texts]
        n = np.array([len(x) for x in words], np.int64)
        codes = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        new = list(islice(self.number, len(self.words), None))
        if new:
            ids, size = self.table.pieces([b" " + w for w in new])
            self.words += new
            self.start = np.append(self.start, len(self.flat) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.flat = np.append(self.flat, ids)
            self.often = np.append(self.often, [self.frequent.get(w, -1) for w in new])
            self.shard = np.append(self.shard, [xxhash.xxh3_64_intdigest(w) % self.shards for w in new])
        return codes, n

    def together(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences of several texts, one after another, and where each begins."""
        size = self.size[flat]
        ends = np.cumsum(np.r_[0, size])[np.cumsum(n)] + np.arange(1, len(n) + 1)
        out = np.full(int(ends[-1]) if len(n) else 0, self.end, np.int64)
        within = np.ones(len(out), bool)
        within[ends - 1] = False
        out[within] = self.flat[ragged(self.start[flat], size)]
        return out, np.r_[0, ends[:-1]].astype(np.int64) if len(n) else ends

    def sequence(self, codes: np.ndarray) -> np.ndarray:
        return self.together(codes, np.array([len(codes)]))[0]


def _ids_type(path: str) -> type:
    return np.uint16 if token_counts.ids(path) < 2**16 else np.int32


def _joined(blobs: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blobs, one after another, and how many each has."""
    x = blobs.to_pylist()
    return np.frombuffer(b"".join(x), kind).astype(np.int64), np.array([len(v) for v in x], np.int64) // np.dtype(kind).itemsize


def _pairs(batches: Iterator[pa.RecordBatch], shared, path: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids) of training documents: how often each class follows each input, by shard of the pair."""
    (inputs, cls, rows, classes), kind = shared.value, _ids_type(path)  # read once by each worker, whatever the number of its tasks
    total = np.zeros(rows * classes, np.int64)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            x, n = _joined(batch.column(0).slice(i, 500), kind)
            before = np.r_[0, x[:-1]]
            before[np.cumsum(n) - n] = len(cls)
            np.add.at(total, inputs[before] * classes + cls[x], 1)
    at = np.flatnonzero(total)
    for s in range(shards):
        few = at[at % shards == s]
        if len(few):
            yield _rows([(s, 6, 0, few.tobytes() + total[few].tobytes())])


def _learn(batches: Iterator[pa.RecordBatch], shared, path: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids) of training documents: a copy of the model goes once over all their tokens; its sums by shard of the weights."""
    model, kind, rng = shared.value.copy(), _ids_type(path), np.random.default_rng(7)
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            x, n = _joined(batch.column(0).slice(i, 500), kind)
            for one, y, live in model.windows(x, np.cumsum(n) - n, rng.permutation):
                model.train(one, y, live, attention.RATE)
                model.seen += np.bincount(one[live], minlength=len(model.seen))
    if model.steps:
        task = TaskContext.get().partitionId()
        yield _rows([(s, 7, task, part.tobytes()) for s, part in enumerate(np.array_split(model.sums(), shards))])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard and task: each shard's sum, in that order, so that reruns agree."""
    now, total = None, None
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if s != now and now is not None:
                yield _rows([(now, 7, 0, total.tobytes())])
            total = np.frombuffer(x) if s != now else total + np.frombuffer(x)
            now = s
    if now is not None:
        yield _rows([(now, 7, 0, total.tobytes())])


def _score(batches: Iterator[pa.RecordBatch], shared, path: str) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, ids, often) of documents: their scores, and what frequent words add to their base sums."""
    (model, value, known), kind = shared.value, _ids_type(path)
    for batch in batches:
        made = [(np.zeros(0), np.zeros(0), np.zeros(0, np.int64))]
        for i in range(0, batch.num_rows, 500):
            x, n = _joined(batch.column(2).slice(i, 500), kind)
            words, m = _joined(batch.column(3).slice(i, 500), np.uint16)
            doc = np.repeat(np.arange(len(m)), m)
            more, seen = (np.bincount(doc, weights=v[words], minlength=len(m)) for v in (value, known))
            made.append((model.score_joined(x, np.cumsum(n) - n), more, seen.round().astype(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(np.concatenate(c)) for c in zip(*made, strict=True))], ["doc", "row", "score", "more", "more_known"])


def _summed(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(cells, np.int64)
    for batch in batches:
        for x in batch.column(1).to_pylist():
            k = len(x) // 16
            total[np.frombuffer(x, np.int64, k)] += np.frombuffer(x, np.int64, k, 8 * k)
    at = np.flatnonzero(total)
    yield _rows([(0, 6, 0, at.tobytes() + total[at].tobytes())])


def score(spark: SparkSession, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """Per row: key, held_out (not learned from), n_tokens, n_known, train_tokens, base_score, score."""
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"), held_out(F.col(key), folds).alias("held"))
    chosen = docs.where("not held and doc is not null").select("doc").orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE_DOCS)
    chosen = spark.createDataFrame(chosen.distinct().collect(), chosen.schema)  # at most SAMPLE_DOCS rows
    # one text of each sampled key, whole
    sample = docs.select("doc", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(chosen), "doc").groupBy("doc").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    sample = [r["t"].encode().lower() for r in sorted(sample.collect(), key=lambda r: r["doc"])]
    seen = Counter(w for x in sample for w in x.split())
    frequent = {w: i for i, (w, _) in enumerate(sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:FREQUENT])}

    # every text is read, split and cut once; what comes of it waits in the shared folder
    cut, p_cut = materialise(spark, docs.select("doc", "text", "held").mapInArrow(kept(lambda it: _scan(it, path, shards, frequent)), _CUT), "lm-cut")
    packed = cut.where("kind in (0, 1)").select("shard", "kind", "block", "blob")
    settled = packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(released(_settle), _PACKED)
    settled, p_settled = materialise(spark, settled, "lm-settled")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for kind, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = len(x) // 16
                yield pa.RecordBatch.from_arrays([pa.array([kind] * k, pa.int32()), pa.array(np.frombuffer(x, np.int64, k)), pa.array(np.frombuffer(x, np.int64, k, 8 * k))], ["kind", "id", "n"])

    size = token_counts.ids(path)
    counts, often = np.zeros(size + 1), np.zeros(FREQUENT, np.int64)
    for kind, i, c in cut.where("kind in (3, 5)").select("kind", "blob").mapInArrow(released(unpack), "kind int, id long, n long").groupBy("kind", "id").agg(F.sum("n")).collect():  # at most the vocabulary and FREQUENT
        (counts if kind == 3 else often)[i] = c

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([v[0]]), pa.array([v[1]])], ["n", "v"])

    n, v = settled.where("kind = 4").select("blob").mapInArrow(released(add), "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    ends = int(counts[size])
    n, v = n + int(often.sum()) + ends, v + int((often > 0).sum()) + (ends > 0)

    subwords = _Subwords(path, {})
    words, each = subwords.meet(sample)
    sequences = [subwords.sequence(x) for x in np.split(words, np.cumsum(each)[:-1])]
    initial = token_counts.starts(path, b" ")
    model = attention.Attention(counts, initial)
    rows, classes = len(model.p["table"]), model.classes
    shared = spark.sparkContext.broadcast((model.input.astype(np.int64), model.cls.astype(np.int64), rows, classes))
    paired = cut.where("kind = 8 and not held").select("ids").mapInArrow(kept(lambda it: _pairs(it, shared, path, shards)), _PACKED)
    found = paired.select("shard", "blob").repartition(shards, "shard").mapInArrow(released(lambda it: _summed(it, rows * classes)), _PACKED)
    pairs = np.zeros(rows * classes, np.int64)
    for r in found.select("blob").collect():  # at most one number a pair of input and class
        k = len(r[0]) // 16
        pairs[np.frombuffer(r[0], np.int64, k)] = np.frombuffer(r[0], np.int64, k, 8 * k)
    model = attention.fit(model, pairs, sequences, STEPS)
    del pairs
    # the sample only gave a start: copies of the model learn from every token of all training documents, and are averaged
    start = spark.sparkContext.broadcast(model)
    learned = cut.where("kind = 8 and not held").select("ids").mapInArrow(kept(lambda it: _learn(it, start, path, shards)), _PACKED)
    learned = learned.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(released(_added), _PACKED)
    parts = {r["shard"]: r["blob"] for r in learned.select("shard", "blob").collect()}  # one number a weight
    if parts:
        model.mean(np.concatenate([np.frombuffer(parts[i]) for i in range(shards)]))
        model.prepare()

    fitted = spark.sparkContext.broadcast((model, np.log10(often + 0.1), (often > 0).astype(np.float64)))  # of fixed size

    base = settled.where("kind in (0, 2)").repartition(shards, "block").sortWithinPartitions("block").mapInArrow(released(_base), "doc long, row long, n_tokens long, held boolean, part double, known long")
    scored = cut.where("kind = 8").select("doc", "row", "ids", "often").mapInArrow(kept(lambda it: _score(it, fitted, path)), "doc long, row long, score double, more double, more_known long").dropDuplicates(["doc", "row"])
    scored = scored.withColumnRenamed("doc", "doc2").withColumnRenamed("row", "row2")
    out = base.join(scored, (F.col("row") == F.col("row2")) & F.col("doc").eqNullSafe(F.col("doc2")))
    each = float(np.log10(n + 0.1 * (v + 1)))
    end = float(np.log10(ends + 0.1))
    out = out.select(F.col("doc").alias(key), F.col("held").alias("held_out"), "n_tokens", (F.col("known") + F.col("more_known") + F.lit(int(ends > 0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("part") + F.col("more") + F.lit(end) - F.col("n_tokens") * F.lit(each)).alias("base_score"), "score")
    out, _ = materialise(spark, out, "lm-scores")
    drop(spark, p_settled, p_cut)
    return out

