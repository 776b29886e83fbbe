"""Vector operators: inner product, centroids, nearest centroid, nearest rows of a query set, ridge regression.

Rows whose vector is null, or holds nulls or non-finite numbers, take no part in ``nearest`` and ``ridge``;
in ``ridge`` neither do rows without a label. All others must have one length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a packed block of candidates, and of queries.
BLOCK, QUERIES = 8192, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, i, mean: one row for each class and component; partial sums meet in one shuffle."""
    return df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def nearest_centroid(df: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """key, label, predicted: by Euclidean distance, ties to the smaller label. The classes' centroids
    are the small side; vectors stay where they are."""
    c = centroids(df, label, vector).groupBy(F.col(label).alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mean"))), lambda s: s["mean"]).alias("m"))
    d = F.round(dot(F.col("m"), F.col("m")) - 2 * dot(F.col(vector), F.col("m")), 9)
    return df.crossJoin(c).groupBy(key, label).agg(F.min(F.struct(d.alias("d"), F.col("c"))).alias("best")).select(key, label, F.col("best.c").alias("predicted"))


def sound(vector: str) -> Column:
    """Whether a vector and all its components are there and finite."""
    x = F.col(vector)
    return x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))


def _packed(df: DataFrame, key: str, vector: str, rows: int, name: str) -> tuple[DataFrame, int]:
    """Numbered blocks of about ``rows`` rows, dealt by a hash of key and vector: one array of keys, one of
    all components; and the number of blocks."""
    blocks = -(-df.count() // rows) or 1
    both = F.array_sort(F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))))
    out = df.groupBy(F.pmod(F.xxhash64(key, vector), F.lit(blocks)).alias("b")).agg(both.alias("r"))
    return out.select("b", F.transform("r", lambda r: r["id"]).alias(f"{name}_id"), F.flatten(F.transform("r", lambda r: r["x"])).alias(f"{name}_x")), blocks


def nearest(df: DataFrame, queries: DataFrame, k: int, measure: str = "cosine", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), key, score of the k nearest other rows of each query: by cosine (largest
    first; vectors of length zero take no part) or squared Euclidean distance (smallest first), rounded to
    nine digits, ties to the smaller key. Rows are moved once, each block of queries once to each block of
    rows; of each such meeting k rows a query are left, and a window ranks those. An empty side gives no rows."""
    if measure not in ("cosine", "euclid"):
        raise ValueError(f"no measure {measure}")
    some = sound(vector) if measure == "euclid" else sound(vector) & F.exists(vector, lambda v: v != 0)
    rows, asked = (d.where(some & F.col(key).isNotNull()) for d in (df, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                flat = lambda i: np.asarray(batch.column(i)[at].values)  # noqa: B023, E731
                q, c = flat(0), flat(2)
                a, b = flat(1).reshape(len(q), -1), flat(3).reshape(len(c), -1)
                if measure == "cosine":
                    cost = -(a / np.linalg.norm(a, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T
                else:
                    cost = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
                cost = cost.round(9) + 0.0
                cost[q[:, None] == c] = np.inf
                best = np.argsort(cost, axis=1, kind="stable")[:, :k]  # keys ascend within a block
                cost = np.take_along_axis(cost, best, 1)
                fine = np.isfinite(cost)
                score = -cost[fine] + 0.0 if measure == "cosine" else cost[fine]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, fine.sum(1))), pa.array(c[best[fine]]), pa.array(score)], ["query_id", key, "score"])

    blocks, n = _packed(rows, key, vector, BLOCK, "c")
    sent = _packed(asked, key, vector, QUERIES, "q")[0].withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    found = sent.join(blocks, "b").select("q_id", "q_x", "c_id", "c_x").mapInArrow(run, f"query_id long, {key} long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc() if measure == "cosine" else F.col("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def ridge(df: DataFrame, fold: str, test: int, alphas: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0, 100.0), label: str = "label", vector: str = "embedding") -> tuple[DataFrame, float]:
    """df with columns predicted and confidence, and the penalty chosen: one-against-all ridge regression on
    centred vectors. Rows of fold ``test`` are scored by a model of all others; rows of another fold by one
    of the others but that fold. The penalty is the one that is right most often outside the test fold, ties
    to the smaller. One pass sums each fold's moments (their number goes with the square of the width, not
    with the rows); every model comes from these sums."""
    df = df.where(sound(vector) & F.col(label).isNotNull())
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    if not labels:
        return df.withColumns({"predicted": F.col(label), "confidence": F.lit(None).cast("double")}), alphas[0]
    place = {v: i for i, v in enumerate(labels)}

    def matrix(column: pa.Array) -> np.ndarray:
        return np.array(column.to_pylist(), np.float64)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x, y, f = matrix(b.column(0)), np.eye(len(labels))[[place[v] for v in b.column(1).to_pylist()]], np.asarray(b.column(2))
            z = np.hstack([np.ones((len(x), 1)), x, y])
            for one in np.unique(f).tolist():
                own = z[f == one]
                sums[one] = sums.get(one, 0) + own[:, : 1 + x.shape[1]].T @ own
        for one, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, one, np.int64)), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(s.ravel())], ["f", "i", "j", "s"])

    cells = df.select(vector, label, F.col(fold).cast("long")).mapInArrow(moments, "f long, i long, j long, s double").groupBy("f", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    width = int(cells["i"].max()) + 1
    sums = {}
    for one, part in cells.groupby("f"):
        sums[int(one)] = s = np.zeros((width, width + len(labels)))
        s[part["i"], part["j"]] = part["s"]

    def solve(folds: list[int], alpha: float) -> tuple[np.ndarray, np.ndarray]:
        s = sum((sums[f] for f in folds), np.zeros((width, width + len(labels))))
        n = max(s[0, 0], 1.0)
        x, y = s[0, 1:width] / n, s[0, width:] / n
        coef = np.linalg.solve(s[1:, 1:width] - n * np.outer(x, x) + alpha * np.eye(width - 1), s[1:, width:] - n * np.outer(x, y))
        return coef, y - x @ coef

    columns = df.columns
    x_at, y_at = columns.index(vector), columns.index(label)

    def outputs(b: pa.RecordBatch, models: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        x, f = matrix(b.column(x_at)), np.asarray(b.column(b.num_columns - 1))
        z = np.zeros((len(x), len(labels)))
        for one in np.unique(f).tolist():
            coef, free = models[one]
            z[f == one] = x[f == one] @ coef + free
        return z.round(9)

    def models(alpha: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {f: solve([g for g in sums if g not in (f, test)], alpha) for f in sums}

    tried = [models(a) for a in alphas]
    numbered = df.withColumn("_fold", F.col(fold).cast("long"))

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(alphas), np.int64)
        for b in batches:
            if b.num_rows:
                y = np.array([place[v] for v in b.column(y_at).to_pylist()])
                n += [int((outputs(b, m).argmax(1) == y).sum()) for m in tried]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(alphas)), pa.int64()), pa.array(n)], ["alpha", "n"])

    counted = numbered.where(F.col("_fold") != test).mapInArrow(right, "alpha long, n long").groupBy("alpha").agg(F.sum("n")).collect()
    best = min(range(len(alphas)), key=lambda i: (-dict(map(tuple, counted)).get(i, 0), alphas[i]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = outputs(b, tried[best])
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([labels[i] for i in z.argmax(1)], b.column(y_at).type), pa.array(z.max(1))], [*columns, "predicted", "confidence"])

    made = df.withColumns({"predicted": F.col(label), "confidence": F.lit(0.0)}).schema
    return numbered.mapInArrow(run, made), alphas[best]
