"""Named queries of the DataFrame operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import contain, graph, images, splits, vectors
from lodestar.sources.tables import table
from lodestar.streaming import ledger


def split_exact_groups(spark: SparkSession, root: str) -> DataFrame:
    return splits.split(spark, table(spark, root, "documents"), table(spark, root, "benchmark"))


def split_partition_stats(spark: SparkSession, root: str) -> DataFrame:
    s = split_exact_groups(spark, root)
    return s.groupBy("partition", "reason").agg(F.count("*").alias("docs"), F.count_distinct("group_id").alias("groups"))


def split_leakage_audit(spark: SparkSession, root: str) -> DataFrame:
    """Sources that lie in more than one partition: groups never do, sources may."""
    s = split_exact_groups(spark, root).join(table(spark, root, "documents").select("doc_id", "source"), "doc_id")
    return splits.crossing(s, "source").unionByName(splits.crossing(s).withColumn("source", F.col("group_id").cast("string")).drop("group_id"))


def benchmark_contains(spark: SparkSession, root: str) -> DataFrame:
    return contain.contained(table(spark, root, "documents"), table(spark, root, "benchmark"))


def quarantine_propagation(spark: SparkSession, root: str) -> DataFrame:
    """Sources, of which one document that holds a passage quarantines all."""
    docs = table(spark, root, "documents").select("doc_id", "source")
    bad = benchmark_contains(spark, root).select("doc_id").distinct().join(docs, "doc_id").select("source").distinct().withColumn("hit", F.lit(1))
    return docs.groupBy("source").agg(F.count("*").alias("docs")).join(bad, "source", "left").select("source", "docs", F.coalesce("hit", F.lit(0)).alias("quarantined"))


def components_recursive(spark: SparkSession, root: str) -> DataFrame:
    return splits.linked(spark, table(spark, root, "documents"))


def component_sizes(spark: SparkSession, root: str) -> DataFrame:
    return components_recursive(spark, root).groupBy("group_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


def _turns(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "conversations").select("conv_id", "turn", tx.tokens(F.col("text")).alias("w"))
    return c.join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v")), ["conv_id", "turn"])


def bigram_f1(spark: SparkSession, root: str) -> DataFrame:
    t = _turns(spark, root).select("conv_id", "turn", tx.ngrams(F.col("w"), 2).alias("a"), tx.ngrams(F.col("v"), 2).alias("b"))
    return t.select("conv_id", "turn", tx.f1(tx.overlap(F.col("a"), F.col("b")), F.size("a"), F.size("b")).alias("f1"))


def wer_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Words are mapped to single characters of their own (code points from 65536 on, some million), so
    that the built-in distance counts words. A null text has no words."""
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    t = _turns(spark, root).select("conv_id", "turn", words(F.col("w")).alias("w"), words(F.col("v")).alias("v")).withColumn("all", F.array_distinct(F.concat("w", "v")))
    code = lambda x: F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(F.array_position("all", w) + 65535), 8, "0")), "")), "UTF-32")
    t = t.select("conv_id", "turn", F.size("v").alias("n"), F.levenshtein(code(F.col("w")), code(F.col("v"))).alias("d"))
    return t.select("conv_id", "turn", F.col("d").cast("long").alias("edits"), F.round(F.when(F.col("n") > 0, F.col("d") / F.col("n")).otherwise((F.col("d") > 0).cast("double")), 8).alias("wer"))


def nearest_centroid(spark: SparkSession, root: str) -> DataFrame:
    return vectors.nearest_centroid(table(spark, root, "embeddings"))


def _asked(e: DataFrame) -> DataFrame:
    return e.where(F.col("vec_id") % 100 == 0)


def cosine_topk(spark: SparkSession, root: str) -> DataFrame:
    """The 10 rows of smallest angle to each query (every row whose id is divisible by 100)."""
    e = table(spark, root, "embeddings")
    return vectors.nearest(e, _asked(e), 10).select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def knn_1(spark: SparkSession, root: str) -> DataFrame:
    """Each query's label beside that of its nearest other row."""
    e = table(spark, root, "embeddings")
    found = vectors.nearest(e, _asked(e), 1, "euclid")
    found = found.join(e.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return found.join(e.select("vec_id", F.col("label").alias("predicted")), "vec_id").select("query_id", "label", "vec_id", "predicted", F.round("score", 6).alias("distance"))


def _ridge(spark: SparkSession, root: str) -> tuple[DataFrame, float]:
    e = table(spark, root, "embeddings").withColumn("fold", (F.crc32(F.col("vec_id").cast("string")) % 3).cast("long"))
    return vectors.ridge(e, "fold", 2)


def ridge_holdout(spark: SparkSession, root: str) -> DataFrame:
    """The third fold's rows by a model of the other two, whose penalty these two choose."""
    scored, alpha = _ridge(spark, root)
    return scored.where("fold = 2").select("vec_id", "label", "predicted", F.round("confidence", 6).alias("confidence"), F.lit(alpha).alias("alpha"))


def ood_threshold(spark: SparkSession, root: str) -> DataFrame:
    """The 5 % quantile of the confidences of the first two folds, each by the other's model; rows of the
    third fold below it are turned away."""
    scored, _ = _ridge(spark, root)
    limit = scored.where("fold <> 2").agg(F.percentile("confidence", 0.05).alias("threshold"), F.count("*").alias("calibrated"))
    tested = scored.where("fold = 2").join(F.broadcast(limit.select("threshold")))
    return tested.agg(F.count("*").alias("tested"), F.coalesce(F.sum((F.col("confidence") < F.col("threshold")).cast("long")), F.lit(0)).alias("rejected")).join(limit.select(F.round("threshold", 6).alias("threshold"), "calibrated"))


def flood_fill_boxes(spark: SparkSession, root: str) -> DataFrame:
    """Boxes of the connected regions of positive cells, each vector laid out as a sheet of eight by eight."""
    cells = table(spark, root, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "v")).where("v > 0")
    return images.regions(spark, cells.select("image", (F.col("i") % 8).alias("x"), F.floor(F.col("i") / 8).alias("y")), 8, 8, 4).withColumnRenamed("image", "vec_id")


def gram_matrix(spark: SparkSession, root: str) -> DataFrame:
    c = vectors.centroids(table(spark, root, "embeddings"))
    other = c.select(F.col("label").alias("other"), "i", F.col("mean").alias("m2"))
    return c.join(other, "i").groupBy("label", "other").agg(F.round(F.sum(F.col("mean") * F.col("m2")), 6).alias("g"))


def _trade(spark: SparkSession, root: str) -> DataFrame:
    """Edges a -> b from each customer nation to the supplier nation that it orders most lines from."""
    orders = table(spark, root, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, root, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s_suppkey"))
    buyers = orders.join(table(spark, root, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a")), "c_custkey")
    sellers = lines.join(table(spark, root, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b")), "s_suppkey")
    n = buyers.join(sellers, "k").groupBy("a", "b").agg(F.count("*").alias("n"))
    return n.groupBy("a").agg(F.max(F.struct("n", (-F.col("b")).alias("minus"))).alias("top")).select("a", (-F.col("top.minus")).alias("b"))


def cycle_check(spark: SparkSession, root: str) -> DataFrame:
    """Nations that no order of that graph can place: those on a cycle or after one."""
    return graph.cyclic(spark, _trade(spark, root))


def reachability(spark: SparkSession, root: str) -> DataFrame:
    """Nations reached from nation 0, with the fewest steps."""
    return graph.reachable(spark, _trade(spark, root), spark.sql("SELECT 0L AS node"))


def stream_tumbling(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/events.parquet"
    out = ledger.run_available(spark, path, spark.read.parquet(path).schema, ledger.tumbling)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def stream_ledger(spark: SparkSession, root: str) -> DataFrame:
    path = f"{root}/events.parquet"
    return ledger.run_available(spark, path, spark.read.parquet(path).schema, ledger.ledger, "update")


_NORM = r"sha256(array_to_string(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+'), ' '))"
_GROUPS = f"g AS (SELECT doc_id, lang, min(doc_id) OVER (PARTITION BY {_NORM}) AS group_id, text FROM documents)"
_SPLIT = f"""WITH {_GROUPS},
h AS (SELECT g.doc_id, max(CASE WHEN b.item_id IS NULL THEN 0 ELSE 1 END) AS hit FROM g LEFT JOIN benchmark b ON contains(g.text, b.text) GROUP BY g.doc_id),
u AS (SELECT g.group_id, min(g.lang) AS stratum, count(*) AS size, sum(h.hit) AS hits FROM g JOIN h ON h.doc_id = g.doc_id GROUP BY g.group_id),
o AS (SELECT group_id, stratum, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY sha256('seed|' || stratum || '|' || CAST(group_id AS VARCHAR)), group_id) AS i FROM u WHERE hits = 0),
b AS (SELECT *, CAST(floor(n * 0.6::DOUBLE) AS BIGINT) AS b0, CAST(floor(n * 0.2::DOUBLE) AS BIGINT) AS b1, n * 0.6::DOUBLE AS r0, n * 0.2::DOUBLE AS r1 FROM o),
q AS (SELECT *, n - b0 - 2 * b1 AS rest, round(r0 - b0, 9) AS f0, round(r1 - b1, 9) AS f1 FROM b),
c AS (SELECT *, b0 + CASE WHEN (CASE WHEN f0 >= f1 THEN 1 ELSE 3 END) <= rest THEN 1 ELSE 0 END AS c0, b1 + CASE WHEN (CASE WHEN f0 >= f1 THEN 2 ELSE 1 END) <= rest THEN 1 ELSE 0 END AS c1 FROM q),
a AS (SELECT group_id, CASE WHEN i <= c0 THEN 'train' WHEN i <= c0 + c1 THEN 'dev' ELSE 'test' END AS part, 'allocated' AS reason FROM c
  UNION ALL SELECT group_id, 'excluded', CASE WHEN hits = size THEN 'quarantine' ELSE 'linked_to_quarantine' END FROM u WHERE hits > 0),
s AS (SELECT g.doc_id, g.group_id, a.part AS partition, a.reason FROM g JOIN a ON a.group_id = g.group_id)
"""

_TOK = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_TRADE = "e AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS rn FROM (SELECT CAST(c_nationkey AS BIGINT) AS a, CAST(s_nationkey AS BIGINT) AS b, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) t) u WHERE rn = 1)"

ORACLE = {
    "split_exact_groups": _SPLIT + "SELECT doc_id, group_id, partition, reason FROM s",
    "split_partition_stats": _SPLIT + "SELECT partition, reason, count(*) AS docs, count(DISTINCT group_id) AS groups FROM s GROUP BY partition, reason",
    "split_leakage_audit": _SPLIT + "SELECT d.source, count(DISTINCT s.partition) AS partitions FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE s.partition <> 'excluded' GROUP BY d.source HAVING count(DISTINCT s.partition) > 1 UNION ALL SELECT CAST(group_id AS VARCHAR), count(DISTINCT partition) FROM s WHERE partition <> 'excluded' GROUP BY group_id HAVING count(DISTINCT partition) > 1",
    "components_recursive": f"WITH {_GROUPS} SELECT doc_id, group_id FROM g",
    "component_sizes": f"WITH {_GROUPS} SELECT size, count(*) AS components FROM (SELECT group_id, count(*) AS size FROM g GROUP BY group_id) t GROUP BY size",
    "nearest_centroid": "WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS c, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, i), d AS (SELECT x.vec_id, x.label, c.c, round(sum(c.m * c.m) - 2 * sum(CAST(x.x AS DOUBLE) * c.m), 9) AS d FROM x JOIN c ON c.i = x.i GROUP BY x.vec_id, x.label, c.c) SELECT vec_id, label, c AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS rn FROM d) t WHERE rn = 1",
    "cosine_topk": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM e), d AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_inner_product(q.x, c.x) / (q.n * c.n), 9) AS score FROM n q JOIN n c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 AND q.n > 0 AND c.n > 0), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM d) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "knn_1": "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT q.vec_id AS query_id, q.label, c.vec_id, c.label AS predicted, round(list_inner_product(q.x, q.x) + list_inner_product(c.x, c.x) - 2 * list_inner_product(q.x, c.x), 9) AS distance FROM e q JOIN e c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) SELECT query_id, label, vec_id, predicted, round(distance, 6) AS distance FROM r WHERE rank = 1",
    "flood_fill_boxes": "WITH RECURSIVE p AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) t WHERE v > 0), e AS (SELECT a.vec_id, a.i AS a, b.i AS b FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1), r(vec_id, node, seen) AS (SELECT vec_id, i, i FROM p UNION SELECT e.vec_id, r.node, e.b FROM r JOIN e ON e.vec_id = r.vec_id AND e.a = r.seen), c AS (SELECT vec_id, node, min(seen) AS comp FROM r GROUP BY vec_id, node) SELECT c.vec_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS area FROM c JOIN p ON p.vec_id = c.vec_id AND p.i = c.node GROUP BY c.vec_id, c.comp HAVING count(*) >= 4 AND NOT ((max(x) - min(x) + 1) / 8.0 > 0.95 AND (max(y) - min(y) + 1) / 8.0 > 0.9)",
    "gram_matrix": "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM x GROUP BY label, i) SELECT a.label, b.label AS other, round(sum(a.m * b.m), 6) AS g FROM c a JOIN c b ON a.i = b.i GROUP BY a.label, b.label",
    "benchmark_contains": "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "quarantine_propagation": "WITH q AS (SELECT DISTINCT d.source FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT d.source, count(*) AS docs, max(CASE WHEN q.source IS NULL THEN 0 ELSE 1 END) AS quarantined FROM documents d LEFT JOIN q ON q.source = d.source GROUP BY d.source",
    "cycle_check": f"WITH RECURSIVE {_TRADE}, r(start, node) AS (SELECT a, b FROM e UNION SELECT r.start, e.b FROM r JOIN e ON e.a = r.node), c AS (SELECT DISTINCT start AS node FROM r WHERE start = node) SELECT node FROM c UNION SELECT r.node FROM r JOIN c ON c.node = r.start",
    "reachability": f"WITH RECURSIVE {_TRADE}, r(node, steps) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT e.b, r.steps + 1 FROM r JOIN e ON e.a = r.node WHERE r.steps < 30) SELECT node, min(steps) AS steps FROM r GROUP BY node",
    "bigram_f1": "WITH w AS (SELECT conv_id, turn, " + _TOK + " AS w FROM conversations), b AS (SELECT conv_id, turn, [w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)] AS b FROM w), x AS (SELECT conv_id, turn, g, count(*) AS c FROM (SELECT conv_id, turn, unnest(b) AS g FROM b) u GROUP BY ALL), o AS (SELECT a.conv_id, a.turn, sum(least(a.c, z.c)) AS o FROM x a JOIN x z ON z.conv_id = a.conv_id AND z.turn = a.turn + 1 AND z.g = a.g GROUP BY ALL) SELECT a.conv_id, a.turn, CASE WHEN len(a.b) + len(z.b) > 0 THEN round(2::DOUBLE * coalesce(o.o, 0) / (len(a.b) + len(z.b)), 8) ELSE 0 END AS f1 FROM b a JOIN b z ON z.conv_id = a.conv_id AND z.turn = a.turn + 1 LEFT JOIN o ON o.conv_id = a.conv_id AND o.turn = a.turn",
    "stream_tumbling": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY strftime(ts, '%Y-%m-%d'), event_type",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (benchmark_contains, quarantine_propagation, split_exact_groups, split_partition_stats, split_leakage_audit, components_recursive, component_sizes, bigram_f1, wer_pairs, nearest_centroid, cosine_topk, knn_1, ridge_holdout, ood_threshold, flood_fill_boxes, gram_matrix, cycle_check, reachability, stream_tumbling, stream_ledger)
    return {f.__name__: f for f in made}
