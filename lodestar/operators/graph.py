"""Graph operators over edge tables: components, reachability, cycles."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The folder of checkpoints, which is the one that the cluster names, if it does."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def _cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """End the lineage by a reliable checkpoint."""
    _folder(spark)
    return df.checkpoint()


def components(spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable): minimum labels with pointer jumping. nodes: a
    column node; edges: a, b."""
    both = _cut(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = nodes.select("node", F.col("node").alias("component")).distinct()
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        step = _cut(spark, step.join(up, "component").select("node", "old", F.least("component", "up").alias("component")))
        labels = step.select("node", "component")
        if step.where("component <> old").isEmpty():
            return labels


def by_shared_keys(spark: SparkSession, rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Components of rows that share any key. keys: node, key. Every key links its nodes to its least
    one, so a key of m nodes makes m edges."""
    least = keys.groupBy("key").agg(F.min("node").alias("a"))
    return components(spark, rows, keys.join(least, "key").select("a", F.col("node").alias("b")).where("a <> b"))


def reachable(spark: SparkSession, edges: DataFrame, start: DataFrame) -> DataFrame:
    """Nodes reachable from start (column node) along a -> b, with the fewest steps."""
    seen = start.select("node", F.lit(0).cast("long").alias("steps")).distinct()
    front, n = seen, 0
    while not front.isEmpty():
        n += 1
        front = _cut(spark, edges.join(front.withColumnRenamed("node", "a"), "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("steps", F.lit(n).cast("long")))
        seen = _cut(spark, seen.union(front))
    return seen


def cyclic(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """Nodes that no order of the graph can place: what is left after taking away nodes that nothing
    leads to, again and again."""
    left = _cut(spark, edges.select("a", "b").distinct())
    while True:
        less = _cut(spark, left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi"))
        if less.count() == left.count():
            return less.select(F.col("a").alias("node")).union(less.select("b")).distinct()
        left = less
