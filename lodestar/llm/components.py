"""Connected components of a table of links, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, materialise


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: columns a, b (long, both non-null, either order). Returns node, comp (smallest node that
    links reach) for every node of a link. Each round is written to the shared folder, so no lineage
    builds up; the only thing that reaches the driver is whether a label changed. An empty table
    gives an empty result."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both, p_edges = materialise(spark, both, "cc-links")
    labels, path = materialise(spark, both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), "cc-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("comp").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        step = step.join(up, "comp", "left").select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
        step, new = materialise(spark, step, "cc-labels")
        changed = not step.where("comp <> old").isEmpty()
        drop(spark, path)
        labels, path = step.select("node", "comp"), new
        if not changed:
            drop(spark, p_edges)
            return labels
