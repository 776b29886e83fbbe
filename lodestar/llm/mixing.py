"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Targets: the sources, in code point order with null last, share the size of all documents by weight;
no source's target passes ``most`` times its own size, and what that leaves over is shared again by
weight until no target passes its bound (water filling, solved in closed form over the sorted ratios).

Selection: each source first takes as many complete epochs as its target holds. The rest of the
target is filled by documents in the order of exponential keys -ln(u)/w, w a document's quality
weight and u drawn from its id, so that reruns agree. Keys are dealt to buckets; a prefix sum over
buckets finds the one in which a source's budget ends, and only that bucket's rows are sorted.
Documents before the end are taken whole, the one that crosses it up to the budget.

Null texts have size 0 and are taken 0 words; an empty table gives an empty result; rows that repeat
an id are told apart by their text's digest where their order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.llm.common import WORD, materialise, small

#: Times its size that a source, and a document, is taken at most.
MOST = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = "mix") -> Column:
    """A number in (0, 1) that depends on the key alone: 48 bits of its md5, plus a half."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**48))


def targets(sizes: DataFrame, source: str = "source", most: int = MOST, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source with its size, to the same with target. sizes holds a row for each source."""
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1) % len(cycle) + 1).cast("int")).cast("long")
    w = sizes.withColumn("_w", weight)
    cap = F.col("source_size") * most
    by_ratio = W.orderBy(cap / F.col("_w"), F.col(source).asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    w = w.withColumn("_all", F.sum("source_size").over(every)).withColumn("_capped", F.coalesce(F.sum(cap).over(before), F.lit(0)))
    w = w.withColumn("_open", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    level = (F.col("_all") - F.col("_capped")) / F.col("_open").cast("double")
    # from the first source on whose bound lies above the level, all get the level's share
    w = w.withColumn("_level", F.min(F.when(level * F.col("_w") <= cap, F.struct((cap / F.col("_w")).alias("ratio"), (F.col("_all") - F.col("_capped")).alias("rest"), F.col("_open").alias("open")))).over(every))
    share = (F.col("_level.rest") * F.col("_w")) / F.col("_level.open").cast("double")
    return w.select(source, "source_size", F.coalesce(F.least(share, cap.cast("double")), cap.cast("double"), F.lit(0.0)).alias("target"))


def mix(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    quality: Column | None = None,
    keep: list[str] | None = None,
    most: int = MOST,
    cycle: tuple[int, ...] = (1, 2, 3),
    seed: str = "mix",
) -> DataFrame:
    """Per row of docs: key, source, size, source_size, target, taken (words, repeats counted),
    epochs (complete ones) and, as a struct ``row``, the columns to keep.

    size: the row's words, by default those of its ``text``. quality: a positive weight, 1 if none or
    null. Without columns to keep, ids, sizes and keys are worked out once and written to the shared
    folder; with them, texts are counted again in each of the three passes rather than moved."""
    weight = F.greatest(F.coalesce(quality, F.lit(1.0)), F.lit(1e-6)) if quality is not None else F.lit(1.0)
    row = [F.struct(*keep).alias("row")] if keep else []
    d = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), (words(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")).alias("size"), (-F.log(uniform(F.col(key), seed)) / weight).alias("_es"), *row)
    if not keep:
        d, _ = materialise(spark, d, "mix-rows")
    sizes = d.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    sizes, _ = materialise(spark, sizes, "mix-sources")
    n = sizes.count()
    goal = targets(sizes.select("_source", "source_size"), "_source", most, cycle).withColumnRenamed("_source", "_s")
    goal = goal.join(sizes.select(F.col("_source").alias("_s2"), "_rows"), F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    goal = goal.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("_rest", F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    goal = goal.withColumn("_buckets", F.greatest(F.lit(1024), F.ceil(F.sqrt("_rows"))).cast("long")).drop("_rows")
    goal, _ = materialise(spark, goal, "mix-targets")
    bucket = F.floor(F.col("_es") / (F.col("_es") + 1) * F.col("_buckets")).cast("long")
    d = d.join(small(goal, n), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_bucket", bucket)
    sums = d.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"), F.first("_rest").alias("_rest"))
    upto = F.sum("_sum").over(W.partitionBy("_source").orderBy("_bucket"))
    ends = sums.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_sum") <= F.col("_rest")))
    ends = ends.groupBy(F.col("_source").alias("_s")).agg(F.min(F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("_before"))).alias("_end"))
    ends, _ = materialise(spark, ends, "mix-ends")
    d = d.join(small(ends, n), F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    whole = F.col("_end").isNull() | (F.col("_bucket") < F.col("_end._bucket"))
    easy = d.where(whole | (F.col("_bucket") > F.col("_end._bucket"))).withColumn("_part", F.when(whole & (F.col("_rest") > 0), F.col("size")).otherwise(0).cast("long"))
    order = W.partitionBy("_source").orderBy("_es", "_key", "size").rowsBetween(W.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_end._before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    hard = d.where(F.col("_bucket") == F.col("_end._bucket")).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    taken = (F.col("_epochs") * F.col("size") + F.col("_part")).cast("long").alias("taken")
    return easy.unionByName(hard).select(F.col("_key").alias(key), F.col("_source").alias(source), "size", "source_size", "target", taken, F.col("_epochs").alias("epochs"), *(["row"] if keep else []))
