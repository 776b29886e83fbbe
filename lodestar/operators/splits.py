"""Leakage-aware splits: groups, quarantine, stratified allocation, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.functions.text import hash_fold, normalised
from lodestar.operators import graph
from lodestar.operators.contain import contained


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id: the least id among documents of equal normalised text (and so of equal text)."""
    keyed = docs.select("doc_id", F.sha2(normalised(F.col("text")), 256).alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("group_id")), "key").select("doc_id", "group_id")


def linked(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, group_id: components of documents that share a text, a normalised text, or both."""
    keys = docs.select(F.col("doc_id").alias("node"), F.explode(F.array(F.sha2("text", 256), F.sha2(normalised(F.col("text")), 256))).alias("key"))
    return graph.by_shared_keys(spark, docs.select(F.col("doc_id").alias("node")), keys).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def allocate(units: DataFrame, id_: str, stratum: str, ratios: dict[str, float], seed: str) -> DataFrame:
    """units with a partition: in each stratum, units in the order of a seeded hash fill the parts'
    quotas; what rounding leaves goes one each to the largest remainders, in declared order."""
    order = W.partitionBy(stratum).orderBy(F.sha2(F.concat_ws("|", F.lit(seed), F.col(stratum), F.col(id_).cast("string")), 256), id_)
    n = F.count("*").over(W.partitionBy(stratum))
    parts = [(k, name, r) for k, (name, r) in enumerate(ratios.items())]
    base = [F.floor(F.col("_n") * r).cast("long") for _, _, r in parts]
    left = F.col("_n") - sum(base[1:], base[0])
    fraction = F.array_sort(F.array(*(F.struct((-(F.round(F.col("_n") * r - b, 9))).alias("f"), F.lit(k).alias("k")) for (k, _, r), b in zip(parts, base, strict=True))))
    place = F.transform(fraction, lambda x: x["k"])
    bound: Column = F.lit(0).cast("long")
    choice = F.when(F.lit(False), F.lit(""))
    for k, name, _ in parts:
        bound = bound + base[k] + (F.array_position(place, F.lit(k)) <= left).cast("long")
        choice = choice.when(F.col("_i") <= bound, name)
    return units.withColumn("_n", n).withColumn("_i", F.row_number().over(order)).withColumn("partition", choice).drop("_n", "_i")


def split(spark: SparkSession, docs: DataFrame, passages: DataFrame, seed: str = "seed") -> DataFrame:
    """doc_id, group_id, partition, reason: groups that touch a held-out passage are excluded whole;
    the others are allocated 60/20/20 by their smallest language."""
    of = groups(docs)
    hit = contained(docs, passages).select("doc_id").distinct().withColumn("hit", F.lit(True))
    rows = docs.select("doc_id", "lang").join(of, "doc_id").join(hit, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    units = rows.groupBy("group_id").agg(F.min("lang").alias("stratum"), F.count("*").alias("size"), F.count_if("hit").alias("hits"))
    bad = units.where("hits > 0").select("group_id", F.lit("excluded").alias("partition"), F.when(F.col("hits") == F.col("size"), "quarantine").otherwise("linked_to_quarantine").alias("reason"))
    good = allocate(units.where("hits = 0").select("group_id", "stratum"), "group_id", "stratum", {"train": 0.6, "dev": 0.2, "test": 0.2}, seed)
    placed = bad.unionByName(good.select("group_id", "partition", F.lit("allocated").alias("reason")))
    return of.join(placed, "group_id").select("doc_id", "group_id", "partition", "reason")


def crossing(assigned: DataFrame, group: str = "group_id") -> DataFrame:
    """Groups that lie in more than one partition, excluded ones aside: a leak."""
    n = assigned.where("partition <> 'excluded'").groupBy(group).agg(F.count_distinct("partition").alias("partitions"))
    return n.where("partitions > 1")


def fold_of(docs: DataFrame, key: str, folds: int) -> DataFrame:
    return docs.withColumn("fold", hash_fold(F.col(key).cast("string"), folds))
