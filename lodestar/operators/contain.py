"""Which documents hold which passages, by an index of word runs instead of a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import tokens

#: Words of the run by which a passage is looked up.
RUN = 5


def _runs(words: Column) -> Column:
    n = F.size(words) - RUN + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, RUN))))).otherwise(F.array().cast("array<bigint>"))


def contained(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """doc_id, item_id pairs where the document holds the passage as it stands. A passage's second to
    sixth word lie whole inside it, so a document that holds it has the same run of words; what meets
    there is compared in full. Passages too short for such a run are compared with every document;
    there is such a step only if there are any. Only hashes are shuffled, and texts of candidates."""
    p = passages.select("item_id", F.col("text").alias("passage"), tokens(F.col("text")).alias("w"))
    long = p.where(F.size("w") >= RUN + 2).select("item_id", F.xxhash64(F.slice("w", 2, RUN)).alias("run"))
    runs = docs.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.explode(_runs(F.col("w"))).alias("run"))
    met = runs.join(long, "run").select("doc_id", "item_id").distinct()
    texts, wanted = docs.select("doc_id", "text"), p.select("item_id", "passage")
    out = met.join(wanted, "item_id").join(texts, "doc_id").where(F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id").distinct()
    short = p.where(F.size("w") < RUN + 2)
    if not short.isEmpty():
        out = out.union(texts.join(short.select("item_id", "passage"), F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id").distinct())
    return out
