"""A corpus through five of the training-data operators: STAGES, run() and its SQL, of which there is
none (learned stages). Each stage is written as Parquet by the caller and read as the next one's docs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, jaccard, line_dedup, mixing, toxicity
from lodestar.llm.common import drop, held_out, materialise, small, table
from lodestar.llm.queries import quality_weight

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 5))
    model = toxicity.train(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model, out="_score").where("_score < 0.5").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; every document stays, with what is left of its text."""
    return line_dedup.dedup(spark, docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows the one of the smallest id stays (a null id counts as the
    largest). Rows are told apart by id and text, so one that shares an id with a duplicate is judged
    by its own text; rows without words stay, repeated or not."""
    docs = docs.select(*COLUMNS, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("_row"))
    found = jaccard.jaccard_components(spark, docs.select("_row", "text"), key="_row")
    groups = found.where("n_shingles > 0").groupBy("_row").agg(F.min("component_id").alias("group"), F.count("*").alias("rows"))
    rows, p_rows = materialise(spark, groups.where((F.col("group") != F.col("_row")) | (F.col("rows") > 1)), "near-rows")
    # whoever is in a group of several: all its rows but the kept one go, and the kept one stays once
    several, p_several = materialise(spark, rows.select("group").union(rows.select("_row")).distinct().withColumnRenamed("group", "_row"), "near-several")
    ids = docs.select("_row", "doc_id").join(small(several, several.count()), "_row", "left_semi").distinct()
    of = ids.join(groups.select("_row", "group"), "_row")
    kept = of.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("best")).select(F.col("best._row").alias("_row"))
    kept, p_kept = materialise(spark, kept.distinct(), "near-kept")
    n = several.count()
    alone = docs.join(small(several, n), "_row", "left_anti").select(*COLUMNS)
    once = docs.join(small(kept, n), "_row", "left_semi").dropDuplicates(["_row"]).select(*COLUMNS)
    out, _ = materialise(spark, alone.unionByName(once), "near-result")
    drop(spark, p_rows, p_several, p_kept)
    return out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them in whole epochs, and once more where the rest of the
    source's target takes most of them; by quality where labelled, as in op9."""
    weighed = quality_weight(spark, docs.select(*COLUMNS), sf_dir)
    out = mixing.mix(spark, weighed, quality=F.col("weight"), keep=COLUMNS)
    times = F.col("epochs") + (2 * (F.col("taken") - F.col("epochs") * F.col("size")) > F.col("size")).cast("int")
    return out.withColumn("_n", times.cast("int")).where("_n > 0").select("row.*", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_n")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of ids and decoded bytes."""
    return bpe.digests(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, cache_words=80_000, chunk_bytes=2_000_000)


STAGES = [("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("mixing sources to target weights", mix), ("byte-level BPE encoding and decoding", encode)]

#: The first stage is a learned model; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, paths = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs, path = materialise(spark, stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop(spark, *paths)
        paths = [path]
    return docs
