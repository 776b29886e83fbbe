"""The opN_<name> queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, html_extract, ivfpq, jaccard, line_dedup, lm, mixing, mtree, token_counts, toxicity
from lodestar.llm.common import held_out, small, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id"), 5)))
    out = toxicity.score_ids(docs, model, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id"), 5).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(spark, table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_tokens: greedy longest-match pieces of every word of every document, over
    the tokens of the public byte-level vocabulary (a word is led by one space)."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


OP7_SQL = """
WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, n_chars and kept_sha256: what is left of each document's text."""
    out = line_dedup.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_dropped", F.char_length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("kept_sha256"))


def quality_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with a column weight: 2 for documents labelled as good, 0.5 as bad, else 1. The labels are
    counted first, so that texts are not shuffled where the labels are few."""
    labels = table(spark, sf_dir, "labels")
    rows = labels.count()
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return docs.join(small(labels, rows), "doc_id", "left").withColumn("weight", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0)).drop("quality")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.words(F.col("text")).alias("words"))
    docs = quality_weight(spark, docs, sf_dir)
    out = mixing.mix(spark, docs, size=F.col("words"), quality=F.col("weight"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op10_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivfpq.search(spark, table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


OP9_SQL = r"""
WITH d AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
      / CASE l.quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS es
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS w FROM s),
c AS (SELECT *, 3 * source_size AS cap, 3 * source_size / CAST(w AS DOUBLE) AS ratio, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
r AS (SELECT *, total - CAST(coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS left_over,
    CAST(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w FROM c),
f AS (SELECT left_over AS lo, open_w AS ow FROM r WHERE left_over / CAST(open_w AS DOUBLE) * w <= cap ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least((lo * w) / CAST(ow AS DOUBLE), CAST(cap AS DOUBLE)) AS target FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (SELECT *, CAST(round(target - epochs * source_size) AS BIGINT) AS rest FROM e),
p AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.epochs, g.rest,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.es, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_html_text, op3_ngram_jaccard, op4_token_counts, op5_lm_score, op6_byte_bpe, op7_exact_top_k, op8_line_dedup, op9_source_mix, op10_ivf_pq)}


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_top_k": OP7_SQL, "op9_source_mix": OP9_SQL}
