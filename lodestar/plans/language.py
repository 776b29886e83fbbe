"""Named queries of text metrics and normalisation over pairs of successive turns, with SQL of their own."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import metrics as m
from lodestar.operators import neighbour
from lodestar.sources.tables import table


def nfc(x: Column) -> Column:
    """Canonical composition; texts of ASCII alone pass by the Python workers' part of the work."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return compose(x)


def profiles(x: Column) -> dict[str, Column]:
    """The four normalisation profiles: as it is; composed; composed with line ends and trailing blanks
    cleaned; composed, lower-cased, and white space collapsed, for comparison."""
    composed = nfc(x)
    return {
        "identity": x,
        "nfc": composed,
        "diplomatic": F.regexp_replace(F.regexp_replace(composed, "\r\n?", "\n"), "[ \t]+(\n|$)", "$1"),
        "compare": F.trim(F.regexp_replace(F.lower(composed), r"[ \t\r\n]+", " ")),
    }


def _turns(spark: SparkSession, root: str) -> DataFrame:
    """conv_id, turn, g, t: each turn's text and the next one's."""
    c = table(spark, root, "conversations")
    return c.select("conv_id", "turn", F.col("text").alias("g")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t")), ["conv_id", "turn"])


def _by_turn(spark: SparkSession, root: str, **made: Column) -> DataFrame:
    return _turns(spark, root).select("conv_id", "turn", *(c.alias(n) for n, c in made.items()))


def chrf2_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _by_turn(spark, root, chrf2=m.chrf2(F.col("g"), F.col("t")))


def chrf_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _by_turn(spark, root, chrf=m.chrf(F.col("g"), F.col("t")))


def bleu_pairs(spark: SparkSession, root: str) -> DataFrame:
    return _by_turn(spark, root, bleu=m.bleu(F.col("g"), F.col("t")))


def _ascii(c: str) -> Column:
    """Without what is not ASCII, as SQL engines differ in what a distance counts there."""
    return F.regexp_replace(F.col(c), "[^\\x00-\\x7F]", "")


def cer_ascii(spark: SparkSession, root: str) -> DataFrame:
    return _by_turn(spark, root, cer=m.cer(_ascii("g"), _ascii("t")))


def sequence_scores(spark: SparkSession, root: str) -> DataFrame:
    """Each turn against the next one and its lower-cased form, the better of the two."""
    return _by_turn(spark, root, score=m.sequence_score(_ascii("g"), F.array(_ascii("t"), F.lower(_ascii("t")))))


def repetition_loops(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", m.repeats(F.col("text")).cast("int").alias("loops"))


def normalisation_profiles(spark: SparkSession, root: str) -> DataFrame:
    made = profiles(F.col("text"))
    return table(spark, root, "documents").select("doc_id", *(F.sha2(c, 256).alias(n) for n, c in made.items()))


def canonical_json(spark: SparkSession, root: str) -> DataFrame:
    """Digest of each row's JSON with sorted keys and no blanks."""
    row = F.to_json(F.struct("doc_id", "lang", "n_chars", "source"))
    return table(spark, root, "documents").select("doc_id", F.sha2(row, 256).alias("digest"))


def tfidf_neighbour(spark: SparkSession, root: str) -> DataFrame:
    """What the SQL of ``rules`` says, without pairing all turns that share a word."""
    found = neighbour.weighted_neighbour(spark, table(spark, root, "conversations"))
    return found.withColumn("route", F.when(F.col("score") >= 0.3, "retrieved").otherwise("gloss"))


_PAIRS = "SELECT a.conv_id, a.turn, {g} AS g, {t} AS t FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1"
_KEEP = r"trim(regexp_replace(lower({0}.text), '\s+', ' ', 'g'))"
_DROP = r"regexp_replace(lower({0}.text), '\s+', '', 'g')"


def _chrf_sql(clean: str) -> str:
    side = lambda x: f"SELECT conv_id, turn, n, substr({x}, i, n) AS gram, count(*) AS c FROM (SELECT *, unnest(generate_series(1, greatest(length({x}) - n + 1, 0))) AS i FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n) o) e GROUP BY ALL"
    return (
        f"WITH p AS ({_PAIRS.format(g=clean.format('a'), t=clean.format('b'))}), g AS ({side('g')}), t AS ({side('t')}), "
        "o AS (SELECT g.conv_id, g.turn, g.n, sum(least(g.c, t.c)) AS c FROM g JOIN t USING (conv_id, turn, n, gram) GROUP BY ALL), "
        "s AS (SELECT p.conv_id, p.turn, n, greatest(length(p.g) - n + 1, 0) AS a, greatest(length(p.t) - n + 1, 0) AS b FROM p CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n) q), "
        "r AS (SELECT s.conv_id, s.turn, s.n, CASE WHEN a > 0 THEN coalesce(o.c, 0)::DOUBLE / a ELSE 0 END AS p, CASE WHEN b > 0 THEN coalesce(o.c, 0)::DOUBLE / b ELSE 0 END AS r FROM s LEFT JOIN o USING (conv_id, turn, n)) "
    )


_LOOP = "SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\\s+') IF x <> ''] AS w, string_split(coalesce(text, ''), '') AS c FROM documents"
_TAIL = "(len(w) >= {0} AND len(list_distinct([array_to_string(w[len(w) - k * {1} + 1 : len(w) - k * {1} + {1}], ' ') FOR k IN [1, 2, 3, 4]])) = 1)"

ORACLE = {
    "chrf2_pairs": _chrf_sql(_KEEP) + "SELECT conv_id, turn, round(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) ELSE 0 END, 8) AS chrf2 FROM (SELECT conv_id, turn, sum(p) / 6 AS p, sum(r) / 6 AS r FROM r GROUP BY ALL) x",
    "chrf_pairs": _chrf_sql(_DROP) + "SELECT conv_id, turn, round(coalesce(avg(CASE WHEN p + r > 0 THEN 5 * p * r / (4 * p + r) END), 0), 4) AS chrf FROM r GROUP BY ALL",
    "bleu_pairs": "WITH p AS (SELECT conv_id, turn, [x FOR x IN regexp_split_to_array(g, '\\s+') IF x <> ''] AS g, [x FOR x IN regexp_split_to_array(t, '\\s+') IF x <> ''] AS t FROM (" + _PAIRS.format(g="lower(a.text)", t="lower(b.text)") + ") z), n AS (SELECT unnest([1, 2, 3, 4]) AS n), "
    "g AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM (SELECT conv_id, turn, n, unnest([array_to_string(g[i : i + n - 1], ' ') FOR i IN generate_series(1, len(g) - n + 1)]) AS gram FROM p CROSS JOIN n WHERE len(g) >= n) x GROUP BY ALL), "
    "t AS (SELECT conv_id, turn, n, gram, count(*) AS c FROM (SELECT conv_id, turn, n, unnest([array_to_string(t[i : i + n - 1], ' ') FOR i IN generate_series(1, len(t) - n + 1)]) AS gram FROM p CROSS JOIN n WHERE len(t) >= n) x GROUP BY ALL), "
    "o AS (SELECT conv_id, turn, n, sum(least(g.c, t.c)) AS c FROM g JOIN t USING (conv_id, turn, n, gram) GROUP BY ALL), "
    "s AS (SELECT p.conv_id, p.turn, len(g) AS a, len(t) AS b, avg(CASE WHEN len(g) >= n.n THEN ln((coalesce(o.c, 0) + 1)::DOUBLE / (len(g) - n.n + 2)) END) AS m FROM p CROSS JOIN n LEFT JOIN o ON o.conv_id = p.conv_id AND o.turn = p.turn AND o.n = n.n GROUP BY ALL) "
    "SELECT conv_id, turn, CASE WHEN a > 0 AND b > 0 THEN round(CASE WHEN a > b THEN 1 ELSE exp(1 - b::DOUBLE / a) END * exp(m), 4) ELSE 0 END AS bleu FROM s",
    "cer_ascii": "WITH p AS (SELECT conv_id, turn, trim(g) AS g, trim(t) AS t FROM (" + _PAIRS.format(g="regexp_replace(a.text, '[^\\x00-\\x7F]', '', 'g')", t="regexp_replace(b.text, '[^\\x00-\\x7F]', '', 'g')") + ") z) SELECT conv_id, turn, CASE WHEN length(t) > 0 THEN round(levenshtein(g, t)::DOUBLE / length(t), 8) WHEN length(g) > 0 THEN 1 ELSE 0 END AS cer FROM p",
    "sequence_scores": "WITH p AS (" + _PAIRS.format(g="trim(regexp_replace(a.text, '[^\\x00-\\x7F]', '', 'g'))", t="regexp_replace(b.text, '[^\\x00-\\x7F]', '', 'g')") + ") SELECT conv_id, turn, round(greatest(0, 1 - least(levenshtein(g, t), levenshtein(g, lower(t)))::DOUBLE / greatest(length(t), 1)), 8) AS score FROM p",
    "repetition_loops": f"SELECT doc_id, CASE WHEN {_TAIL.format(4, 1)} OR {_TAIL.format(8, 2)} OR {_TAIL.format(12, 3)} OR len([i FOR i IN generate_series(1, len(c) - 4) IF c[i] <> chr(10) AND c[i] = c[i + 1] AND c[i] = c[i + 2] AND c[i] = c[i + 3] AND c[i] = c[i + 4]]) > 0 THEN 1 ELSE 0 END AS loops FROM ({_LOOP}) z",
    "normalisation_profiles": "SELECT doc_id, sha256(text) AS identity, sha256(nfc_normalize(text)) AS nfc, sha256(regexp_replace(regexp_replace(nfc_normalize(text), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g')) AS diplomatic, sha256(trim(regexp_replace(lower(nfc_normalize(text)), '[ \\t\\r\\n]+', ' ', 'g'))) AS compare FROM documents",
    "canonical_json": """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}') AS digest FROM documents""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (chrf2_pairs, chrf_pairs, bleu_pairs, cer_ascii, sequence_scores, repetition_loops, normalisation_profiles, canonical_json, tfidf_neighbour)}
