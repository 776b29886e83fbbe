"""Scalar text functions as columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(x: Column) -> Column:
    """Lower case, with the sharp s written out."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def tokens(x: Column) -> Column:
    """Maximal runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(x), F.lit(r"([\p{L}\p{N}]+)"), 1)


def normalised(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by a space; none if there are fewer words."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, w: acc + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def f1(common: Column, guessed: Column, wanted: Column) -> Column:
    total = guessed + wanted
    return F.when(total > 0, F.round(2.0 * common / total, 8)).otherwise(0.0)


def hash_fold(x: Column, folds: int) -> Column:
    """A fold by the first 48 bits of sha256 of the text."""
    return (F.conv(F.substring(F.sha2(x, 256), 1, 12), 16, 10).cast("long") % folds).cast("long")
