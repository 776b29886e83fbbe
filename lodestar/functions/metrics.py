"""Text metrics as columns, worked out in the JVM: n-gram overlap, chrF in two forms, BLEU, error rates.

Texts are compared row by row; nothing here shuffles. Null texts count as empty ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Orders of character n-grams of both chrF forms, and of word n-grams of BLEU.
CHAR_ORDERS, WORD_ORDERS = 6, 4


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _empty(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def characters(x: Column) -> Column:
    return F.when(F.char_length(x) > 0, F.split(x, "")).otherwise(_empty())


def runs_of(parts: Column, n: int, between: str) -> Column:
    """Runs of n elements, joined. The array should be bound by let() or be a column: it is used for each run."""
    return F.when(F.size(parts) >= n, F.transform(F.sequence(F.lit(1), F.size(parts) - n + 1), lambda i: F.array_join(F.slice(parts, i, n), between))).otherwise(_empty())


def numbered(grams: Column) -> Column:
    """Each element with its number among its equals, so that no two are equal: runs of the sorted array,
    each from the end of the one before it."""

    def runs(s: Column) -> Column:
        last = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        each = lambda e: F.flatten(F.transform(e, lambda i, k: F.transform(F.sequence(F.lit(1), i - F.coalesce(F.get(e, k - 1), F.lit(0))), lambda j: F.concat_ws(" ", F.get(s, i - 1), j))))
        return F.when(F.size(s) > 0, let(last, each)).otherwise(_empty())

    return let(F.array_sort(grams), runs)


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings, by hashing."""
    return F.size(F.array_intersect(numbered(a), numbered(b)))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b = beta * beta
    return F.when(p + r > 0, (1 + b) * p * r / (b * p + r)).otherwise(F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _orders(guess: Column, target: Column) -> Column:
    """Precision and recall of each character order of two arrays of characters."""

    def one(n: int) -> Column:
        return let(
            F.struct(runs_of(guess, n, "").alias("g"), runs_of(target, n, "").alias("t")),
            lambda x: let(multiset_overlap(x["g"], x["t"]).cast("double"), lambda o: F.struct(_ratio(o, F.size(x["g"])).alias("p"), _ratio(o, F.size(x["t"])).alias("r"))),
        )

    return F.array(*(one(n) for n in range(1, CHAR_ORDERS + 1)))


def _both(guess: Column, target: Column) -> Column:
    return F.struct(characters(guess).alias("g"), characters(target).alias("t"))


def chrf2(guess: Column, target: Column) -> Column:
    """Folded texts with white space collapsed and kept; precision and recall are averaged over the orders,
    empty ones as zero; beta 2."""
    clean = lambda x: F.trim(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", " "))
    mean = lambda o, k: F.aggregate(o, F.lit(0.0), lambda s, x: s + x[k]) / CHAR_ORDERS
    score = lambda o: let(F.struct(mean(o, "p").alias("p"), mean(o, "r").alias("r")), lambda x: F.round(f_beta(x["p"], x["r"], 2), 8))
    return let(let(_both(clean(guess), clean(target)), lambda c: _orders(c["g"], c["t"])), score)


def chrf(guess: Column, target: Column) -> Column:
    """Lower-cased texts without white space; F of beta 2 of each order, averaged over the orders where it
    is above zero."""
    clean = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"\s+", "")
    scores = lambda o: F.filter(F.transform(o, lambda x: f_beta(x["p"], x["r"], 2)), lambda f: f > 0)
    mean = lambda f: F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda s, x: s + x) / F.size(f)).otherwise(F.lit(0.0))
    return let(let(let(_both(clean(guess), clean(target)), lambda c: _orders(c["g"], c["t"])), scores), lambda f: F.round(mean(f), 4))


def words(x: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != "")


def bleu(guess: Column, target: Column) -> Column:
    """Sentence BLEU-4 with one added to clipped counts and totals; a guess too short for an order stops
    there; the penalty of brevity is exp(1 - target/guess)."""

    def score(x: Column) -> Column:
        g, t = x["g"], x["t"]
        logs = F.array(*(F.when(F.size(g) >= n, F.ln((let(F.struct(runs_of(g, n, " ").alias("a"), runs_of(t, n, " ").alias("b")), lambda m: multiset_overlap(m["a"], m["b"])) + 1.0) / (F.size(g) - n + 2))) for n in range(1, WORD_ORDERS + 1)))
        mean = let(F.filter(logs, lambda v: v.isNotNull()), lambda v: F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / F.size(v))
        brevity = F.when(F.size(g) > F.size(t), F.lit(1.0)).otherwise(F.exp(1.0 - F.size(t) / F.size(g)))
        return F.when((F.size(g) > 0) & (F.size(t) > 0), F.round(brevity * F.exp(mean), 4)).otherwise(F.lit(0.0))

    return let(F.struct(words(guess).alias("g"), words(target).alias("t")), score)


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings: words become characters of their own (code points from 65536
    on, some million), which the built-in distance then counts."""

    def coded(all_: Column, x: Column) -> Column:
        return F.decode(F.unhex(F.array_join(F.transform(x, lambda w: F.lpad(F.hex(F.array_position(all_, w) + 65535), 8, "0")), "")), "UTF-32")

    return let(F.array_distinct(F.concat(a, b)), lambda u: F.levenshtein(coded(u, a), coded(u, b)))


def error_rate(distance: Column, size: Column, guessed: Column) -> Column:
    """Distance over the target's size; against an empty target 0 for an empty guess, else 1."""
    return F.when(size > 0, F.round(distance / size, 8)).otherwise((guessed > 0).cast("double"))


def cer(guess: Column, target: Column) -> Column:
    """Character error rate of stripped texts."""
    g, t = (F.trim(F.coalesce(x, F.lit(""))) for x in (guess, target))
    return error_rate(F.levenshtein(g, t), F.char_length(t), F.char_length(g))


def sequence_score(guess: Column, targets: Column) -> Column:
    """The best of 1 - distance/size over several targets, zero at least."""
    g = F.trim(F.coalesce(guess, F.lit("")))
    rate = F.array_min(F.transform(targets, lambda t: F.levenshtein(g, t) / F.greatest(F.char_length(t), F.lit(1))))
    return F.round(F.greatest(F.lit(0.0), 1 - F.coalesce(rate, F.lit(1.0))), 8)


def repeats(x: Column) -> Column:
    """Whether a text ends in a loop: its last four chunks of one, two or three words are equal, or five
    equal characters follow each other anywhere."""

    def looped(w: Column) -> Column:
        tail = lambda n: F.when(F.size(w) >= 4 * n, F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.array_join(F.slice(w, F.size(w) - k * n + 1, n), " ")))) == 1).otherwise(F.lit(False))
        return tail(1) | tail(2) | tail(3)

    return let(words(x), looped) | F.coalesce(x, F.lit("")).rlike(r"(.)\1{4}")
