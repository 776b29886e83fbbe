"""Line dedup by a segment-partition edit join, in DataFrame operations only.

Lines that are equal, or within one edit (a character changed, added or left out) if they have
``least`` characters or more, form classes; of each class the first line in order of document and
position stays, the others go. A line is split into threshold + 1 = 2 segments; a line within the
threshold has one of them unchanged, so it is found in the index of that segment by its own
substring at the place that the length allows (its own length, or one less). Candidates are verified
by banded bit-parallel edit distance.

No list of candidates is paired without a bound. Where a segment has more than ``MANY`` lines, the
rest of the line is split again: the edit lies in one of ``FINE`` pieces of it, and all around that
piece must agree too. Where such a list again has more than ``MANY`` lines (a template with one field
that varies), the piece is looked up by what is left of it without one character: lines that meet
there are within one edit, and are linked to one of them. So m lines of a template cost m.

Lines are told apart by a 64-bit hash (n distinct lines have about n*n/2^65 chance collisions); what
moves are hashes and numbers, and of texts only candidates'.

Blank lines always stay. A null or empty text stays as it is; null keys sort last; rows equal in key
and text are treated alike; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import drop, materialise, small
from lodestar.llm.components import components

#: Characters from which on lines within one edit are one; shorter ones must be equal.
LEAST = 32
#: Lines of a segment beyond which its lists are made finer, and pieces of the rest then.
MANY, FINE = 8, 8


def edit_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance of two strings if it is at most ``most`` (up to 15), else a larger number.

    Bit-parallel over a band of 2*most+1 diagonals: bit k of the vertical differences at column j
    stands for row j-most+k. The lowest diagonal's value is carried along; differences lead from it
    to the last cell. What lies outside the band only ever counts too much."""
    w = 2 * most + 1
    ones, top = (1 << w) - 1, 1 << (w - 1)
    m, n = F.char_length(a), F.char_length(b)
    let = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)  # noqa: E731  worked out once, however often f uses it
    bits = lambda *x: F.struct(*(v.cast("long").alias(k) for k, v in zip(("vp", "vn", "d"), x, strict=True)))

    def matches(p: Column) -> Column:
        """For each column, the bits of the rows whose character is its own."""
        bit = lambda c, j, k: F.when(F.get(p, j + (k - most)) == c, F.lit(1 << k)).otherwise(F.lit(0))
        return F.transform(F.split(b, ""), lambda c, j: sum((bit(c, j, k) for k in range(1, w)), bit(c, j, 0)).cast("long"))

    def step(state: Column, eq: Column) -> Column:
        vp, vn = state["vp"], state["vn"]
        d0 = ((eq.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(F.lit(ones))

        def rest(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.lit(ones).bitwiseXOR(d0.bitwiseOR(vp)))
            hn, down = d0.bitwiseAND(vp), F.shiftright(d0, 1)
            return bits(hn.bitwiseOR(F.lit(ones).bitwiseXOR(down.bitwiseOR(hp))), down.bitwiseAND(hp), state["d"] + F.when(d0.bitwiseAND(F.lit(top)) == 0, 1).otherwise(0))

        return let(d0, rest)

    start = bits(F.lit(ones ^ ((1 << most) - 1)), F.lit(0), F.lit(most))
    eqs = F.when(n > 0, let(F.split(a, ""), matches)).otherwise(F.array().cast("array<bigint>"))
    # rows m+1 .. n+most of the last column lie between the carried cell and the wanted one
    first = m - n + most
    mask = F.lit((1 << (2 * most)) - 1).cast("long").bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.greatest(first, F.lit(0))))
    last = lambda end: end["d"] - F.bit_count(end["vp"].bitwiseAND(mask)) + F.bit_count(end["vn"].bitwiseAND(mask))
    value = F.aggregate(eqs, start, step, last)
    return F.when(F.abs(m - n) > most, F.lit(most + 1).cast("long")).otherwise(value)


def _segment(line: Column, of: Column, side: int) -> Column:
    """The hash of one segment of a line, for the partition of lines of ``of`` characters."""
    half = F.floor(of / 2).cast("int")
    return F.xxhash64(of, F.lit(side), F.substr(line, F.lit(1), half) if side == 0 else F.right(line, of - half))


def _pieces(line: Column, of: Column, side: int) -> Column:
    """Hashes of all but one of the pieces of the rest of the line, piece by piece."""
    half = F.floor(of / 2).cast("int")
    start, size = (half, of - half) if side == 0 else (F.lit(0), half)
    cut = lambda k: start + F.floor(size * k / FINE).cast("int")
    return F.array(*(F.xxhash64(of, F.lit(2 + side * FINE + k), F.substr(line, F.lit(1), cut(k)), F.right(line, of - cut(k + 1))) for k in range(FINE)))


#: Each line is in the lists of both segments of its own length, and of lines a character shorter.
ROLES = [(own, side) for own in (True, False) for side in (0, 1)]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row (hash of key and text), doc, no, line; blank lines left out."""
    out = docs.select(F.xxhash64(F.col(key).cast("string"), F.col(text)).alias("row"), F.col(key).alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line"))
    return out.where(F.trim(F.col("line"), F.lit(" \t\r\x0b\x0c")) != "")


def _middle(line: Column, of: Column, side: int, k: int) -> Column:
    """What lies in piece k: the part that _pieces leaves out."""
    half = F.floor(of / 2).cast("int")
    start, size = (half, of - half) if side == 0 else (F.lit(0), half)
    cut = lambda j: start + F.floor(size * j / FINE).cast("int")
    return F.substr(line, cut(k) + 1, F.char_length(line) - cut(k) - (of - cut(k + 1)))


def _without(piece: Column) -> Column:
    """The piece without each of its characters in turn."""
    n = F.char_length(piece)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr(piece, F.lit(1), i - 1), F.substr(piece, i + 1, n)))).otherwise(F.array().cast("array<string>"))


def _variants(fine: DataFrame) -> DataFrame:
    """Links (a, b) of lists too long to pair. fine: key, id, own, middle, all around which the lines of a
    key agree. Lines of the key's own length that are equal but for the character at one place are one
    list; a line a character longer is linked to the line that it is without a character."""
    own = fine.where("own").select("key", "id", F.posexplode(_without(F.col("middle"))).alias("i", "v"))
    changed = own.groupBy("key", "i", F.xxhash64("v").alias("v")).agg(F.min("id").alias("a"), F.collect_set("id").alias("all")).where(F.size("all") > 1)
    changed = changed.select("a", F.explode("all").alias("b")).where("a <> b")
    longer = fine.where("not own").select("key", F.col("id").alias("b"), F.explode(F.array_distinct(_without(F.col("middle")))).alias("v"))
    added = fine.where("own").select("key", F.col("id").alias("a"), F.col("middle").alias("v")).join(longer, ["key", "v"]).select("a", "b")
    return changed.union(added).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(spark: SparkSession, lines: DataFrame, least: int = LEAST) -> tuple[DataFrame, str]:
    """Links (a, b) of hashed lines within one edit, and the path of their table. lines: a column line."""
    n = F.char_length("line")
    known = lines.where(n >= least).select(F.xxhash64("line").alias("id"), "line").withColumn("n", F.char_length("line"))
    length = lambda own: F.col("n") if own else F.col("n") - 1
    each = known.select("id", *(_segment(F.col("line"), length(own), side).alias(f"k{i}") for i, (own, side) in enumerate(ROLES))).dropDuplicates(["id"])
    each, p_each = materialise(spark, each, "lines-keys")
    rows = each.select("id", F.explode(F.array(*(F.struct(F.col(f"k{i}").alias("key"), F.lit(own).alias("own")) for i, (own, _) in enumerate(ROLES)))).alias("k")).select("id", "k.*")
    met = [F.count("*").alias("m"), F.bool_or("own").alias("any"), F.min("id").alias("lo"), F.max("id").alias("hi")]
    count = rows.groupBy("key").agg(*met).where("any and lo <> hi").select("key", "m")
    hits, p_hits = materialise(spark, rows.join(count, "key"), "lines-hits")
    wide, p_wide = materialise(spark, hits.where(F.col("m") > MANY).select("key", "id").distinct(), "lines-wide")
    ids = wide.select("id").distinct()
    again = known.join(small(ids, wide.count()), "id", "left_semi").dropDuplicates(["id"])
    roles = (F.struct(_segment(F.col("line"), length(own), side).alias("key"), F.lit(own).alias("own"), F.arrays_zip(_pieces(F.col("line"), length(own), side).alias("k"), F.array(*(_middle(F.col("line"), length(own), side, k) for k in range(FINE))).alias("middle")).alias("fine")) for own, side in ROLES)
    again = again.select("id", F.explode(F.array(*roles)).alias("k")).select("id", "k.*")
    fine, p_fine = materialise(spark, again.join(wide, ["id", "key"]).select("id", "own", F.explode("fine").alias("f")).select("f.k", "id", "own", "f.middle").withColumnRenamed("k", "key"), "lines-fine")
    open_fine, p_open = materialise(spark, fine.groupBy("key").agg(*met).where("any and lo <> hi").select("key", "m"), "lines-open")
    few = fine.join(open_fine.where(F.col("m") <= MANY), "key").select("key", "id", "own")
    exact, p_exact = materialise(spark, _variants(fine.join(open_fine.where(F.col("m") > MANY).select("key"), "key")), "lines-exact")
    lists = hits.where(F.col("m") <= MANY).select("key", "id", "own").unionByName(few)
    # at most MANY lines a list, so the pairs are in proportion to the lines
    members = lists.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("id", "own"))).alias("x"))
    a = members.select("x", F.posexplode("x").alias("i", "a"))
    pairs = a.select("a", F.explode(F.slice("x", F.col("i") + 2, F.lit(MANY))).alias("b")).where("(a.own or b.own) and a.id <> b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    pairs, p_pairs = materialise(spark, pairs, "lines-pairs")
    wanted, p_wanted = materialise(spark, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "lines-wanted")
    texts = known.join(small(wanted, wanted.count()), "id", "left_semi").dropDuplicates(["id"])
    texts, p_texts = materialise(spark, texts.select("id", "line"), "lines-texts")
    x = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("la")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("lb")), "b")
    near = x.where((F.abs(F.char_length("la") - F.char_length("lb")) <= 1) & (edit_distance(F.col("la"), F.col("lb"), 1) <= 1)).select("a", "b")
    out, p_out = materialise(spark, near.union(exact), "lines-links")
    drop(spark, p_each, p_hits, p_wide, p_fine, p_open, p_exact, p_pairs, p_wanted, p_texts)
    return out, p_out


def dedup(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """docs with the lines gone that repeat an earlier one, and columns n_lines (before) and n_dropped."""
    if clash := {"n_lines", "n_dropped", "_row", "_gone"} & set(docs.columns):
        raise ValueError(f"the input already has columns {sorted(clash)}; name them otherwise")
    lines = _lines(docs, key, text)
    links, p_links = classes(spark, lines.select("line"), least)
    comps = components(spark, links).withColumnRenamed("node", "id")
    place = F.struct(F.col("doc").isNull().alias("last"), F.col("doc"), F.col("row"), F.col("no"))
    each = lines.select(F.xxhash64("line").alias("id"), place.alias("at"))
    each, p_each = materialise(spark, each, "lines-places")
    firsts = each.groupBy("id").agg(F.min("at").alias("at"), F.count("*").alias("n"))
    named = firsts.join(comps, "id", "left").withColumn("linked", F.col("comp").isNotNull()).withColumn("comp", F.coalesce("comp", "id"))
    named = named.where("linked or n > 1")
    best = named.groupBy("comp").agg(F.min("at").alias("keep"))
    repeated, p_repeated = materialise(spark, named.select("id", "comp").join(best, "comp").select("id", "keep"), "lines-repeated")
    gone = each.join(small(repeated, repeated.count()), "id").where("at <> keep").select(F.col("at.row").alias("_row"), F.col("at.no").alias("no"))
    gone = gone.groupBy("_row").agg(F.collect_set("no").alias("_gone"))
    gone, p_gone = materialise(spark, gone, "lines-gone")
    numbers = gone.agg(F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()[0] + gone.count()
    parts = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone")), lambda i: F.get(parts, i)), "\n")
    out = docs.withColumn("_row", F.xxhash64(F.col(key).cast("string"), F.col(text))).join(small(gone, numbers), "_row", "left")
    out = out.withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(parts)).cast("long")).withColumn("n_dropped", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long"))
    out = out.withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(kept)).drop("_row", "_gone")
    out, _ = materialise(spark, out, "lines-result")
    drop(spark, p_each, p_repeated, p_gone, p_links)
    return out
