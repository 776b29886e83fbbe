"""The training-data operators against brute force, round trips and held-out accuracy, and on nulls,
empty texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from lodestar.llm import bpe, html_extract, ivfpq, jaccard, line_dedup, lm, mixing, mtree, token_counts, toxicity

PATH = P.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, source string, token string"
TEXTS = [None, "", " \n\t", "one", "One TWO three four five six seven", "one two three four five six seven", "one two three four five six eight nine ten eleven " * 40, "é" * 3000 + " ab", "one two three four five six seven"]


def frame(spark, texts):
    return spark.createDataFrame([(None if i == 3 else i, t, None if i % 3 == 0 else f"s{i % 2}", "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_bpe_matches_library_and_round_trips(spark, docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    words = ["".join(r.choice("aab é'1\n.") for _ in range(r.randint(0, 60))) for _ in range(300)]
    coder = bpe.encoder(PATH, P.PATTERN)
    for t, x in zip(words, coder.words(words), strict=True):
        assert [i for w in x for i in coder.ids[w]] == e.encode_ordinary(t)
    for row in bpe.digests(docs, PATH, P.PATTERN).collect():
        t = TEXTS[row.doc_id] or "" if row.doc_id is not None else "one"
        assert row.n_tokens == len(e.encode_ordinary(t)) and row.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, e.encode_ordinary(t))).encode()).hexdigest() and row.token == "x"
    both = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH).collect()
    assert all(bytes(x.decoded).decode() == (x.text or "") for x in both)
    assert bpe.digests(none, PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, P.PATTERN, ids="token")


def test_token_counts_match_greedy(docs, none):
    known = set(token_counts._tokens(PATH).values())

    def greedy(w):
        n = 0
        while w:
            w = w[next(j for j in range(len(w), 0, -1) if w[:j] in known) :]
            n += 1
        return n

    for row in token_counts.count_tokens(docs, PATH).collect():
        t = (TEXTS[row.doc_id] if row.doc_id is not None else "one") or ""
        assert row.n_tokens == sum(greedy(b" " + w) for w in t.encode().split()) and row.n_words == len(t.encode().split())
    assert token_counts.count_tokens(none, PATH).count() == 0
    assert token_counts.LongestMatch([b"un", b"##a", b"##able", b"able", b"##ble"], b"##").lengths([b"unable", b"unaable", b"unx", b""]).tolist() == [2, 3, 1, 0]


def test_merge_skip_matches_counting():
    r = random.Random(3)
    for _ in range(300):
        lists = [sorted(r.sample(range(30), r.randint(0, 20))) for _ in range(6)]
        need = r.randint(1, 5)
        want = [(x, n) for x in range(30) if (n := sum(x in v for v in lists)) >= need]
        assert list(zip(*jaccard.merge_skip(lists, need), strict=True)) == want


def _unit(sets, percent=75):
    return jaccard.Unit(np.concatenate([np.array(sorted(x), dtype=np.int64) for x in sets]), np.array([len(x) for x in sets]), np.array([len(x) for x in sets]), percent)


def test_divide_skip_search_matches_brute_force():
    r = random.Random(8)
    base = [r.sample(range(400), r.choice((4, 20, 60))) for _ in range(12)]
    sets = [{x if r.random() > p else r.randrange(400) for x in r.choice(base)} for p in (0, 0.03, 0.1) for _ in range(80)]
    for i in range(len(sets)):
        u = _unit(sets)
        u.left[i] = False
        want = [j for j in range(len(sets)) if j != i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        assert u.search(i).tolist() == want


def test_search_of_a_group_of_near_copies_grows_with_the_group():
    r = random.Random(9)

    def merged(m):
        base = list(range(150))
        u = _unit([{x if r.random() > 0.06 else r.randrange(150, 190) for x in base} for _ in range(m)])
        assert len(set(u.components().tolist())) < m // 2
        return u.merged

    assert merged(1600) < 6 * merged(400)


def test_jaccard_components_match_brute_force(spark, docs, none):
    r = random.Random(5)
    base = [[r.choice("abcdefgh") + str(r.randint(0, 30)) for _ in range(r.choice((3, 6, 40, 120)))] for _ in range(30)]
    texts = [" ".join(w if r.random() > p else "zz" for w in r.choice(base)) for p in (0, 0.01, 0.02) for _ in range(60)] + [None, "", "x y"]
    got = {x.doc_id: x for x in jaccard.jaccard_components(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, comp, strict=True))} == {i: (x.n_shingles, x.component_id) for i, x in got.items()}
    assert jaccard.jaccard_components(spark, docs).count() == len(TEXTS) and jaccard.jaccard_components(spark, none).count() == 0


def test_edit_distance(spark):
    r = random.Random(2)
    rows = []
    for _ in range(600):
        a = [r.choice("abé") for _ in range(r.randint(0, 14))]
        b = list(a)
        for _ in range(r.randint(0, 4)):
            b.insert(r.randint(0, len(b)), r.choice("abé")) if r.random() < 0.5 else b and b.pop(r.randrange(len(b)))
        rows.append(("".join(a), "".join(b)))
    d = spark.createDataFrame(rows, "a string, b string")
    for most in (1, 2, 4):
        x = d.select(F.levenshtein("a", "b").alias("t"), line_dedup.edit_distance(F.col("a"), F.col("b"), most).alias("e"))
        assert x.where(f"(t <= {most} and e <> t) or (t > {most} and e <= {most})").count() == 0


def test_line_dedup(spark, docs, none):
    long = "The quick brown fox jumps over the lazy dog again"
    texts = [f"{long}\nshort\n\n{long}", f"short\n{long[:10]}X{long[10:]}\nown line", None, "", "a\na", f"{long[:-1]}!\nshorT"]
    got = {x.doc_id: x for x in line_dedup.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i].text for i in range(6)] == [f"{long}\nshort\n", "own line", None, "", "a", "shorT"]
    assert [got[i].n_dropped for i in range(6)] == [1, 2, 0, 0, 1, 1]
    assert line_dedup.dedup(spark, docs).count() == len(TEXTS) and line_dedup.dedup(spark, none).count() == 0


def _near(a, b):
    """Within one edit, read off directly."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _plain_dedup(texts, least):
    """What is left of each text, by comparing all lines."""
    places = [(d, n, x) for d, t in enumerate(texts) if t for n, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\x0c")]
    lines = list(dict.fromkeys(x for *_, x in places))
    comp = {x: x for x in lines}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, x in enumerate(lines):
        for y in lines[:i]:
            if min(len(x), len(y)) >= least and _near(x, y):
                comp[root(x)] = root(y)
    seen, gone = set(), set()
    for d, n, x in places:
        if root(x) in seen:
            gone.add((d, n))
        seen.add(root(x))
    return [t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in enumerate(texts)]


def test_line_dedup_matches_brute_force(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    base = [" ".join(word() for _ in range(r.choice((7, 9, 14)))) for _ in range(25)]
    lines = base + [f"2024-01-01 00:00:00 INFO request {r.randrange(10**5):05d} served in {r.randrange(60)} ms by the main node" for _ in range(250)]

    def edited(x):
        x = list(x)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            i = r.randrange(len(x))
            x[i : i + 1] = r.choice(([], ["q"], [x[i], "q"]))
        return "".join(x)

    texts = ["\n".join(edited(r.choice(lines)) for _ in range(r.randint(0, 12))) for _ in range(90)] + [None, "", "\n\n"]
    got = {x.doc_id: x.text for x in line_dedup.dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == _plain_dedup(texts, line_dedup.LEAST)


def test_line_dedup_edges(spark):
    long = "a line of more than thirty-two characters"
    d = spark.createDataFrame([(None, long, 1), (1, long, 2), (1, long, 3), (2, f"{long}\nother", 4)], "doc_id long, text string, extra int")
    got = {x.extra: (x.text, x.n_lines, x.n_dropped) for x in line_dedup.dedup(spark, d).collect()}
    assert got == {1: ("", 1, 1), 2: (long, 1, 0), 3: (long, 1, 0), 4: ("other", 2, 1)}
    with pytest.raises(ValueError):
        line_dedup.dedup(spark, d.withColumnRenamed("extra", "n_lines"))


def test_mixing(spark, docs, none):
    rows = [(i, "a" if i % 3 else "b" if i % 2 else None, "w " * (i % 7)) for i in range(300)]
    got = mixing.mix(spark, spark.createDataFrame(rows, "doc_id long, source string, text string")).toPandas()
    assert len(got) == 300 and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1 and g["size"].sum() == g.source_size.iloc[0]
    assert abs(got.taken.sum() - got["size"].sum()) <= 3
    assert mixing.mix(spark, docs).count() == len(TEXTS) and mixing.mix(spark, none).count() == 0


def test_html(spark):
    model = html_extract.default_model()
    page = '<nav><a href=x>Home</a></nav><article><h1>A&amp;B</h1><p><b>One<br><p>Two  <i>th</i>ree<div class="comments"><p>me too</p></div></article><footer>f</footer>'
    assert model.extract(page) == "A&B\nOne\nTwo three" and model.extract(None) == model.extract("") == ""
    wrong = total = 0
    for p in html_extract.labelled_pages(80, 99):
        nodes = html_extract.parse(p)
        html_extract._measure(nodes)
        truth = {}
        for x in nodes:
            truth[id(x)] = int(x.label) if x.label is not None else truth[id(x.parent)] if x.parent else 0
        model.infer(nodes)
        wrong += sum((x.score >= 0.5) != truth[id(x)] for x in nodes if x.tag == "#text")
        total += sum(x.tag == "#text" for x in nodes)
    assert wrong <= 0.01 * total
    d = spark.createDataFrame([(1, None, "u"), (2, page, "u"), (2, "<p", "v")], "page_id long, html string, url string")
    assert html_extract.extract_text(d).count() == 3


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.standard_normal((400, 8)))] + [(400, None), (401, [float("nan")] * 8), (402, [0.0] * 8), (403, [1.0] * 8), (404, [1.0] * 8), (None, [1.0] * 8), (405, [None] * 8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = {i: np.array(v) for i, v in rows if i is not None and i < 400 or i in (402, 403, 404)}
    got = mtree.top_k(spark, d, "vec_id", "embedding", chunk_rows=100, block_queries=3).collect()
    q = {i: np.floor(256 * v).astype(np.int64) for i, v in x.items()}
    want = [(a, r + 1, b, s) for a in q if a % 50 == 0 for r, (s, b) in enumerate(sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:5])]
    assert sorted((g.query_id, g["rank"], g.vec_id, -g.score) for g in got) == sorted(want)
    near = ivfpq.search(spark, d, "vec_id", "embedding").collect()
    hits = total = 0
    for a in [i for i in x if i % 20 == 0]:
        top = sorted(((-float(x[a] @ x[b]), b) for b in x if b not in (a, 402)))[:20]
        hits += len({b for _, b in top} & {g.vec_id for g in near if g.query_id == a})
        total += 20
    assert hits >= 0.9 * total
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert mtree.top_k(spark, empty, "vec_id", "embedding").count() == 0 and ivfpq.search(spark, empty, "vec_id", "embedding").count() == 0


def test_toxicity_learns_and_handles_edges(spark, docs, none):
    r = random.Random(4)
    rows = []
    for i in range(300):
        w = ["".join(r.choice("abcdehnrst") for _ in range(r.randint(2, 8))) for _ in range(40)]
        if i % 3 == 0:
            for _ in range(5):
                w[r.randrange(40)] = "zog" + r.choice("abc")
        rows.append(([x.encode() for x in w], int(i % 3 == 0)))
    model = toxicity.fit(rows[:240])
    score = toxicity._Scorer(model).scores([b" ".join(w) for w, _ in rows[240:]])
    assert np.mean((score >= 0.5) == np.array([y for _, y in rows[240:]])) > 0.9
    assert {x.score for x in toxicity.score(docs, model).where("text is null or text = ''").collect()} == {0.0}
    assert toxicity.score(none, model).count() == 0 and toxicity.fit([([b"a"], 0)]) is None


def test_lm_base_and_edges(spark, docs, none, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 20)
    got = lm.score(spark, docs, PATH).collect()
    assert len(got) == len(TEXTS) and all(x.score <= 0 and x.n_known <= x.n_tokens for x in got)
    assert {x.n_tokens for x in got if x.doc_id in (0, 1, 2)} == {1}
    assert lm.score(spark, none, PATH).count() == 0


