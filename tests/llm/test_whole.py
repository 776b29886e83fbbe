"""The training-data operators learn from, look at and return the whole input."""

import corpus_pipeline
import numpy as np
import public_tokenizers as P

from lodestar.llm import attention, ivfpq, lm
from lodestar.llm.common import held_out

PATH = P.path("byte_bpe_50k.tiktoken")


def test_lm_tables_count_all_training_documents(spark, monkeypatch):
    texts = [f"Once upon a time word{i % 7} met word{i % 5} by the river " * (i % 4) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 2)
    monkeypatch.setattr(lm, "STEPS", 3)
    made, fit = [], attention.fit
    monkeypatch.setattr(attention, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    assert lm.score(spark, docs, PATH).count() == 60
    model, subwords = made[0], lm._Subwords(PATH, {})
    pair = np.zeros((len(model.p["table"]), model.classes))
    for r in docs.where(~held_out(docs.doc_id, 10)).collect():
        last = model.size
        for i in subwords.sequence(subwords.meet([r.text.encode()])[0]).tolist():
            pair[model.input[last], model.cls[i]] += 1
            last = i
    base = pair.sum(0) + 0.5
    pair += 8 * base / base.sum()
    groups = pair.reshape(len(pair), attention.GROUPS, -1).sum(2)
    assert np.allclose(model.p["table"], np.log(groups / groups.sum(1, keepdims=True)), atol=1e-4)
    assert np.allclose(model.p["below"], np.log(pair.reshape(-1, attention.MEMBERS) / groups.reshape(-1, 1)), atol=1e-4)


def test_pipeline_mix_prefers_good_documents(spark, tmp_path):
    docs = spark.createDataFrame([(i, "a b c d", "en", "ab"[i % 2], 7) for i in range(1200)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, i // 2 % 2, 0) for i in range(1200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    # of sources a and b, with weights 1 and 2, a is taken in part and b once and in part
    n = {True: 0, False: 0}
    for r in corpus_pipeline.mix(spark, docs, str(tmp_path)).collect():
        n[r.doc_id // 2 % 2 == 1] += 1
    assert sum(n.values()) == 1200 and n[True] > 1.3 * n[False]


def test_ivf_pq_keeps_smallest_ids_of_copies_and_fills_up(spark):
    r = np.random.default_rng(4)
    x = {i: r.standard_normal(8) for i in range(900)}
    copies = [i for i in range(900) if i % 9 < 4 or i % 20 == 0]
    one = np.full(8, 2.0)
    rows = [(i, (one if i in copies else x[i]).tolist()) for i in reversed(range(900))]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for g in ivfpq.search(spark, d, "vec_id", "embedding").collect():
        got.setdefault(g.query_id, {})[g["rank"]] = g.vec_id
    for q in range(0, 900, 20):
        assert [got[q][j] for j in range(1, 21)] == [i for i in copies if i != q][:20]
    # two small clusters and a large one; 24 others for every query
    rows = [(i, ((r.standard_normal(8) * 0.01) + np.eye(8)[min(i, 2)]).tolist()) for i in range(25)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    n = ivfpq.search(spark, d, "vec_id", "embedding", every=1, lists=3, probes=0.34).groupBy("query_id").count().collect()
    assert sorted((a, b) for a, b in n) == [(i, 20) for i in range(25)]


def test_lm_base_columns_equal_a_plain_count(spark, monkeypatch):
    import math
    import re
    import zlib
    from collections import Counter

    rng = np.random.default_rng(11)
    words = ["the", "Of", "zyxq", "naïve", "Ünder", "x" * 70, "1,5", "mañana"] + [f"w{i}q" for i in range(300)]
    texts = [" \t\n"[i % 3].join(words[int(j)] for j in rng.integers(0, len(words), int(rng.integers(0, 60)))) for i in range(200)]
    rows = [*enumerate(texts), (200, None), (201, ""), (None, "the zyxq"), (5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(lm, "STEPS", 3)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    low = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x or "")
    cut = [(i, x, [*re.findall(r"[^\x20\x09-\x0D]+", low(x)), None]) for i, x in rows]
    count = Counter(w for i, _, x in cut if not held(i) for w in x)
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), held(i), len(x), sum(count[w] > 0 for w in x), total, round(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in x), 6)) for i, _, x in cut)
    for frequent in (4096, 20, 0):  # words by their documents, by the documents' own lists, and both
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        got = lm.score(spark, docs, PATH).collect()
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
