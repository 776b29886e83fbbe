"""The attention layer learns from every training document, not only from the sample that it starts from."""

import numpy as np
import public_tokenizers as P

from lodestar.llm import attention, lm
from lodestar.llm.common import held_out

PATH = P.path("byte_bpe_50k.tiktoken")


def test_windows_take_each_token_once():
    model = attention.Attention(np.ones(300), np.zeros(300, bool))
    n = np.array([1, 5, 32, 33, 58, 59, 200])
    target = np.random.default_rng(1).integers(0, 300, int(n.sum()))
    seen, tokens = 0, np.zeros(model.classes, int)
    for x, y, live in model.windows(target, np.cumsum(n) - n, np.arange):
        seen += live.sum()
        tokens += np.bincount(y[live], minlength=model.classes)
    assert seen == n.sum() and (tokens == np.bincount(model.cls[target], minlength=model.classes)).all()


def test_attention_learns_from_documents_outside_the_sample(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 2)
    monkeypatch.setattr(lm, "STEPS", 3)
    sums, mean = [], attention.Attention.mean
    monkeypatch.setattr(attention.Attention, "mean", lambda self, s: sums.append((self, s)) or mean(self, s))
    docs = spark.createDataFrame([(i, f"once upon a time word{i % 7} met word{i % 5} by the river " * (i % 4)) for i in range(60)], "doc_id long, text string")
    first = lm.score(spark, docs, PATH).collect()
    model, s = sums[0]
    subwords = lm._Subwords(PATH, {})
    train = [subwords.sequence(subwords.meet([r.text.encode()])[0]) for r in docs.where(~held_out(docs.doc_id, 10)).collect()]
    assert s[-1] == sum(map(len, train))  # every token of every training document
    seen = np.zeros(len(model.p["e"]))
    for x in train:
        np.add.at(seen, model.input[np.r_[model.size, x[:-1]]], 1)
    assert (s[model.p["e"].size :][: len(seen)] == seen).all()
    key = lambda rows: sorted((r.doc_id, r.score) for r in rows)
    assert np.allclose(np.array(key(first)), np.array(key(lm.score(spark, docs, PATH).collect())), rtol=1e-6)
