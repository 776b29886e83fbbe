"""The M-tree search of whole blocks of queries, on ties, copies and large components, and what its plan moves."""

import numpy as np
import pytest

from lodestar.llm import mtree


def plain(ids, x, q, own, k):
    score = x.astype(object) @ q.astype(object)
    return [(-s, i) for s, i in sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != own)[:k]]


@pytest.mark.parametrize("large", [1, 2**22])  # products beyond 2^53 are left to integers
def test_blocks_of_queries_equal_brute_force(large):
    r = np.random.default_rng(3)
    centre = r.integers(-200, 200, (12, 6))
    x = centre[r.integers(0, 12, 900)] + r.integers(-3, 4, (900, 6))
    x[300:700] = x[300]  # copies: ties go to the smaller id
    x *= large
    ids = r.permutation(900) // 2  # every id twice
    tree = mtree.MTree.unpack(mtree.MTree(ids, x, float((x.astype(float) ** 2).sum(1).max())).pack())
    at = r.choice(900, 80, replace=False)
    q, own = mtree.unpack_queries(mtree.pack_queries(ids[at], x[at]))[::-1]
    row, score, found = tree.top(q, own, 5)
    for j in range(len(at)):
        assert list(zip(score[row == j].tolist(), found[row == j].tolist(), strict=True)) == plain(ids, x, x[at[j]], own[j], 5)
    assert len(tree.top(q[:0], own[:0], 5)[0]) == 0


def test_fewer_rows_than_asked_for():
    x = np.array([[1, 2], [3, -4], [5, 6]])
    row, score, found = mtree.MTree(np.array([4, 5, 6]), x, 61.0).top(x[:1], np.array([4]), 5)
    assert (row.tolist(), score.tolist(), found.tolist()) == ([0, 0], [17, -5], [6, 5])


def test_no_join_gathers_or_sends_trees(spark, monkeypatch):
    plans = []

    def kept(spark, df, name, made=mtree.materialise):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(spark, df, name)

    monkeypatch.setattr(mtree, "materialise", kept)
    r = np.random.default_rng(5)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 4)))], "vec_id long, embedding array<double>")
    assert mtree.top_k(spark, d, "vec_id", "embedding", chunk_rows=50, block_queries=2).count() == 30
    assert plans and not any("Join" in p or "BroadcastExchange" in p for p in plans)
