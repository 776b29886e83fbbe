"""DataFrame queries without SQL, against brute force."""

import random

import numpy as np

from lodestar.operators import images, vectors
from lodestar.plans import frames


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_wer_pairs_of_many_words(spark, tmp_path):
    r = random.Random(3)
    turns = [[f"w{r.randrange(m)}" for _ in range(n)] for m, n in ((5, 8), (5, 9), (600, 300), (600, 280), (70, 60), (70, 0))]
    rows = [(1, i, " ".join(t)) for i, t in enumerate(turns)] + [(2, 0, None), (2, 1, "one two")]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(x.conv_id, x.turn): (x.edits, x.wer) for x in frames.wer_pairs(spark, str(tmp_path)).collect()}
    want = {(1, i): (edits(a, b), round(edits(a, b) / len(b), 8) if b else float(bool(a))) for i, (a, b) in enumerate(zip(turns, turns[1:], strict=False))}
    assert got == want | {(2, 0): (2, 1.0)}


def test_ridge_equals_a_direct_solution(spark):
    r = np.random.default_rng(2)
    centre = r.standard_normal((4, 6))
    y = r.integers(0, 4, 600)
    x, fold = centre[y] + 0.6 * r.standard_normal((600, 6)), r.integers(0, 3, 600)
    rows = [(i, v.tolist(), f"c{c}", int(f)) for i, (v, c, f) in enumerate(zip(x, y, fold, strict=True))]
    odd = [(900, None, "c1", 0), (901, [float("nan")] * 6, "c1", 1), (902, x[0].tolist(), None, 2)]
    schema = "vec_id long, embedding array<double>, label string, fold long"
    scored, alpha = vectors.ridge(spark.createDataFrame(rows + odd, schema), "fold", 2)

    def outputs(one, a):
        some = (fold != 2) & (fold != one)
        t, target = x[some], np.eye(4)[y[some]]
        m = t - t.mean(0)
        w = np.linalg.solve(m.T @ m + a * np.eye(6), m.T @ (target - target.mean(0)))
        return (x[fold == one] - t.mean(0)) @ w + target.mean(0)

    alphas = (0.01, 0.1, 1.0, 10.0, 100.0)
    right = {a: sum((outputs(f, a).round(9).argmax(1) == y[fold == f]).sum() for f in (0, 1)) for a in alphas}
    assert alpha == min(alphas, key=lambda a: (-right[a], a))
    got = {g.vec_id: (g.predicted, g.confidence) for g in scored.collect()}
    assert len(got) == 600
    for f in range(3):
        z = outputs(f, alpha)
        for i, v in zip(np.flatnonzero(fold == f).tolist(), z, strict=True):
            assert got[i][0] == f"c{v.argmax()}" and abs(got[i][1] - v.max()) < 1e-6
    assert vectors.ridge(spark.createDataFrame([], schema), "fold", 2)[0].count() == 0


def test_nearest_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 30)
    monkeypatch.setattr(vectors, "QUERIES", 4)
    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (200, 3)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [1.0, 1.0, 1.0]), (300, None), (301, [1.0, None, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    zero = ~x.any(1)
    for measure in ("cosine", "euclid"):
        got = {(g.query_id, g["rank"]): (g.vec_id, round(g.score, 6)) for g in vectors.nearest(d, d.where("vec_id % 10 = 0"), 5, measure).collect()}
        want = {}
        for q in range(0, 200, 10):
            if measure == "cosine" and zero[q]:
                continue
            cost = lambda c: -float(x[q] @ x[c]) / float(np.linalg.norm(x[q]) * np.linalg.norm(x[c])) if measure == "cosine" else float(((x[q] - x[c]) ** 2).sum())  # noqa: B023, E731
            others = [c for c in range(200) if c != q and not (measure == "cosine" and zero[c])]
            for k, (s, c) in enumerate(sorted((round(cost(c), 9), c) for c in others)[:5], 1):
                want[q, k] = (c, round(-s if measure == "cosine" else s, 6) + 0.0)
        assert got == want
    assert vectors.nearest(d.limit(0), d, 5).count() == 0 and vectors.nearest(d, d.limit(0), 5).count() == 0


def test_ood_threshold_is_the_quantile_of_held_out_confidences(spark):
    root = "/root/testdata/sf0.001"
    scored = frames._ridge(spark, root)[0].toPandas()
    limit = np.quantile(scored.confidence[scored.fold != 2], 0.05)
    got = frames.ood_threshold(spark, root).first()
    assert abs(got.threshold - limit) < 1e-6 and got.calibrated == (scored.fold != 2).sum()
    assert (got.tested, got.rejected) == ((scored.fold == 2).sum(), (scored.confidence[scored.fold == 2] < limit).sum())


def test_regions_of_pixels(spark):
    sheet = ["##....#", "#...###", "..#....", "######."]
    rows = [("a", x, y) for y, line in enumerate(sheet) for x, c in enumerate(line) if c == "#"]
    rows += [("b", x, y) for x in range(7) for y in range(4)] + [("c", 0, 0), ("c", 0, 0), ("c", None, 1)]
    d = spark.createDataFrame(rows, "image string, x int, y int")
    boxes = lambda least: sorted(tuple(r) for r in images.regions(spark, d, 7, 4, least).collect())
    assert boxes(1) == [("a", 0, 0, 2, 2, 3), ("a", 0, 2, 6, 4, 7), ("a", 4, 0, 7, 2, 4), ("c", 0, 0, 1, 1, 1)]
    assert boxes(4) == [("a", 0, 2, 6, 4, 7), ("a", 4, 0, 7, 2, 4)]
    assert images.regions(spark, d.limit(0), 7, 4).count() == 0


def test_regions_across_tiles_by_few_edges(spark, monkeypatch):
    """A spiral through many tiles, bars along their borders and a speckled sheet; only touching tiles make edges."""
    r = random.Random(4)
    spiral, x, y, dx, dy, n = set(), -40, -40, 1, 0, 80
    while n > 0:
        for _ in range(n):
            spiral.add((x, y))
            x, y = x + dx, y + dy
        dx, dy, n = -dy, dx, n - 2 if dx else n - 2
    sheets = {"spiral": spiral, "bars": {(x, y) for x in range(31, 34) for y in range(100)} | {(35, y) for y in range(70)}, "specks": {(r.randrange(90), r.randrange(90)) for _ in range(4000)}}

    def boxes(some):
        some, out = set(some), []
        while some:
            group = []
            todo = [some.pop()]
            while todo:
                x, y = todo.pop()
                group.append((x, y))
                for q in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if q in some:
                        some.remove(q)
                        todo.append(q)
            xs, ys = zip(*group, strict=True)
            out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(group)))
        return out

    counted, components = [], images.graph.components
    monkeypatch.setattr(images.graph, "components", lambda s, nodes, edges: counted.append(edges.count()) or components(s, nodes, edges))
    d = spark.createDataFrame([(k, x, y) for k, v in sheets.items() for x, y in v], "image string, x int, y int")
    got = sorted(tuple(g) for g in images.regions(spark, d, 500, 500).collect())
    assert got == sorted((k, *b) for k, v in sheets.items() for b in boxes(v))
    assert 0 < counted[0] < sum(map(len, sheets.values())) / 5
