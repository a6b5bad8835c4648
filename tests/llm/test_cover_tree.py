"""The cover tree's invariants, and searches against brute force on clustered, tied and degenerate tables."""

import numpy as np
import pytest

from corpusloom.llm import covertree


def clustered(rng, n, dim, clusters):
    centers = rng.integers(-2000, 2000, (clusters, dim))
    return (centers[rng.integers(0, clusters, n)] + rng.integers(-20, 20, (n, dim))).astype(np.int64)


def cases():
    rng = np.random.default_rng(4)
    return {
        "clustered": clustered(rng, 3000, 8, 40),
        "uniform": rng.integers(-200, 200, (1500, 64)),
        "repeated": np.repeat(rng.integers(-9, 9, (7, 4)), 100, 0),
        "line": np.arange(2000)[:, None] * np.array([[1, 2]]),
        "one": rng.integers(-9, 9, (1, 5)),
        "zero": np.zeros((300, 3), np.int64),
    }


@pytest.mark.parametrize("name", cases())
def test_invariants(name):
    x = cases()[name].astype(np.float64)
    tree = covertree.CoverTree(x)
    assert sorted(tree.order.tolist()) == list(range(len(x)))
    ordered = x[tree.order]
    for depth, level in enumerate(tree.levels):
        assert level.lo[0] == 0 and level.hi[-1] == len(x) and (level.lo[1:] == level.hi[:-1]).all()
        apart = np.sqrt(((level.center[:, None] - level.center[None]) ** 2).sum(-1))
        np.fill_diagonal(apart, np.inf)
        assert depth == 0 or apart.min() > level.scale  # separation
        nearest = np.sqrt(((ordered[:, None] - level.center[None]) ** 2).sum(-1)).min(1)
        assert (nearest <= level.scale + 1e-6).all()  # covering
        for i, (a, b) in enumerate(zip(level.lo, level.hi, strict=True)):
            far = np.sqrt(((ordered[a:b] - level.center[i]) ** 2).sum(1)).max()
            assert abs(far - level.radius[i]) < 1e-6
        if depth:
            above = tree.levels[depth - 1]
            mine = {tuple(c) for c in level.center}
            assert {tuple(c) for c in above.center} <= mine  # nesting
            for i in range(len(above.lo)):
                children = tree.below(depth - 1, np.array([i]))
                assert (np.sqrt(((level.center[children] - above.center[i]) ** 2).sum(1)) <= above.scale + 1e-6).all()
    if name == "clustered":
        assert len(tree.levels) > 1


def plain(q_ids, q, x_ids, x, k):
    s = q @ x.T
    out = []
    for i, a in enumerate(q_ids):
        best = sorted((j for j in range(len(x)) if x_ids[j] != a), key=lambda j: (-s[i, j], x_ids[j]))[:k]
        out.append([(int(x_ids[j]), int(s[i, j])) for j in best])
    return out


@pytest.mark.parametrize("name", cases())
def test_dual_search_equals_brute_force(name):
    x = cases()[name]
    ids = np.arange(len(x)) * 3
    q = np.flatnonzero(np.arange(len(x)) % 10 == 0)
    best = covertree.dual_search(ids[q], x[q], np.full(len(q), covertree.LEAST), ids, x, 5)
    got = [[(int(i), int(s)) for i, s in zip(a, b, strict=True) if i != covertree.MOST] for a, b in zip(best.id, best.score, strict=True)]
    assert got == plain(ids[q], x[q], ids, x, 5)
    if name == "clustered":  # pruning takes effect
        assert best.compared < len(q) * len(x) / 2


def test_query_with_ties_repeats_nulls_and_clashing_names(spark, tmp_path):
    rng = np.random.default_rng(9)
    m = rng.integers(-3, 3, (400, 4)) / 256.0
    rows = [(i, [float(c) for c in m[i]], "x", 1, 2.0) for i in range(400)]
    rows += [(400, None, "x", 1, 2.0), (450, [1.0, None, 2.0, 3.0], "x", 1, 2.0), (500, [float("inf")] * 4, "x", 1, 2.0), (550, [1.0, 2.0], "x", 1, 2.0), (600, [], "x", 1, 2.0), (None, [1.0] * 4, "x", 1, 2.0), (7, [float(c) for c in m[7]], "x", 1, 2.0), (50, [float(c) for c in m[50]], "x", 1, 2.0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, V_ string, rank int, score double").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in covertree.op9_cover_tree_top5(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v)).astype(np.int64)) for i, v, *_ in rows if i is not None and v and len(v) == 4 and all(c is not None and np.isfinite(c) for c in v)]
    ids, x = np.array([g[0] for g in good]), np.array([g[1] for g in good])
    for q in range(0, 400, 50):
        want = plain([q], x[ids == q][:1], ids, x, 5)[0]
        assert sorted(got[q]) == [(k + 1, *w) for k, w in enumerate(want)]
    assert set(got) == set(range(0, 400, 50))  # vector 550 is alone of its length


def test_few_candidates_and_an_empty_table(spark, tmp_path):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    d.write.parquet(f"{tmp_path}/a/embeddings.parquet")
    d.where("false").write.parquet(f"{tmp_path}/b/embeddings.parquet")
    assert len(covertree.op9_cover_tree_top5(spark, f"{tmp_path}/a").collect()) == 2
    assert covertree.op9_cover_tree_top5(spark, f"{tmp_path}/b").count() == 0
