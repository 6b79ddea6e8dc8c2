import math
import random

import numpy as np

from corpusloom.llm import topk_search


def brute(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % every == 0:
            s = sorted((-int(a @ b), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -t) for n, (t, i) in enumerate(s)]
    return sorted(out)


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<float>, id string").repartition(3)
    return sorted(tuple(r) for r in topk_search.top_k(df, **how).collect())


def test_against_every_pair(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(400, 6)) + 3 * rng.integers(0, 4, (400, 1)), 2).astype(np.float32)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # equal vectors
    rows += [(2000, None), (2050, [None] * 6), (2100, [float("nan")] * 6), (2150, [float("inf")] + [0.0] * 5), (2200, [0.0] * 6)]
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, block=64) == want


def test_few_and_none(spark):
    assert run(spark, []) == []
    assert run(spark, [(50, [1.0, 2.0])]) == []
    assert run(spark, [(50, [1.0, 0.5]), (3, [0.5, 0.5]), (50, [1.0, 0.5])]) == [(50, 1, 3, 128 * 256 + 128 * 128)]


def test_trees_cover():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(500, 3)), np.ones((300, 3))])
    todo, leaves = [topk_search.cover_tree(x)], []
    while todo:
        n = todo.pop()
        assert (np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1)) <= n.radius + 1e-9).all()
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
            todo += n.children
        else:
            leaves += n.rows.tolist()
    assert sorted(leaves) == list(range(800))


def test_large_components_stay_exact():
    q, d = np.array([[2**40, 3]]), np.array([[2**20, 1], [2**20, 2]])
    rows, ids, scores = topk_search.dual_search(q, np.array([0]), d, np.array([1, 2]), 2)
    assert ids.tolist() == [2, 1] and scores.tolist() == [2**60 + 6, 2**60 + 3]
