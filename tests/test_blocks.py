"""Pairs of blocks against whole matrices: distances, silhouettes, spanning trees and the density clusters on them."""

import numpy as np
import pytest

from corpusloom.operators import blocks, clustering, joins, metrics, vectors


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in (0, 4, 9)] + [rng.uniform(-3, 12, (20, 3))])
    return np.concatenate([x, x[:3]])  # three rows twice


def _rows(spark, x, cluster=None):
    return spark.createDataFrame([(i * 7, v.tolist(), int(cluster[i]) if cluster is not None else 0) for i, v in enumerate(x)], "id long, v array<double>, cluster int")


def _reach(x, samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, samples - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None]))


def test_distances_of_near_vectors():
    x = np.array([[1e6, 1.0], [1e6, 1.0], [1e6, 1.5]])
    assert blocks.distances(x, x).tolist() == [[0, 0, 0.5], [0, 0, 0.5], [0.5, 0.5, 0]]


@pytest.mark.parametrize("width", [16, 64, 4096])
@pytest.mark.parametrize("samples", [1, 5])
def test_spanning_tree_has_the_least_weight(spark, points, width, samples):
    reach = _reach(points, samples)
    inside, want = {0}, []
    while len(inside) < len(points):  # Prim, plainly
        w, k = min((reach[i, j], j) for i in inside for j in range(len(points)) if j not in inside)
        inside.add(k)
        want.append(w)
    got = blocks.spanning_tree(_rows(spark, points), samples, width).collect()
    assert np.allclose(sorted(r.w for r in got), sorted(want))
    assert len({r.a for r in got} | {r.b for r in got}) == len(points)


def test_density_clusters_do_not_depend_on_blocks(spark, points, monkeypatch):
    one = {r.id: r.cluster for r in clustering.hdbscan(_rows(spark, points), 10, 1).collect()}
    assert len(one) == len(points) and len(set(one.values()) - {-1}) == 3
    monkeypatch.setattr(blocks.spanning_tree, "__defaults__", (16,))
    many = {r.id: r.cluster for r in clustering.hdbscan(_rows(spark, points), 10, 1).collect()}
    assert len(set(zip(one.values(), (many[i] for i in one), strict=True))) == len(set(one.values())) == len(set(many.values()))


def test_density_leaves_and_epsilon(spark):
    x = np.array([[c + s + 0.01 * i] for c in (0, 100) for s in (0, 3) for i in range(20)])
    rows = _rows(spark, x)
    number = lambda **k: len({r.cluster for r in clustering.hdbscan(rows, 8, 1, **k).collect()} - {-1})
    assert number(leaf=True) == 4
    assert number(leaf=True, epsilon=5.0) == 2


def test_density_clusters_of_few_rows(spark):
    assert clustering.hdbscan(_rows(spark, np.zeros((0, 2))), 5).count() == 0
    assert [r.cluster for r in clustering.hdbscan(_rows(spark, np.zeros((1, 2))), 5).collect()] == [-1]
    assert {r.cluster for r in clustering.hdbscan(_rows(spark, np.zeros((40, 2))), 5).collect()} <= {-1, 0}


def test_silhouette_by_blocks(spark, points):
    cluster = np.arange(len(points)) // 60
    cluster[-1] = 9  # alone
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    s = []
    for i, c in enumerate(cluster):
        own = (cluster == c).sum()
        a = d[i, cluster == c].sum() / max(own - 1, 1)
        b = min(d[i, cluster == o].mean() for o in set(cluster) - {c})
        s.append(0 if own == 1 else (b - a) / max(a, b))
    rows = _rows(spark, points, cluster)
    assert metrics.silhouette(rows).first()[0] == pytest.approx(np.mean(s), abs=1e-6)
    sums = {(r.id, r.other): r.s for r in blocks.cluster_sums(rows, 16).collect()}
    assert all(sums[i * 7, int(o)] == pytest.approx(d[i, cluster == o].sum()) for i in range(len(points)) for o in set(cluster))


def test_best_setting_leaves_noise(spark, points):
    found = clustering.hdbscan_search(_rows(spark, points), [5, 10]).collect()
    assert sum(r.best for r in found) == 1 and all(r.noise_ratio > 0 for r in found if r.best)


def test_fuzzy_loses_no_pair(spark):
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    base = [word(int(n)) for n in rng.integers(0, 40, 40)] + [word(100) for _ in range(10)] + ["", "a"]

    def edit(s, k):
        for _ in range(k):
            at, kind = int(rng.integers(0, len(s) + 1)), int(rng.integers(0, 3))
            s = s[:at] + (word(1) if kind else "") + s[at + (kind != 1) :]
        return s

    other = [edit(s, int(rng.integers(0, max(2, len(s) // 4)))) for s in base]
    left = spark.createDataFrame(list(enumerate(base)) + [(999, None)], "id long, text string")
    right = spark.createDataFrame([(i, s) for i, s in enumerate(other)] + [(998, None)], "other long, other_text string")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for least in (0.8, 0.6):
        want = {}
        for i, x in enumerate(base):
            best = min((-(1 - lev(x, y) / max(len(x), len(y), 1)), j) for j, y in enumerate(other))
            if -best[0] > least + 1e-12:
                want[i] = best[1]
        assert {r.id: r.other for r in joins.fuzzy(left, right, least).collect()} == want
    with pytest.raises(ValueError):
        joins.fuzzy(left, right, 0.5)


def test_tasks_of_blocks_hold_no_pairs(spark, points):
    """Pairs stay in their task: nothing is joined row by row, so a cluster's pairs are no rows of any plan."""
    rows = _rows(spark, points, np.arange(len(points)) % 2)
    for df in (vectors.pair_statistics(rows), vectors.separation(rows), clustering.near_pairs(rows, 1.0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "(id" not in "".join(line for line in plan.splitlines() if "Join" in line), plan


@pytest.mark.parametrize("width", [16, 50])
def test_pairs_within_a_distance(spark, points, width, monkeypatch):
    monkeypatch.setattr(blocks, "TILE", 7)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
    want = {(i * 7, j * 7) for i in range(len(points)) for j in range(i + 1, len(points)) if d[i, j] <= 0.4}
    got = blocks.near(_rows(spark, points), 0.4, width).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert all(r.d == pytest.approx(d[r.a // 7, r.b // 7]) for r in got)


@pytest.mark.parametrize("own", [8, 4096])
def test_quartiles_of_pairs_by_cells(spark, points, own, monkeypatch):
    monkeypatch.setattr(blocks.in_clusters, "__defaults__", (own,))
    monkeypatch.setattr(blocks, "TILE", 5)
    x = np.concatenate([points, np.ones((30, 3))])  # thirty copies: many pairs of one cosine
    cluster = np.arange(len(x)) % 3
    got = {r.cluster: r for r in vectors.pair_statistics(_rows(spark, x, cluster)).collect()}
    far = []
    for c in range(3):
        u = x[cluster == c] / np.linalg.norm(x[cluster == c], axis=1, keepdims=True)
        s = (u @ u.T)[np.triu_indices(len(u), 1)]
        far.append(np.sqrt(((x[cluster == c][:, None] - x[cluster == c][None]) ** 2).sum(-1))[np.triu_indices(len(u), 1)])
        want = [s.mean(), s.std(), s.min(), s.max(), np.quantile(s, 0.25), np.quantile(s, 0.75)]
        assert [got[c][k] for k in ("mean", "std", "min", "max", "q25", "q75")] == pytest.approx(want, abs=2e-6)
    assert vectors.separation(_rows(spark, x, cluster)).first().mean_intra == pytest.approx(np.concatenate(far).mean(), abs=2e-6)


def test_blocks_are_few(spark, points):
    assert [-(-n // blocks._wide(n, blocks.WIDE)) for n in (10_000, 100_000, 615_000)] == [8, 8, 19]
    plan = blocks.cluster_sums(_rows(spark, points, np.arange(len(points)) % 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "__task" in plan  # a task for every two blocks
