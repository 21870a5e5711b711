"""Clustering goldens on hand fixtures and brute-force cross-checks."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from critica.operators import blocks as B
from critica.operators import cluster as C
from tests import reference_kernels as R
from critica.operators.graph import connected_components


def _pts(spark, xs, group="g"):
    rows = [(group, i, [float(x), 0.0]) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "grp string, review_id long, embedding array<double>")


def test_dbscan_fixture(spark):
    df = _pts(spark, [0, 1, 2, 3, 4, 20, 21, 50])
    out = {r.review_id: (r.clusters, r.is_core) for r in C.dbscan(df, 3.5, 5, ["grp"]).collect()}
    assert [out[i][0] for i in range(8)] == [0, 0, 0, 0, 0, -1, -1, -1]
    assert [out[i][1] for i in range(8)] == [False, True, True, True, False, False, False, False]


def test_hdbscan_leaf_fixture(spark):
    xs = [0, 1, 2.1, 3.3, 4.6, 20, 21.05, 22.2, 23.45, 24.8, 60, 61.02, 62.1, 63.25, 64.5, 10, 40]
    out = {r.review_id: r.clusters for r in C.hdbscan_leaf(_pts(spark, xs), 5, ["grp"]).collect()}
    got = [out[i] for i in range(len(xs))]
    assert got[:5] == [0] * 5 and got[15] == 0
    assert got[5:10] == [1] * 5
    assert got[10:15] == [2] * 5
    assert got[16] == -1


def test_hdbscan_single_group_all_noise(spark):
    out = C.hdbscan_leaf(_pts(spark, [0, 1, 2.1, 3.3, 4.6]), 5, ["grp"]).collect()
    assert all(r.clusters == -1 for r in out)


def _kruskal(x):
    n = len(x)
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    edges = sorted((d[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a
    total, used = 0.0, []
    for w, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            total += w
            used.append((i, j))
    return total, used


def test_mst_matches_kruskal(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (12, 5)), rng.normal(6, 1, (10, 5))])
    rows = [("a" if i % 2 else "b", i, x[i].tolist()) for i in range(len(x))]
    df = spark.createDataFrame(rows, "grp string, review_id long, embedding array<double>")
    mst = C.minimum_spanning_forest(df, ["grp"]).collect()
    for g in ("a", "b"):
        idx = [i for i in range(len(x)) if (("a" if i % 2 else "b") == g)]
        total, used = _kruskal(x[idx])
        got = [r for r in mst if r.grp == g]
        assert len(got) == len(idx) - 1
        assert abs(sum(r.w for r in got) - total) < 1e-9


def test_connected_components_chain(spark):
    nodes = spark.range(0, 40).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 19)] + [(25, 30), (30, 39)], "src long, dst long")
    comp = {r.id: r.component for r in connected_components(nodes, edges).collect()}
    assert all(comp[i] == 0 for i in range(20))
    assert comp[39] == 25 and comp[30] == 25 and comp[22] == 22


def test_kmeans_separates_blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    rows = [("g", i, x[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "grp string, review_id long, embedding array<double>")
    out = {r.review_id: r.clusters for r in C.kmeans(df, 2, ["grp"]).collect()}
    assert len({out[i] for i in range(20)}) == 1 and len({out[i] for i in range(20, 40)}) == 1
    assert out[0] != out[20]


def test_unknown_algorithm(spark):
    with pytest.raises(ValueError):
        C.cluster(_pts(spark, [0, 1]), "Nope")


def reference_leaves(x, m, eps=0.0, min_samples=1):
    """Clusters by the single-machine rule, numbered by their smallest member."""
    x, ids = np.asarray(x, float).reshape(len(x), -1), np.arange(len(x))
    core = R.core_distances(x, min_samples) if min_samples > 1 else None
    found = R.leaf_labels(ids, *R.prim_mst(x, ids, core), m, eps)
    number = {leaf: k for k, leaf in enumerate(dict.fromkeys(found[i] for i in sorted(found)))}
    return {int(i): number[found[i]] if i in found else -1 for i in ids}


def blobs(spark, seed, *sizes):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(5 * k, 0.3, (n, 2)) for k, n in enumerate(sizes)])
    df = spark.createDataFrame([("g", i, x[i].tolist()) for i in range(len(x))],
                               "grp string, review_id long, embedding array<double>")
    return x, df


@pytest.fixture(params=[512, 5])
def block_points(request, monkeypatch):
    """Blocks larger than the groups, and much smaller ones."""
    units = B.block_units
    monkeypatch.setattr(B, "block_units", lambda p, g, eps=None: units(p, g, eps, request.param))


def test_leaves_equal_the_reference(spark, block_points):
    x, df = blobs(spark, 5, 12, 12, 6)
    got = {r.review_id: r.clusters for r in C.hdbscan_leaf(df, 5, ["grp"]).collect()}
    assert got == reference_leaves(x, 5)


def test_dbscan_equals_the_reference(spark, block_points):
    x, df = blobs(spark, 6, 12, 12, 6)
    got = {r.review_id: (r.clusters, r.is_core) for r in C.dbscan(df, 0.4, 4, ["grp"]).collect()}
    comp, core = R.dbscan_local(x, np.arange(len(x)), 0.4, 4)
    number = {c: k for k, c in enumerate(sorted({c for c in comp.tolist() if c >= 0}))}
    assert got == {i: (number.get(c, -1), bool(k)) for i, (c, k) in enumerate(zip(comp.tolist(), core.tolist()))}


def test_knn_equals_the_reference(spark, block_points):
    from critica.operators.similarity import knn_pairs
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (24, 3))
    x[5] = x[6] = x[7]  # ties go to the smaller id
    df = spark.createDataFrame([("a", i, x[i].tolist()) for i in range(len(x))],
                               "grp string, review_id long, embedding array<double>")
    got = sorted((r.review_id, r["rank"], r.nbr) for r in knn_pairs(df, 3, ["grp"]).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = [(i, k + 1, j) for i in range(24) for k, (_, j) in enumerate(sorted((d[i, j], j) for j in range(24) if j != i)[:3])]
    assert got == want


def test_clustered_points_leave_few_candidates(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(0, 0.05, (40, 8)) + rng.normal(0, 5, 8) for _ in range(12)])
    df = spark.createDataFrame([("g", i, x[i].tolist()) for i in range(len(x))], "grp string, id long, v array<double>")
    units = B.block_units(df, ["grp"], 0.5)
    assert B.candidate_share(units, ["grp"]) < 0.25
    assert B.candidate_share(B.block_units(df, ["grp"]), ["grp"]) == 1.0


def test_contracted_leaves_equal_the_reference(spark):
    xs = [0, 1, 2.1, 3.3, 4.6, 20, 21.05, 22.2, 23.45, 24.8, 60, 61.02, 62.1, 63.25, 64.5, 10, 40]
    got = {r.review_id: r.clusters for r in C.hdbscan_leaf(_pts(spark, xs), 5, ["grp"], local_edges=0).collect()}
    assert got == reference_leaves(xs, 5)


def test_selection_epsilon(spark):
    xs = [0, 1, 2.1, 3.3, 4.6, 20, 21.05, 22.2, 23.45, 24.8, 60, 61.02, 62.1, 63.25, 64.5, 10, 40]
    df = _pts(spark, xs)
    a = {r.review_id: r.clusters for r in C.hdbscan_leaf(df, 5, ["grp"], eps=15.0).collect()}
    assert [a[i] for i in range(len(xs))] == [0] * 10 + [1] * 5 + [0, 0]
    # All true splits below ε: the root's two children are the clusters (one task, and contraction).
    b = {r.review_id: r.clusters for r in C.hdbscan_leaf(df, 5, ["grp"], eps=25.0).collect()}
    c = {r.review_id: r.clusters for r in C.hdbscan_leaf(df, 5, ["grp"], eps=25.0, local_edges=0).collect()}
    assert b == c == a


def test_min_samples_equal_the_reference(spark, block_points):
    x, df = blobs(spark, 11, 10, 10, 6)
    got = {r.review_id: r.clusters for r in C.hdbscan_leaf(df, 4, ["grp"], min_samples=3).collect()}
    assert got == reference_leaves(x, 4, min_samples=3) and len({v for v in got.values() if v >= 0}) >= 2
