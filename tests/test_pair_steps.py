"""What the pair queries move: copies of points, pairs held at once, edges left of trees and components."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from critica.operators import blocks as B
from critica.operators import cluster as C
from critica.operators import graph as G


def kruskal(edges):
    """Edges of the minimum spanning forest, ties by (w, lo, hi)."""
    top, out = {}, set()

    def root(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for w, i, j in sorted(edges):
        if (u := root(i)) != (v := root(j)):
            top[u] = v
            out.add((i, j, w))
    return out


def _points(n, copies=False, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6))
    if copies:
        x = np.round(x[rng.integers(0, n // 6, n)], 1)
    return rng.permutation(n).astype(np.int64), x


def _edges(out):
    return set(zip(out["lo"].tolist(), out["hi"].tolist(), out["w"].tolist()))


@pytest.mark.parametrize("copies", [False, True])
@pytest.mark.parametrize("held", [1 << 20, 512])
def test_unit_tree_between_blocks_is_the_tree_of_the_crossing_edges(copies, held, monkeypatch):
    monkeypatch.setattr(B, "HELD", held)
    ids, x = _points(130, copies)
    a, b = ({"id": ids[s], "v": x[s]} for s in (slice(0, 70), slice(70, 130)))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edge = lambda i, j: (float(d[i, j]), *sorted((int(ids[i]), int(ids[j]))))
    assert _edges(B.unit_tree(a, b)) == kruskal([edge(i, j) for i in range(70) for j in range(70, 130)])
    assert _edges(B.unit_tree(a, None)) == kruskal([edge(i, j) for i in range(70) for j in range(i)])


def test_pairs_leave_a_unit_a_piece_at_a_time(monkeypatch):
    ids, x = _points(400)
    a, b = ({"id": ids[s], "v": x[s]} for s in (slice(0, 250), slice(250, 400)))
    whole = B.pairs_within(2.5)(a, b)
    monkeypatch.setattr(B, "HELD", 4096)
    monkeypatch.setattr(B, "GIVEN", 200)
    parts = list(B.pair_pieces(2.5)(a, b))
    assert len(parts) > 3 and max(len(p["lo"]) for p in parts) < 200 + 4096
    rows = [r for p in parts for r in zip(p["lo"].tolist(), p["hi"].tolist(), p["dist"].tolist())]
    assert len(rows) == len(set(rows)) and set(rows) == set(zip(whole["lo"].tolist(), whole["hi"].tolist(), whole["dist"].tolist()))


def test_vectors_that_are_not_finite_lose_no_other_pair():
    a = {"id": np.arange(4), "v": np.array([[0.0], [np.nan], [0.5], [np.inf]])}
    assert B.pairs_within(1.0)(a, None)["hi"].tolist() == [2]


def test_copies_of_a_point_do_not_grow_with_the_group(spark):
    for n in (15_000, 150_000):
        pts = spark.range(n).select(F.lit("g").alias("g"), "id", F.array(*[
            (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000.0) for c in range(2)]).alias("v"))
        assert B.block_units(pts, ["g"]).count() <= 16 * n


def test_thinned_edges_hold_the_forests(spark):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 2], int(min(i, j)) * 2 + k % 2, int(max(i, j)) * 2 + k % 2, float(w)) for k, (i, j, w) in enumerate(zip(
        rng.integers(0, 60, 900), rng.integers(0, 60, 900), rng.integers(0, 9, 900)))]
    df = spark.createDataFrame(rows, "g string, lo long, hi long, w double")
    want = kruskal({(w, lo, hi) for _, lo, hi, w in rows if lo != hi})
    for piece in (1 << 20, 100):
        kept, whole = G.thinned_edges(df, ["g"], piece)
        got = {(r.lo, r.hi, r.w) for r in kept.collect()}
        assert want <= got and (got == want if whole else len(got) < 900)
    assert G.thinned_edges(df, ["g"])[1]


def test_forest_of_pieces_equals_the_tree(spark, monkeypatch):
    """Groups of several pieces end in Borůvka's rounds."""
    ids, x = _points(80)
    df = spark.createDataFrame([("g", int(i), v.tolist()) for i, v in zip(ids, x)], "g string, review_id long, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, j) for i, j, _ in kruskal([(float(d[p, q]), *sorted((int(ids[p]), int(ids[q])))) for p in range(80) for q in range(p)])}
    thin = G.thinned_edges
    monkeypatch.setattr(C, "thinned_edges", lambda e, g: thin(e, g, 50))
    assert {(r.lo, r.hi) for r in C.minimum_spanning_forest(df, ["g"]).collect()} == want


def test_a_task_moves_a_forest_of_its_edges(spark):
    rng = np.random.default_rng(5)
    pairs = rng.integers(0, 300, (20_000, 2))
    pairs += 1000 * (np.arange(20_000) % 2)[:, None]
    edges = spark.createDataFrame([tuple(map(int, p)) for p in pairs], "src long, dst long").repartition(3)
    for late in (1 << 16, 50):
        assert G._task_forests(edges, late=late).count() <= 3 * 2 * 299
    nodes = spark.range(0, 2000)
    plain = {(r.id, r.component) for r in G.connected_components(nodes, edges).collect()}
    assert {(r.id, r.component) for r in G.connected_components(nodes, edges, dense=True).collect()} == plain
    small = G._task_forests(edges, piece=20, late=10)
    assert {(r.id, r.component) for r in G.connected_components(nodes, small).collect()} == plain


def test_units_with_null_vectors_keep_the_tree_of_all_their_rows(spark):
    """Two points without a vector: the rows that are left are cut evenly, in every unit alike."""
    rows = [("g", i, None if i < 2 else [float(i), 0.0]) for i in range(4)]
    df = spark.createDataFrame(rows, "g string, id long, v array<double>").withColumn("ba", F.lit(0)).withColumn("bb", F.lit(0)).withColumn("side", F.lit(0))
    got = B.run_units(df.select("g", "ba", "bb", "side", "id", "v"), ["g"], B.unit_tree, C.T.StructType(
        B.key_fields(df, ["g"]) + [C.T.StructField(n, t) for n, t in (("lo", C.T.LongType()), ("hi", C.T.LongType()), ("w", C.T.DoubleType()))])).collect()
    assert sorted((r.lo, r.hi, r.w) for r in got) == [(0, 1, 2.0), (0, 2, 1.0), (1, 3, 0.0)] and B.unit_tree.with_nulls is B.spanning_edges
