"""The forest against a replay of its rules, and on more columns than dense rows could hold."""
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from critica.operators import classify as K
from critica.operators import forest as T

LABELS = ("a", "b")


def frame(spark, x, y, width=None):
    rows = [(i, Vectors.sparse(width or len(v), {int(j): float(v[j]) for j in np.flatnonzero(v)}), int(y[i, 0]), int(y[i, 1]))
            for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["review_id", "features", "a", "b"])


def grown(x, y, w, tree, node, depth, edges, seed):
    """(column, cut, left, right) or the share of 1, by the rules and from dense rows."""
    def gini(m):
        n = w[m].sum()
        p = (w[m] * y[m]).sum() / n if n else 0
        return n * 2 * p * (1 - p)

    every = w > 0
    share = (w * y).sum() / w.sum()
    best = (1e-9, None)
    if depth and 0 < share < 1:
        for f in sorted(T.drawn(x.shape[1], seed, tree, node)):
            for k, e in enumerate(edges[f]):
                left = every & (x[:, f] <= e)
                if left.any() and (every & ~left).any():
                    gain = gini(every) - gini(left) - gini(every & ~left)
                    if gain > best[0] + 1e-9:
                        best = (gain, (f, float(e), left))
    if best[1] is None:
        return share
    f, e, left = best[1]
    sides = [grown(x, y, np.where(m, w, 0), tree, 2 * node + k, depth - 1, edges, seed) for k, m in enumerate((left, every & ~left))]
    if not any(isinstance(s, tuple) for s in sides) and (sides[0] > 0.5) == (sides[1] > 0.5):
        return share
    return f, e, *sides


def answer(tree, v):
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def test_forest_equals_a_replay(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 12)) * (rng.random((80, 12)) < 0.4), 1)
    y = np.stack([(x[:, 0] + x[:, 3] > 0), rng.random(80) < 0.3], axis=1).astype(int)
    df = frame(spark, x, y).repartition(5)
    model = T.fit(df, LABELS, width=12, trees=6, depth=3, bins=8, seed=5)
    got = {r.review_id: (r.prob_a, r.prob_b) for r in T.predict(model, df).collect()}
    keys = {r.review_id: r.k for r in df.select("review_id", F.xxhash64("review_id", F.lit(5)).alias("k")).collect()}
    w = T.bootstrap(np.array([keys[i] for i in range(80)]), 6)
    edges = T.bounds(T.entries(df, "features"), 12, 8)
    edges = [e[np.isfinite(e)] for e in edges]
    for j in range(2):
        own = [grown(x, y[:, j], w[:, t], 6 * j + t, 1, 3, edges, 5) for t in range(6)]
        for i in range(80):
            assert abs(got[i][j] - np.mean([answer(t, x[i]) for t in own])) < 1e-9


def test_partitioning_changes_nothing_and_counts_are_poisson(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(40, 6)), rng.integers(0, 2, (40, 2))
    one, many = (T.fit(d, LABELS, width=6, trees=4, depth=3) for d in (frame(spark, x, y).coalesce(1), frame(spark, x, y).repartition(9)))
    assert (one.feature == many.feature).all() and np.allclose(one.cut, many.cut) and np.allclose(one.share, many.share)
    w = T.bootstrap(np.arange(20_000), 10)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - np.exp(-1)) < 0.01


def test_a_wide_vocabulary_takes_no_dense_rows(spark):
    """2^18 columns: with one number per column the 2,000 rows would be 2 GB."""
    width, rng = 1 << 18, np.random.default_rng(8)
    rows = [(i, Vectors.sparse(width, {int(j): 1.0 for j in np.append(rng.choice(width - 600, 40, replace=False) + 600,
                                                                     rng.choice(300, 30, replace=False) + 300 * (i % 2))}), i % 2, 0)
            for i in range(2000)]
    df = spark.createDataFrame(rows, ["review_id", "features", "a", "b"]).repartition(8)
    fitted = K.fit_multilabel(df, "RandomForest", LABELS, features_col="features")
    got = K.predict_multilabel(fitted, df, LABELS).select("review_id", "prob_a", "pred_b").collect()
    assert len(got) == 2000 and all(r.pred_b == 0 for r in got)
    assert np.mean([r.prob_a for r in got if r.review_id % 2]) > np.mean([r.prob_a for r in got if not r.review_id % 2])
