"""Hinge descent against a numpy replay of the same batches."""
import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from critica.operators import hinge as H

LABELS = ("a", "b")


def frame(spark, x, y):
    rows = [(i, Vectors.dense(v.tolist()) if i % 2 else Vectors.sparse(len(v), {int(j): float(v[j]) for j in np.flatnonzero(v)}),
             int(y[i, 0]), int(y[i, 1])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, ["review_id", "embedding", "a", "b"])


def test_weights_equal_a_replay(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 12)) * (rng.random((60, 12)) < 0.5)
    y = np.stack([(x[:, 0] + 0.3 * x[:, 1] > 0), rng.random(60) < 0.3], axis=1).astype(int)
    df = frame(spark, x, y).repartition(5)
    model = H.fit(df, LABELS, width=12, epochs=3, batches=4)
    order = {(e, r.review_id): r.b for e in range(3)
             for r in df.select("review_id", H.batch_of("review_id", e, 4).alias("b")).collect()}
    w, c, t = np.zeros((2, 12)), np.zeros(2), 0
    for e in range(3):
        for b in range(4):
            own = [i for i in range(60) if order[e, i] == b]
            if not own:
                continue
            t += 1
            sign = 2 * y[own] - 1
            pull = np.where(sign * (x[own] @ w.T + c) < 1, sign, 0)
            step = 1 / (H.ALPHA * (1 / (H.ALPHA * H.RATE) + t))
            w, c = w * (1 - step * H.ALPHA) + step * (pull.T @ x[own]) / len(own), c + step * pull.sum(0) / len(own)
    assert np.allclose(model.weights, w, atol=1e-9) and np.allclose(model.intercepts, c, atol=1e-9)
    got = {r.review_id: (r.pred_a, r.pred_b) for r in H.predict(model, df).collect()}
    assert got == {i: tuple((x[i] @ w.T + c > 0).astype(int)) for i in range(60)}
    assert np.mean([got[i][0] == y[i, 0] for i in range(60)]) > 0.9


def test_partitioning_changes_nothing(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(30, 5)), rng.integers(0, 2, (30, 2))
    one = H.fit(frame(spark, x, y).coalesce(1), LABELS, width=5, epochs=2, batches=3)
    many = H.fit(frame(spark, x, y).repartition(9), LABELS, width=5, epochs=2, batches=3)
    assert np.allclose(one.weights, many.weights, atol=1e-12)


def test_rows_without_a_vector(spark):
    df = frame(spark, np.eye(4), np.ones((4, 2), int)).withColumn("embedding", F.when(F.col("review_id") > 1, F.col("embedding")))
    model = H.fit(df, LABELS, width=4, epochs=1, batches=1)
    assert model.weights[:, :2].sum() == 0 and (model.weights[:, 2:] > 0).all()
    assert H.predict(model, df).count() == 2
    assert not H.fit(df.limit(0), LABELS, width=4, epochs=1, batches=1).weights.any()


def test_batches_are_worked_on_in_bounded_pieces():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"id": list(range(2 * H.ROWS + 5)), "index": [[i % 7] for i in range(2 * H.ROWS + 5)]})
    pieces = list(H._slices([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in pieces] == [H.ROWS, H.ROWS, 5]
    assert [i for p in pieces for i in p.column("id").to_pylist()] == list(range(2 * H.ROWS + 5))
    margins, row, index, _ = H._scores(pa.RecordBatch.from_pydict({
        "index": pieces[2].column("index"), "value": pa.array([[2.0]] * 5)}), np.ones((1, 7)), np.zeros(1))
    assert margins.tolist() == [[2.0]] * 5 and row.tolist() == list(range(5)) and index.tolist() == [i % 7 for i in range(2 * H.ROWS, 2 * H.ROWS + 5)]
