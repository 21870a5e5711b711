"""Linear support vector machines by stochastic gradient descent on the hinge loss (K3).

Reviews are sparse unit vectors over hashed terms (``encode.tfidf_encoder``).
An epoch deals the rows into mini-batches by a hash of (id, epoch), a fixed
order that no partitioning changes.  A step adds up, in every task, the
gradient of its rows of the batch for all labels, combines these sums by
(label, term) in a shuffle, and moves the weights by their average; the
step size falls as 1 / (alpha (t0 + t)).  The driver holds the weights, one
number per label and hashed term, whatever the number of rows; a task gets
them with the step.

All labels are trained in the same passes.  Rows with a null vector take
no part; an empty table gives zero weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators.encode import WIDTH
from critica.schema import LABELS
from critica.session import cut_lineage

ALPHA, EPOCHS, BATCHES, RATE = 1e-3, 5, 8, 1.0
#: Rows that are worked on together.
ROWS = 1024


@dataclass(frozen=True)
class HingeModel:
    labels: tuple[str, ...]
    weights: np.ndarray       # labels x width
    intercepts: np.ndarray


def entries(df: DataFrame, vec_col: str, *columns) -> DataFrame:
    """(columns, index, value): the non-zero entries of ML vectors as two arrays per row."""
    from pyspark.sql.functions import arrow_udf

    kind = pa.struct([("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float64()))])

    def some(vectors: pa.Array) -> pa.Array:
        out = []
        for x in vectors:
            if not x.is_valid:
                out.append(None)
                continue
            w = x["values"].values.to_numpy(zero_copy_only=False)
            at = x["indices"].values.to_numpy(zero_copy_only=False) if x["type"].as_py() == 0 else np.arange(len(w))
            out.append({"index": at[w != 0].astype(np.int32), "value": w[w != 0]})
        return pa.array(out, kind)

    @arrow_udf("struct<index: array<int>, value: array<double>>")
    def taken(vectors: pa.Array) -> pa.Array:
        return pa.concat_arrays([some(vectors.slice(a, ROWS)) for a in range(0, len(vectors), ROWS)] or [pa.array([], kind)])

    return df.where(F.col(vec_col).isNotNull()).withColumn("_e", taken(vec_col)).select(*columns, "_e.index", "_e.value")


def batch_of(id_col, epoch: int, batches: int):
    """The mini-batch of a row in an epoch."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(epoch)), F.lit(batches))


def _slices(parts):
    """Batches in pieces of ``ROWS`` rows: what a worker holds does not grow with its batches."""
    for part in parts:
        for a in range(0, part.num_rows, ROWS):
            yield part.slice(a, ROWS)


def _scores(batch: pa.RecordBatch, weights: np.ndarray, intercepts: np.ndarray):
    """(rows x labels margins, row of each entry, index, value)."""
    lens = np.diff(batch.column("index").offsets.to_numpy())
    row = np.repeat(np.arange(batch.num_rows), lens)
    index = batch.column("index").flatten().to_numpy(zero_copy_only=False)
    value = batch.column("value").flatten().to_numpy(zero_copy_only=False)
    margins = np.tile(intercepts, (batch.num_rows, 1))
    for j in range(len(weights)):
        margins[:, j] += np.bincount(row, weights[j][index] * value, batch.num_rows)
    return margins, row, index, value


def fit(train: DataFrame, labels=LABELS, vec_col: str = "embedding", id_col: str = "review_id", width: int = WIDTH,
        alpha: float = ALPHA, epochs: int = EPOCHS, batches: int = BATCHES, rate: float = RATE) -> HingeModel:
    """Weights for every 0/1 label column of ``train``."""
    labels = tuple(labels)
    rows = cut_lineage(entries(train, vec_col, F.col(id_col).alias("id"), F.array(
        *[(2 * F.col(label) - 1).cast("double") for label in labels]).alias("y")))
    weights, intercepts, t = np.zeros((len(labels), width)), np.zeros(len(labels)), 0
    for epoch in range(epochs):
        for b in range(batches):
            # Each step ships the weights that its rows are scored with.
            shared = train.sparkSession.sparkContext.broadcast((weights, intercepts))

            def gradient(parts):
                w, c = shared.value
                total, shift, n = np.zeros_like(w), np.zeros(len(w)), 0
                for part in _slices(parts):
                    margins, row, index, value = _scores(part, w, c)
                    y = part.column("y").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(w))
                    pull = np.where(y * margins < 1, y, 0.0)
                    n += part.num_rows
                    shift += pull.sum(axis=0)
                    for j in range(len(w)):
                        np.add.at(total[j], index, pull[row, j] * value)
                for j in range(len(w)):
                    some = np.flatnonzero(total[j])
                    # Behind the terms: the intercept (-1) and the rows (-2).
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(some) + 2, j), pa.int32()), pa.array(np.concatenate([some, [-1, -2]]), pa.int32()),
                        pa.array(np.concatenate([total[j, some], [shift[j], n]]))], names=["label", "term", "g"])

            found = rows.where(batch_of("id", epoch, batches) == b).mapInArrow(gradient, "label int, term int, g double") \
                .groupBy("label", "term").agg(F.sum("g").alias("g")).where("g <> 0").toArrow()
            shared.unpersist()
            label, term, g = (found.column(c).to_numpy() for c in ("label", "term", "g"))
            n = float(g[(term == -2) & (label == 0)].sum())
            if not n:
                continue
            t += 1
            step = 1.0 / (alpha * (1.0 / (alpha * rate) + t))
            weights = weights * (1.0 - step * alpha)
            intercepts = intercepts.copy()
            real = term >= 0
            np.add.at(weights, (label[real], term[real]), step * g[real] / n)
            np.add.at(intercepts, label[term == -1], step * g[term == -1] / n)
    return HingeModel(labels, weights, intercepts)


def predict(model: HingeModel, df: DataFrame, vec_col: str = "embedding", id_col: str = "review_id") -> DataFrame:
    """(id, pred_<label> ...): a label is given if its margin is above 0."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.intercepts))

    def score(parts):
        w, c = shared.value
        for part in _slices(parts):
            margins = _scores(part, w, c)[0]
            yield pa.RecordBatch.from_arrays([part.column("id")] + [
                pa.array((margins[:, j] > 0).astype(np.int32)) for j in range(len(w))],
                names=["id", *[f"pred_{label}" for label in model.labels]])

    kind = df.schema[id_col].dataType.simpleString()
    found = entries(df, vec_col, F.col(id_col).alias("id")).mapInArrow(
        score, ", ".join([f"id {kind}"] + [f"pred_{label} int" for label in model.labels]))
    return found.withColumnRenamed("id", id_col)
