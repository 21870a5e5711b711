"""Random forests for 0/1 labels on sparse vectors (K5).

Spark's own forest holds every row as one number per column, which for a
vocabulary of 2^18 terms is 1 MB a row.  Here a row keeps its non-zero
entries, and what a node knows of a column's zeros is its total less the
entries it met.  The rules are those of Spark's classifier: Poisson(1) row
counts per tree, ceil(sqrt(columns)) columns drawn anew for every node, at
most ``bins`` bins a column, Gini gain above 0, both sides with a row, and
children that give the same answer are merged.

All trees of all labels grow by one level in a pass: tasks add up the row
counts by (node, column, bin, label value), a shuffle combines them, and a
node's best cut is found in its group of at most sqrt(columns) x bins sums.
The driver holds the trees and the bins' bounds, whatever the number of rows.

Cuts lie at 0 and at quantiles of a column's non-zero values.  Labels other
than 0 and 1 are an error; rows with a null vector take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.operators.hinge import entries
from critica.schema import LABELS
from critica.session import cut_lineage

TREES, DEPTH, BINS = 100, 5, 32
#: Rows that are worked on together, and entries that are given bins together.
ROWS, ENTRIES = 256, 1 << 16
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


@dataclass(frozen=True)
class ForestModel:
    """Trees as heaps (root 1, children 2k and 2k + 1), those of the first label first."""
    labels: tuple[str, ...]
    feature: np.ndarray       # trees x nodes; -1 at a leaf
    cut: np.ndarray           # rows with at most this go left
    share: np.ndarray         # share of label 1


def _sparse(part: pa.RecordBatch, name: str):
    """(row of each entry, column, value of ``name``)."""
    row = np.repeat(np.arange(part.num_rows), np.diff(part.column("index").offsets.to_numpy()))
    return row, part.column("index").flatten().to_numpy(zero_copy_only=False), \
        part.column(name).flatten().to_numpy(zero_copy_only=False)


def _walk(n: int, row, index, value, feature, cut, zero, levels: int) -> np.ndarray:
    """(rows x trees) node reached after ``levels`` steps; ``zero(columns)`` is the value of entries that are not there."""
    trees = np.arange(len(feature))
    node = np.ones((n, len(feature)), np.int64)
    used = np.unique(feature[feature >= 0])
    if not len(used):
        return node
    at = np.minimum(np.searchsorted(used, index), len(used) - 1)
    own = used[at] == index
    grid = np.tile(zero(used), (n, 1))
    grid[row[own], at[own]] = value[own]
    column = np.minimum(np.searchsorted(used, feature), len(used) - 1)
    for _ in range(levels):
        right = grid[np.arange(n)[:, None], column[trees, node]] > cut[trees, node]
        node = np.where(feature[trees, node] >= 0, 2 * node + right, node)
    return node


def bootstrap(keys: np.ndarray, trees: int) -> np.ndarray:
    """(rows x trees) Poisson(1) counts, a function of the row's key and the tree."""
    x = keys.astype(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)) / float(1 << 53), side="right").astype(np.float64)


def drawn(width: int, seed: int, tree: int, node: int) -> np.ndarray:
    """The columns that a node may cut."""
    return np.random.default_rng([seed, tree, node]).choice(width, math.ceil(math.sqrt(width)), replace=False)


def bounds(rows: DataFrame, width: int, bins: int) -> np.ndarray:
    """(columns x bins - 1) ascending bounds, padded with infinity: 0 and quantiles of the non-zero values."""
    at = [k / (bins - 1) for k in range(1, bins - 1)]
    found = (rows.select(F.explode(F.arrays_zip("index", "value")).alias("e")).groupBy(F.col("e.index").alias("index"))
             .agg(F.percentile_approx(F.col("e.value"), at, F.lit(1000)).alias("q")).toArrow())
    out = np.full((width, bins - 1), np.inf, np.float32)
    out[:, 0] = 0
    if found.num_rows:
        q = found.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(found.num_rows, -1)
        out[found.column("index").to_numpy(), 1:] = q
    out.sort(axis=1)
    again = np.zeros(out.shape, bool)
    again[:, 1:] = out[:, 1:] == out[:, :-1]
    out[again] = np.inf
    out.sort(axis=1)
    return out


def best_cut(f, b, w, zero, bins: int):
    """(column, bin, counts left of it, counts) of a node; column -1 where no cut gains.

    ``w``: two counts by sum; the sums of column -1 are the node's counts.
    """
    total = w[f < 0].sum(axis=0)
    f, b, w = f[f >= 0], b[f >= 0], w[f >= 0]
    if not len(f):
        return -1, 0, np.zeros(2), total
    own, at = np.unique(f, return_inverse=True)
    sums = np.stack([np.bincount(at * bins + b, w[:, c], len(own) * bins) for c in (0, 1)], axis=1).reshape(len(own), bins, 2)
    sums[np.arange(len(own)), zero[own]] += total - sums.sum(axis=1)
    left = sums.cumsum(axis=1)[:, :-1]
    right = total - left

    def impurity(x):
        n = x.sum(axis=-1)
        return n - (x * x).sum(axis=-1) / np.maximum(n, 1)

    gain = np.where((left.sum(axis=2) >= 1) & (right.sum(axis=2) >= 1), impurity(total) - impurity(left) - impurity(right), 0)
    if not gain.size or gain.max() <= 1e-9:
        return -1, 0, np.zeros(2), total
    k, cut = np.unravel_index(gain.argmax(), gain.shape)
    return int(own[k]), int(cut), left[k, cut], total


def fit(train: DataFrame, labels=LABELS, vec_col: str = "features", id_col: str = "review_id", width: int = 0,
        trees: int = TREES, depth: int = DEPTH, bins: int = BINS, seed: int = 42) -> ForestModel:
    """A forest for every 0/1 label column of ``train``."""
    labels = tuple(labels)
    marks = [F.when(F.col(x).isin(0, 1), F.col(x).cast("double")).otherwise(
        F.raise_error(F.lit(f"{x}: labels are 0 or 1"))) for x in labels]
    rows = cut_lineage(entries(train, vec_col, F.xxhash64(F.col(id_col), F.lit(seed)).alias("key"), F.array(*marks).alias("y")))
    edges = bounds(rows, width, bins)
    zero = (edges < 0).sum(axis=1).astype(np.int64)
    sc = train.sparkSession.sparkContext
    held = sc.broadcast(edges)

    def to_bins(parts):
        for part in parts:
            index = part.column("index").flatten().to_numpy(zero_copy_only=False)
            value = part.column("value").flatten().to_numpy(zero_copy_only=False)
            found = [(held.value[index[a:a + ENTRIES]] < value[a:a + ENTRIES, None]).sum(axis=1).astype(np.int8)
                     for a in range(0, len(index), ENTRIES)] or [np.zeros(0, np.int8)]
            offsets = part.column("index").offsets
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("y"), part.column("index"), pa.ListArray.from_arrays(
                pa.array(offsets.to_numpy() - offsets[0].as_py(), pa.int32()), pa.array(np.concatenate(found)))],
                names=["key", "y", "index", "bin"])

    rows = cut_lineage(rows.mapInArrow(to_bins, "key long, y array<double>, index array<int>, bin array<tinyint>"))
    held.unpersist()
    count, size = len(labels) * trees, 2 << depth
    feature, cut = np.full((count, size), -1, np.int32), np.zeros((count, size), np.int64)
    totals, active = np.zeros((count, size, 2)), np.zeros((count, size), bool)
    active[:, 1] = True
    for level in range(depth):
        nodes = np.flatnonzero(active)
        if not len(nodes):
            break
        columns = np.concatenate([drawn(width, seed, int(g) // size, int(g) % size) for g in nodes])
        pairs = np.repeat(nodes, len(columns) // len(nodes))[np.argsort(columns, kind="stable")].astype(np.int32)
        starts = np.concatenate([[0], np.cumsum(np.bincount(columns, minlength=width))])
        shared = sc.broadcast((feature, cut, active, pairs, starts))

        def sums(parts):
            feature, cut, active, pairs, starts = shared.value
            whole = np.zeros((count * size, 2))
            for part in parts:
                keys, weights = [], []
                for a in range(0, part.num_rows, ROWS):
                    piece = part.slice(a, ROWS)
                    n = piece.num_rows
                    row, index, found = _sparse(piece, "bin")
                    y = piece.column("y").flatten().to_numpy(zero_copy_only=False).reshape(n, len(labels)).astype(np.int64)
                    y = np.repeat(y, trees, axis=1)
                    g = _walk(n, row, index, found, feature, cut, zero.__getitem__, level) + np.arange(count) * size
                    w = np.tile(bootstrap(piece.column("key").to_numpy(), trees), (1, len(labels))) * active.ravel()[g]
                    whole += np.bincount((2 * g + y).ravel(), w.ravel(), 2 * count * size).reshape(-1, 2)
                    # Every entry meets the nodes that may cut its column; its row is in few of them.
                    met = starts[index + 1] - starts[index]
                    entry = np.repeat(np.arange(len(index)), met)
                    node = pairs[np.arange(len(entry)) + np.repeat(starts[index] - (np.cumsum(met) - met), met)].astype(np.int64)
                    own, tree = row[entry], node // size
                    here = np.flatnonzero((g[own, tree] == node) & (w[own, tree] > 0))
                    entry, node, own, tree = entry[here], node[here], own[here], tree[here]
                    keys.append(((node * width + index[entry]) * bins + found[entry]) * 2 + y[own, tree])
                    weights.append(w[own, tree])
                some, at = np.unique(np.concatenate(keys or [np.zeros(0, np.int64)]), return_inverse=True)
                yield batch(some >> 1, np.bincount(at, np.concatenate(weights or [np.zeros(0)]), len(some)), some & 1)
            some = np.flatnonzero(whole.ravel())
            yield batch((some >> 1) * width * bins, whole.ravel()[some], some & 1, whole_node=True)

        def batch(key, w, y, whole_node=False):
            at = key // bins
            return pa.RecordBatch.from_arrays([
                pa.array(at // width, pa.int32()), pa.array(np.full(len(key), -1) if whole_node else at % width, pa.int32()),
                pa.array(key % bins, pa.int32()), pa.array(np.where(y == 0, w, 0.0)), pa.array(np.where(y == 1, w, 0.0))],
                names=["g", "f", "b", "w0", "w1"])

        def best(table: pa.Table) -> pa.Table:
            g, f, b, w0, w1 = (table.column(c).to_numpy() for c in ("g", "f", "b", "w0", "w1"))
            column, at, left, total = best_cut(f, b, np.stack([w0, w1], axis=1), zero, bins)
            return pa.table({"g": pa.array(g[:1], pa.int32()), "f": pa.array([column], pa.int32()), "b": pa.array([at], pa.int32()),
                             "l0": [left[0]], "l1": [left[1]], "t0": [total[0]], "t1": [total[1]]})

        found = (rows.mapInArrow(sums, "g int, f int, b int, w0 double, w1 double")
                 .groupBy("g", "f", "b").agg(F.sum("w0").alias("w0"), F.sum("w1").alias("w1"))
                 .groupBy("g").applyInArrow(best, "g int, f int, b int, l0 double, l1 double, t0 double, t1 double").toArrow())
        shared.unpersist()
        feature, cut, active = feature.copy(), cut.copy(), np.zeros_like(active)
        for r in found.to_pylist():
            tree, node = divmod(r["g"], size)
            totals[tree, node] = total = np.array([r["t0"], r["t1"]])
            if r["f"] >= 0:
                feature[tree, node], cut[tree, node] = r["f"], r["b"]
                totals[tree, 2 * node] = left = np.array([r["l0"], r["l1"]])
                totals[tree, 2 * node + 1] = total - left
                for child in (2 * node, 2 * node + 1):
                    active[tree, child] = level + 1 < depth and totals[tree, child].min() > 0
    answer = totals[:, :, 1] > totals[:, :, 0]
    for node in range(size // 2 - 1, 0, -1):
        same = (feature[:, 2 * node] < 0) & (feature[:, 2 * node + 1] < 0) & (answer[:, 2 * node] == answer[:, 2 * node + 1])
        feature[same, node] = -1
    return ForestModel(labels, feature, np.where(feature >= 0, edges[feature, cut], 0).astype(np.float64),
                       totals[:, :, 1] / np.maximum(totals.sum(axis=2), 1))


def predict(model: ForestModel, df: DataFrame, vec_col: str = "features", id_col: str = "review_id") -> DataFrame:
    """(id, prob_<label> ...): the mean share of label 1 in the leaves that a row reaches."""
    shared = df.sparkSession.sparkContext.broadcast((model.feature, model.cut, model.share))
    count = len(model.labels)

    def score(parts):
        feature, cut, share = shared.value
        levels, trees = int(math.log2(feature.shape[1])) - 1, len(feature) // count
        for part in parts:
            for a in range(0, part.num_rows, ROWS):
                piece = part.slice(a, ROWS)
                node = _walk(piece.num_rows, *_sparse(piece, "value"), feature, cut, lambda used: np.zeros(len(used)), levels)
                p = share[np.arange(len(feature)), node].reshape(-1, count, trees).mean(axis=2)
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(p[:, j]) for j in range(count))],
                                                 names=["id", *[f"prob_{label}" for label in model.labels]])

    kind = df.schema[id_col].dataType.simpleString()
    found = entries(df, vec_col, F.col(id_col).alias("id")).mapInArrow(
        score, ", ".join([f"id {kind}"] + [f"prob_{label} double" for label in model.labels]))
    return found.withColumnRenamed("id", id_col)
