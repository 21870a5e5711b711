"""Graph loops on DataFrames: connected components and minimum spanning forests.

Both are iterative: every round is a few aggregates and joins over the
edge and node tables, the round's result is written to the shared
checkpoint folder (lineage stays one round deep and a lost executor costs
one round), and the loop stops when nothing changes.  A round cap turns a
non-converging loop into an error instead of an endless job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from critica.session import cut_lineage

#: Edges that a task holds where edges are thinned out.
PIECE = 1 << 20


def _forest(u: np.ndarray, v: np.ndarray, n: int):
    """(positions, components): the minimum spanning forest of edges that come in ascending order, over nodes 0..n-1."""
    comp, at, taken = np.arange(n), np.arange(len(u)), []
    while True:
        cu, cv = comp[u], comp[v]
        apart = cu != cv
        u, v, cu, cv, at = u[apart], v[apart], cu[apart], cv[apart], at[apart]
        if not len(at):
            return np.unique(np.concatenate(taken)) if taken else at, comp
        # A component's lightest edge is its first.
        first, place = np.full(n, len(at)), np.arange(len(at))
        np.minimum.at(first, cu, place)
        np.minimum.at(first, cv, place)
        c = np.flatnonzero(first < len(at))
        edge = first[c]
        taken.append(at[edge])
        to = np.where(cu[edge] == c, cv[edge], cu[edge])
        parent = np.arange(n)
        parent[c] = to
        mutual = (parent[to] == c) & (c < to)
        parent[c[mutual]] = c[mutual]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]


def lightest_forest(lo: np.ndarray, hi: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Positions of the minimum spanning forest's edges, ties by (w, lo, hi)."""
    ids, ends = np.unique(np.concatenate([lo, hi]), return_inverse=True)
    order = np.lexsort((hi, lo, w))
    return order[_forest(ends[:len(lo)][order], ends[len(lo):][order], len(ids))[0]]


def thinned_edges(edges: DataFrame, gkeys, piece: int = PIECE):
    """(edges, whole): fewer edges with the same minimum spanning forests; ``whole`` if they are those forests.

    ``edges``: group keys, lo, hi, w.  A group's edges are dealt over tasks of
    at most about ``piece`` edges, and each keeps the forest of its own: an
    edge that is the heaviest of a cycle there is in no forest of the group.
    This goes on while it pays; a group that fits one task is done then.
    """
    gkeys = list(gkeys)
    columns = [*gkeys, "lo", "hi", "w"]
    live = cut_lineage(edges.select(*columns))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[lightest_forest(pdf["lo"].to_numpy(), pdf["hi"].to_numpy(), pdf["w"].to_numpy())][columns]

    before = None
    while True:
        sizes = cut_lineage(live.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("_n")))
        total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
        if before and total > 0.8 * before:
            return live, False
        dealt = live.join(sizes, gkeys).withColumn("_part", F.pmod(F.xxhash64("lo", "hi"), F.ceil(F.col("_n") / piece)))
        live = cut_lineage(dealt.groupBy(*gkeys, "_part").applyInPandas(keep, live.schema))
        if (most or 0) <= piece:
            return live, True
        before = total


def _task_forests(edges: DataFrame, piece: int = PIECE, late: int = 1 << 16) -> DataFrame:
    """(src, dst): edges with the same components; each task keeps a spanning forest of what it has read.

    An edge inside a component that the task already knows is dropped at
    once; the others are worked in ``late`` at a time.
    """
    def run(batches):
        empty = np.empty(0, np.int64)
        src, dst, ids, comp, new, n = empty, empty, empty, empty, [], 0

        def place(x):
            at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
            return at, ids[at] == x

        def worked_in():
            a, b = (np.concatenate([x, *(p[k] for p in new)]) for k, x in enumerate((src, dst)))
            names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
            kept, label = _forest(ends[:len(a)], ends[len(a):], len(names))
            return a[kept], b[kept], names, label

        for batch in batches:
            a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            if len(ids):
                (i, has_i), (j, has_j) = place(a), place(b)
                other = ~(has_i & has_j & (comp[i] == comp[j]))
                a, b = a[other], b[other]
            new.append((a, b))
            n += len(a)
            if n >= max(late, len(src)):
                src, dst, ids, comp = worked_in()
                new, n = [], 0
                if len(src) >= piece:  # too many points for one task's forest
                    yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])
                    src, dst, ids, comp = empty, empty, empty, empty
        if n:
            src, dst, ids, comp = worked_in()
        if len(src):
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    long = edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
    return long.mapInArrow(run, "src long, dst long")


def _jump(parent: DataFrame) -> DataFrame:
    """One pointer-doubling step: every node points to its grand-parent."""
    return parent.alias("a").join(parent.alias("b"), F.col("a.parent") == F.col("b.node")).select(
        F.col("a.node").alias("node"), F.col("b.parent").alias("parent"))


def _pointer_jump(parent: DataFrame, max_rounds: int = 32, hops: int = 3) -> DataFrame:
    """Resolve a forest of parent pointers (node, parent) to (node, root).

    Roots point to themselves.  Each round chains ``hops`` doubling steps in
    one plan (depth shrinks by 2^hops), writes the result once, and stops
    when every node points at a root.
    """
    for _ in range(max_rounds):
        nxt = parent
        for _ in range(hops):
            nxt = _jump(nxt)
        parent = cut_lineage(nxt)
        pending = parent.alias("a").join(parent.alias("b"), F.col("a.parent") == F.col("b.node")).where(
            F.col("b.parent") != F.col("b.node")).limit(1).count()
        if not pending:
            return parent
    raise RuntimeError("pointer jumping did not converge")


def connected_components(nodes: DataFrame, edges: DataFrame, id_col: str = "id",
                         max_rounds: int = 200, dense: bool = False) -> DataFrame:
    """(id, component) with component = smallest id of the component.

    Min-label propagation over both edge directions, followed each round
    by pointer jumping on the labels (label ← label of label), so chains
    collapse geometrically.  ``edges`` has columns ``src``, ``dst``.
    ``dense``: many more edges than nodes (integer ids); the edges are read
    once, and of each task's only a spanning forest is moved.
    """
    if dense:
        edges = _task_forests(edges)
    labels = cut_lineage(nodes.select(F.col(id_col).alias("node")).distinct()
                         .withColumn("label", F.col("node")))
    und = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    und = cut_lineage(und.where(F.col("a") != F.col("b")).distinct())
    for _ in range(max_rounds):
        nb = und.join(labels.withColumnRenamed("node", "b").withColumnRenamed("label", "lb"), "b") \
            .groupBy("a").agg(F.min("lb").alias("m"))
        prop = labels.join(nb.withColumnRenamed("a", "node"), "node", "left").select(
            "node", F.least(F.col("label"), F.coalesce(F.col("m"), F.col("label"))).alias("label"))
        # Shortcuts: adopt the label of the current label, twice per round.
        jumped = prop
        for _ in range(2):
            jumped = jumped.alias("p").join(jumped.alias("q"), F.col("p.label") == F.col("q.node"), "left").select(
                F.col("p.node").alias("node"),
                F.least(F.col("p.label"), F.coalesce(F.col("q.label"), F.col("p.label"))).alias("label"))
        jumped = cut_lineage(jumped)
        changed = jumped.alias("n").join(labels.alias("o"), "node").where(
            F.col("n.label") != F.col("o.label")).limit(1).count()
        labels = jumped
        if not changed:
            return labels.select(F.col("node").alias(id_col), F.col("label").alias("component"))
    raise RuntimeError(f"connected_components: no convergence in {max_rounds} rounds")


def boruvka(edges: DataFrame, comp: DataFrame, max_rounds: int = 64):
    """Minimum spanning forest of ``edges`` over the components in ``comp``.

    ``edges``: lo, hi, w (lo < hi point ids).  ``comp``: id, comp (a
    point's current component).  Ties are broken by (w, lo, hi), a total
    order, so the hooking never forms a cycle longer than two (which is
    cut at its smaller end).  Returns (selected edges, final comp).
    """
    comp = cut_lineage(comp)
    e = edges.select("lo", "hi", "w")
    selected = None
    for _ in range(max_rounds):
        ce = (e.join(comp.select(F.col("id").alias("lo"), F.col("comp").alias("cu")), "lo")
              .join(comp.select(F.col("id").alias("hi"), F.col("comp").alias("cv")), "hi")
              .where(F.col("cu") != F.col("cv")))
        ce = cut_lineage(ce)
        if ce.limit(1).count() == 0:
            break
        e = ce.select("lo", "hi", "w")
        cand = ce.select(F.col("cu").alias("c"), F.col("cv").alias("o"), "w", "lo", "hi").unionByName(
            ce.select(F.col("cv").alias("c"), F.col("cu").alias("o"), "w", "lo", "hi"))
        best = cand.groupBy("c").agg(F.min(F.struct("w", "lo", "hi", "o")).alias("b")).select(
            "c", F.col("b.w").alias("w"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"),
            F.col("b.o").alias("o"))
        chosen = best.select("lo", "hi", "w").distinct()
        selected = chosen if selected is None else selected.unionByName(chosen)
        # Hook every component to the partner of its best edge; a mutual
        # pair keeps its smaller id as root.
        par = best.alias("x").join(best.alias("y"), F.col("x.o") == F.col("y.c"), "left").select(
            F.col("x.c").alias("node"),
            F.when((F.col("y.o") == F.col("x.c")) & (F.col("x.c") < F.col("x.o")), F.col("x.c"))
            .otherwise(F.col("x.o")).alias("parent"))
        roots = comp.select(F.col("comp").alias("node")).distinct().join(par, "node", "left_anti") \
            .withColumn("parent", F.col("node"))
        root_of = _pointer_jump(par.unionByName(roots))
        comp = comp.join(root_of.select(F.col("node").alias("comp"), F.col("parent").alias("root")), "comp") \
            .select("id", F.col("root").alias("comp"))
        comp = cut_lineage(comp)
    if selected is None:
        selected = edges.select("lo", "hi", "w").limit(0)
    return selected, comp
