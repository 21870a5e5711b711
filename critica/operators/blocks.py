"""Work on all relevant pairs of points, block against block.

Points of a group belong to the nearest of at most ``PIVOTS`` pivots (the
points with the smallest id hashes); a cell has its pivot and the largest
distance to it.  Cells are split by id hash into blocks of about
``BLOCK_BYTES`` of vectors, at most ``BLOCK_POINTS`` points.  Two cells can
hold points within ``eps`` only if
the distance of their pivots is at most ``eps`` plus both radii, so all
other cell pairs are cut.  A unit of work is a pair of blocks (or a block
with itself): at most two blocks in one task, whatever the group's size.
Inside a unit numpy does the arithmetic and returns only what the caller
keeps, never the pairs themselves.

Where the data allow no pruning (vectors without clusters, or no ``eps``)
all block pairs of a group meet and n^2 distances are computed.  A point
moves to as many units as the group has blocks: about ``PIVOTS``, and more
only where a cell passes a block (131,072 points of 64 numbers).
``candidate_share`` tells which part of all pairs the units cover.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from critica.functions import vectors as V
from critica.session import cut_lineage

BLOCK_POINTS, BLOCK_BYTES = 1 << 17, 64 << 20
#: Distances that a kernel holds at once, pairs whose exact distance is taken at once, and pairs that leave it at once.
HELD, EXACT, GIVEN = 1 << 20, 1 << 16, 1 << 18
PIVOTS = 16


def _cells(pts: DataFrame, gkeys: list[str]) -> DataFrame:
    """``pts`` with their cell and the distance to its pivot."""
    order = Window.partitionBy(*gkeys).orderBy(F.xxhash64("id"), "id")
    first = pts.select(*gkeys, "id", "v").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= PIVOTS)
    pivots = first.groupBy(*gkeys).agg(F.sort_array(F.collect_list(F.struct("_r", "v"))).alias("_pivots"))
    near = F.array_min(F.transform("_pivots", lambda p, i: F.struct(V.distance("v", p["v"]).alias("d"), i.alias("c"))))
    return pts.join(pivots, gkeys).withColumn("_near", near).select(
        *pts.columns, F.col("_near.c").alias("cell"), F.col("_near.d").alias("far"),
        F.get(F.col("_pivots"), F.col("_near.c"))["v"].alias("pivot"))


def block_units(points: DataFrame, gkeys, eps: float | None = None, block: int | None = None) -> DataFrame:
    """(gkeys, ba, bb, side, columns of points) for every unit: the points of block ba (side 0) and bb (side 1).

    ``points`` has the group keys, ``id``, ``v`` (array<double>) and any other columns.
    ``block``: points of a block; without it as many as ``BLOCK_BYTES`` hold.
    """
    gkeys = list(gkeys)
    size = F.lit(block) if block else F.least(F.lit(BLOCK_POINTS), F.greatest(
        F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.greatest(F.lit(1), F.coalesce(F.max(F.size("v")), F.lit(1)))))))
    pts = cut_lineage(_cells(points, gkeys))
    cells = cut_lineage(pts.groupBy(*gkeys, "cell").agg(
        F.max("far").alias("r"), F.first("pivot").alias("p"), F.ceil(F.count(F.lit(1)) / size).cast("int").alias("n")))
    x = cells.select(*gkeys, F.col("cell").alias("ca"), F.col("r").alias("ra"), F.col("p").alias("pa"))
    y = cells.select(*gkeys, F.col("cell").alias("cb"), F.col("r").alias("rb"), F.col("p").alias("pb"), F.col("n").alias("nb"))
    meet = x.join(y, gkeys)  # at most PIVOTS^2 rows a group
    if eps is not None:
        meet = meet.where(V.distance("pa", "pb") <= (F.lit(float(eps)) + F.col("ra") + F.col("rb")) * (1 + 1e-9) + 1e-12)
    partners = meet.groupBy(*gkeys, "ca").agg(F.sort_array(F.collect_list(F.struct("cb", "nb"))).alias("_with"))
    own = cells.select(*gkeys, F.col("cell").alias("ca"), F.col("n").alias("na")).join(partners, [*gkeys, "ca"])
    code = 1 << 24
    rows = pts.withColumnRenamed("cell", "ca").join(own, [*gkeys, "ca"]).withColumn(
        "_own", F.col("ca").cast("long") * code + F.pmod(F.xxhash64("id"), F.col("na")))
    others = F.flatten(F.transform("_with", lambda w: F.transform(
        F.sequence(F.lit(0), w["nb"] - 1), lambda k: w["cb"].cast("long") * code + k)))
    rest = [c for c in points.columns if c not in gkeys]
    rows = rows.select(*gkeys, *rest, "_own", F.explode(others).alias("_other"))
    return rows.select(*gkeys, F.least("_own", "_other").alias("ba"), F.greatest("_own", "_other").alias("bb"),
                       F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("side"), *rest)


def run_units(units: DataFrame, gkeys, kernel, schema: T.StructType) -> DataFrame:
    """One ``kernel(a, b)`` call per unit; each side is a dict of columns, ``b`` None for a block with itself.

    The kernel returns a dict of columns without the group keys, which lead ``schema``, or yields several.
    """
    gkeys = list(gkeys)
    rest = [c for c in units.columns if c not in (*gkeys, "ba", "bb", "side")]
    keys = [*gkeys, "ba", "bb"]
    dealt = units.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "side").select(*keys, "side", *rest)

    def one(table: pa.Table):
        side = table.column("side").to_numpy()
        columns = {}
        for c in rest:
            col = table.column(c).combine_chunks()
            if pa.types.is_list(col.type):
                columns[c] = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
            else:
                columns[c] = col.to_numpy(zero_copy_only=False)
        same = table.column("ba")[0].as_py() == table.column("bb")[0].as_py()
        a = {c: v if same else v[side == 0] for c, v in columns.items()}
        b = None if same else {c: v[side == 1] for c, v in columns.items()}
        if b is not None and not (len(a["id"]) and len(b["id"])):
            return
        nulls = any(table.column(c).null_count for c in rest if pa.types.is_list(table.column(c).type))
        found = (getattr(kernel, "with_nulls", kernel) if nulls else kernel)(a, b)
        for out in [found] if isinstance(found, dict) else found:
            n = len(next(iter(out.values())))
            lead = [pa.array([table.column(k)[0].as_py()] * n, f.type) for k, f in
                    ((k, table.schema.field(k)) for k in gkeys)]
            if n:
                yield pa.RecordBatch.from_arrays(lead + [pa.array(v) for v in out.values()], names=gkeys + list(out))

    def work(batches):
        held, key = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            cuts = [0] + [i for i in range(1, len(codes)) if codes[i] != codes[i - 1]] + [len(codes)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if held and codes[lo] != key:
                    yield from one(pa.Table.from_batches(held))
                    held = []
                key = codes[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from one(pa.Table.from_batches(held))

    return dealt.mapInArrow(work, schema)


def key_fields(points: DataFrame, gkeys) -> list[T.StructField]:
    return [points.schema[k] for k in gkeys]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by the expanded form (exact ones are taken for the pairs kept)."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * x @ y.T, 0.0)


def margin(x: np.ndarray, y: np.ndarray) -> float:
    """Bound, far above the rounding, on the error of ``distances``; infinite or NaN where components are not finite."""
    return 1e-9 * float(max((x * x).sum(1).max(), (y * y).sum(1).max()))


def apart(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of the pairs (x[i], y[j])."""
    out = np.empty(len(i))
    for at in range(0, len(i), EXACT):
        s = slice(at, at + EXACT)
        out[s] = np.sqrt(((x[i[s]] - y[j[s]]) ** 2).sum(1))
    return out


def halves(x: np.ndarray, y: np.ndarray):
    """(u, w, slack): ``u @ w.T`` holds half the squared distances of the rows of ``x`` and ``y``, with an error below ``slack``.

    Vectors are taken from their mean, so a common offset costs no digits,
    and in single precision where their lengths allow it.  ``slack`` is twice
    the bound on the rounding of the cast and the sums.  Components are finite.
    """
    at = y.mean(0)
    x, y = x - at, y - at
    longest = max(float((p * p).sum(1).max()) for p in (x, y))
    kind = np.float32 if 1e-24 < longest < 1e24 else np.float64
    x, y = x.astype(kind), y.astype(kind)
    sx, sy = ((p.astype(np.float64) ** 2).sum(1).astype(kind) / 2 for p in (x, y))
    u = np.concatenate([x, sx[:, None], np.ones((len(x), 1), kind)], 1)
    w = np.concatenate([-y, np.ones((len(y), 1), kind), sy[:, None]], 1)
    return u, w, 2.0 * (x.shape[1] + 8) * float(np.finfo(kind).eps) * longest


def pair_pieces(eps: float, differ: bool = False):
    """Kernel: (lo, hi, dist) of the pairs within ``eps``, some at a time; ``differ``: with different ``dc`` only."""
    def kernel(a, b):
        # A vector that is not finite is within eps of none.
        a, b = (s and {c: v[fine] for c, v in s.items()} for s, fine in ((s, s and np.isfinite(s["v"]).all(1)) for s in (a, b)))
        y = a if b is None else b
        held, n = [], 0
        if len(a["id"]) and len(y["id"]):
            u, w, slack = halves(a["v"], y["v"])
            bar, tile = eps * eps / 2 * (1 + 1e-9) + slack, max(1, int(HELD ** 0.5) // 2)
            for at in range(0, len(u), tile):
                for to in range(at if b is None else 0, len(w), tile):
                    part = u[at:at + tile] @ w[to:to + tile].T
                    i, j = np.divmod(np.flatnonzero(part <= bar), part.shape[1])
                    i, j = i + at, j + to
                    ids, others = a["id"][i], y["id"][j]
                    keep = ids != others
                    if b is None:
                        keep &= i < j
                    if differ:
                        keep &= a["dc"][i] != y["dc"][j]
                    i, j, ids, others = i[keep], j[keep], ids[keep], others[keep]
                    dist = apart(a["v"], y["v"], i, j)
                    near = dist <= eps
                    ids, others, dist = ids[near], others[near], dist[near]
                    held.append((np.minimum(ids, others), np.maximum(ids, others), dist))
                    n += len(ids)
                    if n >= GIVEN:
                        yield _columns(held)
                        held, n = [], 0
        yield _columns(held or [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))])
    return kernel


def _columns(parts) -> dict:
    return {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("lo", "hi", "dist"))}


def pairs_within(eps: float, differ: bool = False):
    """``pair_pieces`` with all pairs of a unit at once."""
    def kernel(a, b):
        parts = [tuple(p.values()) for p in pair_pieces(eps, differ)(a, b)]
        return _columns(parts)
    return kernel


def nearest(k: int):
    """Kernel: (id, nbr, dist): each point's k nearest of the other side (ties by id)."""
    def of(x, y, same):
        out, slack, n = [[], [], []], 2 * margin(x["v"], y["v"]), len(y["id"])
        rows = max(1, HELD // 2 // n)
        for at in range(0, len(x["id"]), rows):
            v, ids = x["v"][at:at + rows], x["id"][at:at + rows]
            # The expanded form screens; exact distances are taken for what can be among the k nearest.
            if np.isfinite(slack) and k < n:
                d2 = distances(v, y["v"])
                if same:
                    d2[np.arange(len(ids)), np.arange(at, at + len(ids))] = np.inf
                i, j = np.nonzero(d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1:k] + slack)
            else:
                i, j = np.divmod(np.arange(len(ids) * n), n)
            if same:
                other = i + at != j
                i, j = i[other], j[other]
            dist = apart(v, y["v"], i, j)
            finite = np.isfinite(dist)
            i, j, dist = i[finite], j[finite], dist[finite]
            order = np.lexsort((y["id"][j], dist, i))
            i, j, dist = i[order], j[order], dist[order]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            for column, values in zip(out, (ids[i[keep]], y["id"][j[keep]], dist[keep])):
                column.append(values)
        return [np.concatenate(c) for c in out]

    def kernel(a, b):
        parts = [of(a, a, True)] if b is None else [of(a, b, False), of(b, a, False)]
        return {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(("id", "nbr", "dist"))}
    return kernel


def _sorted_points(a, b):
    """(order, ids, vectors, cores or None) of one or two blocks, by id."""
    both = a if b is None else {c: np.concatenate([a[c], b[c]]) for c in a}
    order = np.argsort(both["id"], kind="stable")
    return order, both["id"][order], both["v"][order], both["core"][order] if "core" in both else None


def spanning_edges(a, b):
    """Kernel: (lo, hi, w): the minimum spanning tree of a unit's points (ties by (w, lo, hi)).

    With a column ``core`` the weights are mutual reachability distances.
    """
    order, ids, x, core = _sorted_points(a, b)
    every = np.arange(len(ids))
    return _tree(ids, x, core, [(every, every)])


def unit_tree(a, b):
    """Kernel: (lo, hi, w): the tree of a block's own edges, or of the edges between two blocks (ties by (w, lo, hi)).

    Every edge of a group belongs to one unit, and one that is the heaviest
    of a cycle there is the heaviest of a cycle in the group: the trees of
    all units hold the group's tree.
    """
    if b is None:
        return spanning_edges(a, None)
    order, ids, x, core = _sorted_points(a, b)
    first = order < len(a["id"])
    p, q = np.flatnonzero(first), np.flatnonzero(~first)
    return _tree(ids, x, core, [(p, q), (q, p)])


#: Where vectors are null a unit's rows are no points of one space; such units keep the tree of all their rows.
unit_tree.with_nulls = spanning_edges


def _first_of(comp, i, j, d):
    """(comp, i, j, d): the edge of every component that is least by (d, i, j)."""
    order = np.lexsort((j, i, d, comp))
    comp, i, j, d = comp[order], i[order], j[order], d[order]
    first = np.concatenate([[True], comp[1:] != comp[:-1]])[:len(comp)]
    return comp[first], i[first], j[first], d[first]


def _tree(ids, x, core, sides):
    """Minimum spanning tree of the edges from ``p`` to ``q`` of all ``sides`` (positions in id order), in Borůvka's rounds.

    The component with most points takes no edge in a round, as the others
    lead to it; so late rounds compare few points.
    """
    n = len(ids)
    if not np.isfinite(margin(x, x)) or core is not None and not np.isfinite(core).all():
        return _prim(ids, x, core)
    screens, comp, edges = [], np.arange(n), []
    for p, q in sides:
        u, w, slack = halves(x[p], x[q])
        # Twice: the least value and the one it is compared with both have an error.
        screens.append((p, q, u, w, 2 * slack + (0 if core is None else 1e-14 * float((core * core).max())), np.full(len(p), -np.inf)))
    wide = max(s[4] for s in screens)
    half = None if core is None else core * core / 2
    while n > 1 and (comp != comp[0]).any():
        active, single, found = comp != np.bincount(comp).argmax(), not edges, []
        reach = np.full(n, np.inf)  # the least value of each component so far
        for p, q, u, w, slack, floor in screens:
            # What is nearest outside a point's component gets no nearer: its last value rules out points, the nearest first.
            mine = np.flatnonzero(active[p])
            mine = mine[np.argsort(floor[mine], kind="stable")]
            rows = max(1, 4 * HELD // len(q))
            for at in range(0, len(mine), rows):
                some = mine[at:at + rows]
                some = some[floor[some] <= reach[comp[p[some]]] + wide]
                if not len(some):
                    continue
                # The products screen; exact distances are taken for what can be a point's nearest outside its component.
                part = u[some] @ w.T
                if half is not None:
                    part = np.maximum(np.maximum(part, half[p[some]][:, None]), half[q][None, :])
                if not single:
                    np.putmask(part, comp[p[some]][:, None] == comp[q][None, :], np.inf)
                elif p is q:
                    part[np.arange(len(some)), some] = np.inf
                least = part.min(1, keepdims=True)
                floor[some] = least[:, 0]
                np.minimum.at(reach, comp[p[some]], least[:, 0])
                i, j = np.divmod(np.flatnonzero((part <= least + slack) & (part < np.inf)), len(q))
                i, j = p[some][i], q[j]
                d = apart(x, x, i, j)
                if core is not None:
                    d = np.maximum(np.maximum(d, core[i]), core[j])
                found.append(_first_of(comp[i], np.minimum(i, j), np.maximum(i, j), d))
        c, i, j, d = _first_of(*(np.concatenate(column) for column in zip(*found)))
        to = np.where(comp[i] == c, comp[j], comp[i])
        parent = np.arange(n)
        parent[c] = to
        # Only two components that take the same edge point at each other.
        mutual = (parent[to] == c) & (c < to)
        parent[c[mutual]] = c[mutual]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        comp = parent[comp]
        taken = ~mutual
        edges.append((i[taken], j[taken], d[taken]))
    i, j, d = (np.concatenate(column) for column in zip(*edges)) if edges else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
    return {"lo": ids[i], "hi": ids[j], "w": d}


def _prim(ids, x, core):
    """The tree of all points by Prim's rule, for vectors that are not finite."""
    n = len(ids)
    best, source = np.full(n, np.inf), np.zeros(n, np.int64)
    todo = np.ones(n, bool)
    size, slack = (x * x).sum(1), 2 * margin(x, x)
    at, lo, hi, w = 0, [], [], []
    for _ in range(n - 1):
        todo[at] = False
        # The expanded form screens; exact distances are taken for the points that can get nearer.
        near = todo
        if np.isfinite(slack):
            near = todo & (size + size[at] - 2.0 * (x @ x[at]) <= best * best + slack)
        c = np.flatnonzero(near)
        d = np.sqrt(((x[c] - x[at]) ** 2).sum(1))
        if core is not None:
            d = np.maximum(np.maximum(d, core[c]), core[at])
        # Among equal weights the edge with the smaller (lo, hi) stays.
        here_lo, here_hi = np.minimum(at, c), np.maximum(at, c)
        old_lo, old_hi = np.minimum(source[c], c), np.maximum(source[c], c)
        better = c[(d < best[c]) | ((d == best[c]) & ((here_lo < old_lo) | ((here_lo == old_lo) & (here_hi < old_hi))))]
        best[better], source[better] = d[np.searchsorted(c, better)], at
        left = np.flatnonzero(todo)
        light = left[best[left] == best[left].min()]
        ends = np.lexsort((np.maximum(source[light], light), np.minimum(source[light], light)))
        at = int(light[ends[0]])
        lo.append(min(at, source[at]))
        hi.append(max(at, source[at]))
        w.append(best[at])
    return {"lo": ids[np.array(lo, np.int64)], "hi": ids[np.array(hi, np.int64)], "w": np.array(w, float)}


def candidate_share(units: DataFrame, gkeys) -> float:
    """Part of all pairs inside the groups that the units cover."""
    sides = units.groupBy(*gkeys, "ba", "bb").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("x"),
                                                  F.sum("side").alias("y"))
    met = F.when(F.col("ba") == F.col("bb"), F.col("x") * (F.col("x") - 1) / 2).otherwise(F.col("x") * F.col("y"))
    points = units.where("ba = bb").groupBy(*gkeys).agg(F.count(F.lit(1)).alias("n"))
    total = points.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 1.0
    return float((sides.agg(F.sum(met)).first()[0] or 0.0) / total)
