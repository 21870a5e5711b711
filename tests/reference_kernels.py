"""Single-machine references that tests hold the distributed operators against."""

from __future__ import annotations

import numpy as np


def _dist_row(x: np.ndarray, i: int) -> np.ndarray:
    d = x - x[i]
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def core_distances(x: np.ndarray, min_samples: int, block: int = 1024) -> np.ndarray:
    """Distance to the (min_samples - 1)-th nearest other point (the point counts as the first)."""
    n = len(x)
    k = min_samples - 1
    if k <= 0 or n <= 1:
        return np.zeros(n)
    k = min(k, n - 1)
    out = np.empty(n)
    sq = (x * x).sum(1)
    for s in range(0, n, block):
        blk = x[s:s + block]
        d2 = sq[s:s + block, None] + sq[None, :] - 2.0 * blk @ x.T
        rows = np.arange(s, min(s + block, n))
        d2[rows - s, rows] = np.inf
        # candidates by the expanded form, exact distance for the chosen one
        cand = np.argpartition(d2, k - 1, axis=1)[:, :k]
        for r, i in enumerate(rows):
            exact = np.sqrt(((x[cand[r]] - x[i]) ** 2).sum(1))
            out[i] = np.sort(exact)[k - 1]
    return out


def prim_mst(x: np.ndarray, ids: np.ndarray, core: np.ndarray | None = None):
    """Exact Euclidean MST; ties broken by (w, min id, max id). Returns lo, hi, w.

    With ``core`` distances the weights are mutual reachability
    max(core[a], core[b], d(a, b)).
    """
    n = len(x)
    if n < 2:
        return np.array([], dtype=np.int64), np.array([], dtype=np.int64), np.array([], dtype=float)
    in_tree = np.zeros(n, dtype=bool)
    best = np.full(n, np.inf)
    frm = np.full(n, -1, dtype=np.int64)
    in_tree[0] = True
    d = _dist_row(x, 0)
    if core is not None:
        d = np.maximum(np.maximum(d, core), core[0])
    best[:] = d
    frm[:] = 0
    best[0] = np.inf
    lo, hi, w = [], [], []
    for _ in range(n - 1):
        cand = np.flatnonzero(~in_tree)
        m = best[cand].min()
        tied = cand[best[cand] == m]
        if len(tied) > 1:
            a = np.minimum(ids[tied], ids[frm[tied]])
            b = np.maximum(ids[tied], ids[frm[tied]])
            v = tied[np.lexsort((b, a))[0]]
        else:
            v = tied[0]
        u = frm[v]
        lo.append(min(ids[u], ids[v]))
        hi.append(max(ids[u], ids[v]))
        w.append(m)
        in_tree[v] = True
        best[v] = np.inf
        dv = _dist_row(x, v)
        if core is not None:
            dv = np.maximum(np.maximum(dv, core), core[v])
        out = ~in_tree
        better = out & (dv < best)
        tie = out & (dv == best)
        if tie.any():
            t = np.flatnonzero(tie)
            new_pair = (np.minimum(ids[t], ids[v]), np.maximum(ids[t], ids[v]))
            old_pair = (np.minimum(ids[t], ids[frm[t]]), np.maximum(ids[t], ids[frm[t]]))
            smaller = (new_pair[0] < old_pair[0]) | ((new_pair[0] == old_pair[0]) & (new_pair[1] < old_pair[1]))
            better[t[smaller]] = True
        best[better] = dv[better]
        frm[better] = v
    return np.array(lo, dtype=np.int64), np.array(hi, dtype=np.int64), np.array(w, dtype=float)


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parent = np.arange(n)

    def find(i):
        r = i
        while parent[r] != r:
            r = parent[r]
        while parent[i] != r:
            parent[i], i = r, parent[i]
        return r

    for i, j in zip(a, b):
        ri, rj = find(i), find(j)
        if ri != rj:
            if ri < rj:
                parent[rj] = ri
            else:
                parent[ri] = rj
    return np.array([find(i) for i in range(n)])


def dbscan_local(x: np.ndarray, ids: np.ndarray, eps: float, min_samples: int, block: int = 1024):
    """DBSCAN labels (component = smallest core id, -1 noise) and core flags.

    Components of the core graph are those of the core points' MST with
    edges > eps removed (single linkage at eps).
    """
    n = len(x)
    counts = np.zeros(n, dtype=np.int64)
    for s in range(0, n, block):
        blk = x[s:s + block]
        d2 = (blk * blk).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2.0 * blk @ x.T
        dist = np.sqrt(np.maximum(d2, 0.0))
        # exact re-check near the boundary
        near = np.abs(dist - eps) < 1e-9 * max(1.0, eps)
        if near.any():
            r, c = np.nonzero(near)
            exact = np.sqrt(((x[s + r] - x[c]) ** 2).sum(1))
            dist[r, c] = exact
        counts[s:s + block] = (dist <= eps).sum(1)
    core = counts >= min_samples
    comp_label = np.full(n, -1, dtype=np.int64)
    ci = np.flatnonzero(core)
    if len(ci):
        lo, hi, w = prim_mst(x[ci], ids[ci])
        pos = {int(v): k for k, v in enumerate(ids[ci])}
        keep = w <= eps
        a = np.array([pos[int(v)] for v in lo[keep]], dtype=np.int64)
        b = np.array([pos[int(v)] for v in hi[keep]], dtype=np.int64)
        root = _components(len(ci), a, b)
        # component id = smallest core id in the component
        min_id = {}
        for k, r in enumerate(root):
            min_id[r] = min(min_id.get(r, ids[ci[k]]), ids[ci[k]])
        comp_label[ci] = [min_id[r] for r in root]
        # border points: smallest component among core neighbours
        nc = np.flatnonzero(~core)
        xc = x[ci]
        for s in range(0, len(nc), block):
            rows = nc[s:s + block]
            d = np.sqrt(np.maximum((x[rows] ** 2).sum(1)[:, None] + (xc ** 2).sum(1)[None, :]
                                   - 2.0 * x[rows] @ xc.T, 0.0))
            near = np.abs(d - eps) < 1e-9 * max(1.0, eps)
            if near.any():
                r, c = np.nonzero(near)
                d[r, c] = np.sqrt(((x[rows[r]] - xc[c]) ** 2).sum(1))
            within = d <= eps
            labs = np.where(within, comp_label[ci][None, :], np.iinfo(np.int64).max)
            m = labs.min(1)
            has = within.any(1)
            comp_label[rows[has]] = m[has]
    return comp_label, core


def knn_local(x: np.ndarray, ids: np.ndarray, k: int, block: int = 1024, margin: int = 8):
    """Exact k nearest neighbours (self excluded), ties by neighbour id.

    Candidates come from the expanded-square distances, then the exact
    distances of the top k + margin candidates decide the order.
    Returns arrays (id, nbr, dist, rank).
    """
    n = len(x)
    kk = min(k, n - 1)
    if kk <= 0:
        e = np.array([], dtype=np.int64)
        return e, e, np.array([], dtype=float), e
    sq = (x * x).sum(1)
    out_id, out_nbr, out_d, out_r = [], [], [], []
    c = min(n - 1, kk + margin)
    for s in range(0, n, block):
        blk = x[s:s + block]
        d2 = sq[s:s + block, None] + sq[None, :] - 2.0 * blk @ x.T
        rows = np.arange(s, min(s + block, n))
        d2[rows - s, rows] = np.inf
        cand = np.argpartition(d2, c - 1, axis=1)[:, :c] if c < n else np.argsort(d2, axis=1)[:, :c]
        for r, i in enumerate(rows):
            js = cand[r][cand[r] != i]
            exact = np.sqrt(((x[js] - x[i]) ** 2).sum(1))
            order = np.lexsort((ids[js], exact))[:kk]
            out_id.extend([ids[i]] * len(order))
            out_nbr.extend(ids[js][order])
            out_d.extend(exact[order])
            out_r.extend(range(1, len(order) + 1))
    return (np.array(out_id, dtype=np.int64), np.array(out_nbr, dtype=np.int64),
            np.array(out_d, dtype=float), np.array(out_r, dtype=np.int64))


def leaf_labels(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, w: np.ndarray,
                min_cluster_size: int = 5, eps: float = 0.0) -> dict:
    """Leaf clusters of the single-linkage hierarchy (min_samples = 1).

    Bottom-up over the edges in (w, lo, hi) order with union-find: when two
    components of at least ``min_cluster_size`` meet, each one without an
    earlier split becomes a leaf cluster; a small component meeting a split
    one is noise; otherwise components merge.  Returns {id: leaf number}.

    ``eps`` (cluster selection epsilon): a true split below ``eps`` merges
    without marking a split, so leaves born below ``eps`` are replaced by
    their first ancestor born at or above it; when every true split of the
    group is below ``eps``, the two sides of the last one (the children of
    the root) are the clusters.
    """
    order = np.lexsort((hi, lo, w))
    parent = {int(i): int(i) for i in ids}
    size = {int(i): 1 for i in ids}
    split = {int(i): False for i in ids}
    members = {int(i): [int(i)] for i in ids}
    labels: dict = {}
    n_leaf = 0
    last_ignored = None
    normal_split = False

    def find(x):
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for k in order:
        a, b = find(int(lo[k])), find(int(hi[k]))
        if a == b:
            continue
        big_a, big_b = size[a] >= min_cluster_size, size[b] >= min_cluster_size
        if big_a and big_b and w[k] < eps:
            last_ignored = (list(members[a]), list(members[b]))
            merged_members = members[a] + members[b]
            new_split = False
        elif big_a and big_b:
            normal_split = True
            for r in (a, b):
                if not split[r]:
                    for m in members[r]:
                        labels[m] = n_leaf
                    n_leaf += 1
            merged_members: list = []
            new_split = True
        elif big_a or big_b:
            big, small = (a, b) if big_a else (b, a)
            if split[big]:
                merged_members = []  # the small side is noise
            else:
                merged_members = members[big] + members[small]
            new_split = split[big]
        else:
            merged_members = members[a] + members[b]
            new_split = False
        if size[a] < size[b]:
            a, b = b, a
        parent[b] = a
        size[a] += size[b]
        split[a] = new_split
        members[a] = merged_members
        members[b] = []
    if not normal_split and last_ignored is not None:
        for side in last_ignored:
            for m in side:
                labels[m] = n_leaf
            n_leaf += 1
    return labels


def _chunk_ids(tokens, budget: int) -> list[int]:
    """Greedy packing in order: a new chunk opens when the running total would
    pass the budget; an item over the budget sits alone; no empty chunk (Q1)."""
    out, chunk, used = [], 0, 0
    for t in tokens:
        if used > 0 and used + t > budget:
            chunk += 1
            used = 0
        used += t
        out.append(chunk)
    return out
