"""Block kernels against the plain formulas, and the rows that are moved for them."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from critica.operators import blocks as B
from critica.operators import ward as W


def _sides(kind):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 8))
    if kind == "copies":
        x = np.round(x[rng.integers(0, 20, 150)], 1)
    if kind == "tiny":
        x *= 1e-6
    if kind == "far":
        x += 1e5
    if kind == "broken":
        x[3], x[120, 2] = np.nan, np.inf
    ids = rng.permutation(150).astype(np.int64)
    a, b = ({"id": ids[s], "v": x[s], "n": 1 + ids[s] % 3, "core": np.abs(x[s, 0])} for s in (slice(0, 90), slice(90, 150)))
    return a, b


def _plain(x, y, same):
    d = np.sqrt(((x["v"][:, None, :] - y["v"][None]) ** 2).sum(2))
    if same:
        np.fill_diagonal(d, np.inf)
    return d


@pytest.mark.parametrize("kind", ["plain", "copies", "tiny", "far", "broken"])
@pytest.mark.parametrize("held", [1 << 20, 4096])
def test_screened_kernels_give_the_plain_results(kind, held, monkeypatch):
    monkeypatch.setattr(B, "HELD", held)
    a, b = _sides(kind)
    with np.errstate(all="ignore"):
        for x, y in ((a, None), (a, b)):
            sides = [(x, x, True)] if y is None else [(x, y, False), (y, x, False)]
            knn, ward = set(), set()
            for p, q, same in sides:
                d = _plain(p, q, same)
                for i, row in enumerate(d):
                    order = [j for j in np.lexsort((q["id"], row))[:3] if np.isfinite(row[j])]
                    knn |= {(int(p["id"][i]), int(q["id"][j]), float(row[j])) for j in order}
                cost = W.merge_cost(p["n"][:, None].astype(float), q["n"][None, :].astype(float),
                                    ((p["v"][:, None, :] - q["v"][None]) ** 2).sum(2))
                if same:
                    np.fill_diagonal(cost, np.inf)
                for i, row in enumerate(cost):
                    least = row.min()
                    if np.isfinite(least):
                        at = min(np.flatnonzero(row == least), key=lambda j: (W.pair_hash(p["id"][i], q["id"][j])[0], q["id"][j]))
                        ward.add((int(p["id"][i]), float(least), int(q["id"][at])))
            got = B.nearest(3)(x, y)
            assert set(zip(got["id"].tolist(), got["nbr"].tolist(), got["dist"].tolist())) == knn
            got = W._nearest(x, y)
            assert set(zip(got["id"].tolist(), got["cost"].tolist(), got["nbr"].tolist())) == ward
            if kind != "broken":
                pairs = B.pairs_within(float(np.median(_plain(x, x, True))))(x, y)
                d, eps = _plain(*sides[0]), float(np.median(_plain(x, x, True)))
                want = {tuple(sorted((int(sides[0][0]["id"][i]), int(sides[0][1]["id"][j])))) for i, j in zip(*np.nonzero(d <= eps))}
                assert set(zip(pairs["lo"].tolist(), pairs["hi"].tolist())) == want


@pytest.mark.parametrize("kind", ["plain", "copies", "tiny", "far"])
@pytest.mark.parametrize("core", [False, True])
def test_screened_spanning_tree_is_the_tree(kind, core):
    a, b = _sides(kind)
    if not core:
        a, b = ({c: v for c, v in s.items() if c != "core"} for s in (a, b))
    got = B.spanning_edges(a, b)
    both = {c: np.concatenate([a[c], b[c]]) for c in a}
    order = np.argsort(both["id"])
    ids, x = both["id"][order], both["v"][order]
    d = np.sqrt(((x[:, None, :] - x[None]) ** 2).sum(2))
    if core:
        d = np.maximum(np.maximum(d, both["core"][order][:, None]), both["core"][order][None, :])
    top = {int(i): int(i) for i in ids}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    want = set()
    for w, i, j in sorted((float(d[i, j]), int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i + 1, len(ids))):
        if (u := root(i)) != (v := root(j)):
            top[u] = v
            want.add((i, j, w))
    assert set(zip(got["lo"].tolist(), got["hi"].tolist(), got["w"].tolist())) == want


def test_a_point_goes_to_few_units(spark):
    pts = spark.range(20_000).select(F.lit("g").alias("g"), "id", F.array(*[
        (F.pmod(F.xxhash64("id", F.lit(c)), F.lit(1000)) / 1000.0) for c in range(2)]).alias("v"))
    assert B.block_units(pts, ["g"]).count() <= 20 * 20_000
