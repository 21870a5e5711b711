"""Operator 9 against brute force, and the registered queries against DuckDB."""
import math

import numpy as np
import pytest

import __spark_entry__ as E
from critica.llm import bit_sliced
from critica.llm import catalog
from tests.oracle_util import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(12))
def test_block_top_is_exact(seed):
    rng = np.random.default_rng(seed)
    n, dims = int(rng.integers(1, 300)), int(rng.integers(1, 20))
    v = rng.integers(-200, 200, (n, dims))
    if seed % 3 == 0:
        v[rng.random(n) < 0.5] = v[0]
    ids = rng.permutation(n)
    block = bit_sliced.Block(v, int(rng.integers(1, 10)))
    for q in v[:8]:
        rows, scores = block.top(q, ids, 5, int(ids[0]))
        want = [i for i in np.lexsort((ids, -(v @ q))) if ids[i] != ids[0]][:5]
        assert rows.tolist() == want and scores.tolist() == (v @ q)[want].tolist()


def test_slices_add_up_to_the_score():
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (130, 6))
    block = bit_sliced.Block(v, 7)
    q = rng.integers(-9, 9, 6)
    slices, base = block.upper_scores(q)
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(int) << j for j, s in enumerate(slices)))
    assert block.cut == 0 and np.array_equal(total + base + block.low @ q, v @ q)


def test_top_k_with_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist(), "x", 1) for i in range(120)]
    same = rng.normal(size=8).tolist()
    rows += [(200 + i, same, "x", 1) for i in range(40)] + [(400, None, "x", 1), (450, [1.0, None] + [0.0] * 6, "x", 1),
             (500, [float("nan")] * 8, "x", 1), (550, [float("inf")] * 8, "x", 1), (600, [], "x", 1), (None, same, "x", 1), (650, [1e30] * 8, "x", 1), (651, [-1e308] * 8, "x", 1), (652, [1e7] + [0.5] * 7, "x", 1),
             (700, [-1e7, 2e7] + [1.0] * 6, "x", 1), (750, [1e12, -1e12] + [0.25] * 6, "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int")
    got = {}
    for r in bit_sliced.top_k(df.where("vec_id % 50 = 0"), df, 5, cells=256, chunk_cells=16, chunks=2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    usable = {i: [math.floor(256 * x) if abs(x) < 1e300 else 256 * int(x) for x in e] for i, e, _, _ in rows
              if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    for q in (i for i in usable if i % 50 == 0):
        def score(b):
            return max(-2 ** 63, min(2 ** 63 - 1, sum(x * y for x, y in zip(usable[q], b))))
        want = sorted(((-score(b), i) for i, b in usable.items() if i != q))[:5]
        assert [got[q][k] for k in sorted(got[q])] == [(i, -s) for s, i in want]
    assert set(got) == {i for i in usable if i % 50 == 0}
    assert bit_sliced.top_k(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_oracle(spark, name):
    problems, n = compare(catalog.QUERIES[name](spark, SF), duck(SF), catalog.ORACLE[name])
    assert not problems and n, problems


@pytest.mark.parametrize("name", ["op3_line_templates", "op4_url_trees", "op8_quality_rules", "op12_prefix_target_chat"])
def test_native_plans_hold_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin") if w in plan]


def test_fourteen_queries_are_registered():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
