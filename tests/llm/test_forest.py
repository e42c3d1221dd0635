import math

import numpy as np
import pytest

from siltstone.llm import forest


def brute(rows, least=0.95):
    """vec_id -> (links, smallest id reachable), by comparing all pairs."""
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    near = {i: set() for i, _ in rows}
    for p, (i, a) in enumerate(good):
        for j, b in good[:p]:
            if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                near[i].add(j)
                near[j].add(i)
    out = {}
    for i in sorted(near):
        stack, seen = [i], {i}
        while stack:
            for j in near[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = (len(near[i]), min(seen))
    return out


def found(spark, rows, **more):
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, k1 string, key int, bits int"), **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    return {r.vec_id: (r.n_links, r.component_id) for r in got}


def near(rng, v, cosine):
    other = rng.standard_normal(len(v))
    other -= other @ v * v
    other /= np.linalg.norm(other)
    return cosine * v + math.sqrt(1 - cosine * cosine) * other


def planted(seed=4, n=900, d=24):
    rng = np.random.default_rng(seed)
    unit = lambda: (x := rng.standard_normal(d)) / np.linalg.norm(x)
    vectors = [unit() for _ in range(n)]
    vectors += [near(rng, vectors[i], c) for i in range(0, n, 10) for c in (0.94, 0.951, 0.96, 0.99)]
    vectors += [vectors[7]] * 300 + [2 * vectors[8]] * 40 + [near(rng, vectors[9], 0.985) for _ in range(250)]
    step = vectors[11]
    for _ in range(30):  # a chain: each links with its neighbours alone
        step = near(rng, step, 0.955)
        vectors.append(step)
    return [(i, [float(c) for c in v], "a", 1, 2) for i, v in enumerate(vectors)]


def test_equals_brute_force_through_rounds_and_blocks(spark, monkeypatch):
    """Small limits, so that rows are routed in several rounds and components are counted block against block."""
    monkeypatch.setattr(forest, "TASK_ROWS", 300)
    monkeypatch.setattr(forest, "LEVELS", 2)
    monkeypatch.setattr(forest, "LEAF", 60)
    monkeypatch.setattr(forest, "BLOCK", 64)
    monkeypatch.setattr(forest, "TREES", 12)
    rows = planted()
    want, got = brute([r[:2] for r in rows]), found(spark, rows)
    assert set(got) == set(want)
    assert sum(got[i] == want[i] for i in want) >= 0.99 * len(want)
    assert all(got[i][0] <= want[i][0] for i in want)  # no link below the bound
    assert got[7] == want[7] and got[8] == want[8] and got[9] == want[9]


def test_recall_with_production_parameters(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[4500:6500] = [near(rng, v, c) for v, c in zip(x[:2000], np.linspace(0.9501, 0.99, 2000), strict=True)]
    got = found(spark, [(i, v.tolist(), "", 0, 0) for i, v in enumerate(x)])
    assert sum(got[4500 + i][0] >= 1 and got[4500 + i][1] == i for i in range(2000)) >= 0.99 * 2000


def test_awkward_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -2.0, 1.0]
    rows = [(0, None), (1, []), (2, [0.0, 0.0, 0.0]), (3, [1.0, None, 2.0]), (4, [1.0, math.nan, 2.0]), (5, [math.inf, 1.0, 1.0]), (6, v), (7, v), (8, [1e-200, 2e-200, 3e-200]), (9, [1e200, 2e200, 3e200]), (10, w), (11, [1.0, 2.0]), (12, [1.0, 2.0])]
    assert found(spark, [(*r, "x", 1, 1) for r in rows]) == {i: (3, 6) if i in (6, 7, 8, 9) else (1, 11) if i > 10 else (0, i) for i in range(13)}
    assert found(spark, []) == {}
    again = forest.near_duplicates(spark.createDataFrame([(5, v), (5, v), (None, v), (None, w)], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id, r.kept) for r in again if r.n_links) == [(-1, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True)]
    assert [(r.vec_id, r.component_id, r.kept) for r in again if not r.n_links] == [(None, None, False)]


@pytest.mark.parametrize("rows", [0, 1, 2, 385])
def test_leaves_hold_every_row(rows):
    x = np.random.default_rng(1).standard_normal((rows, 5))
    assert set(np.concatenate([*forest.leaves(x, np.arange(rows), 0, 0), np.zeros(0, int)]).tolist()) == set(range(rows))
