import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import mining, queries
from tests.conftest import SF_DIR, same

SCHEMA = "vec_id long, label int, embedding array<double>, id string, block int"


def brute(rows, every=3, k=5, low=80, scale=256):
    good = [(i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for p, (i, lab, v) in enumerate(good):
        if i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for q, (j, m, w) in enumerate(good) if q != p]
        for s, j, _ in sorted(x for x in scored if x[2] == lab)[:k]:
            inside = sorted(x for x in scored if x[2] != lab and low * -s <= 100 * -x[0] <= 100 * -s)
            out += [(i, j, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(inside[:k])]
    return sorted(out)


def found(spark, rows, every=3):
    got = mining.hard_negatives(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), F.col("vec_id") % every == 0)
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got.collect())


def test_query_equals_its_sql(spark, duck):
    same(spark, duck, queries.queries()["op13_summa_negatives"], queries.OP13_SQL)


@pytest.mark.parametrize("size", [None, 7])
def test_equals_brute_force(spark, monkeypatch, size):
    """Once with small blocks, chunks and cells, so that tiles of several chunks from several cells meet."""
    if size:
        for name in ("ROW_BLOCK", "ANCHOR_BLOCK", "CHUNK", "CELL_ROWS", "CELL_ANCHORS"):
            monkeypatch.setattr(mining, name, size)
    rng = random.Random(6)
    rows = [(i * 2 - 40, rng.randrange(3), [rng.gauss(0.3, 1) for _ in range(16)]) for i in range(120)]
    rows += [(1000 + i, i % 2, rows[0][2]) for i in range(40)]  # copies: ties by id
    assert found(spark, rows) == brute(rows) and len(brute(rows)) > 300


def test_awkward_rows(spark):
    v = [0.5, 0.25]
    rows = [(0, 1, v), (3, 1, v), (3, 1, v), (6, None, v), (None, 1, v), (9, 2, None), (12, 2, [0.5, None]), (15, 2, [math.nan, 1.0]), (18, 2, [math.inf, 1.0]), (21, 2, [0.5]), (24, 2, [0.5, 0.2, 9.0]), (27, 2, []), (30, 3, [-1.0, -1.0]), (33, 3, [-0.5, -1.0])]
    assert found(spark, rows) == brute(rows) != []
    assert found(spark, []) == [] and found(spark, [(1, 1, v)]) == [] and found(spark, [(3, 1, [])]) == []


def test_large_numbers_are_exact(spark):
    rows = [(i, i % 2, [2.0**20 + i, 3.0 + i]) for i in range(9)]
    assert found(spark, rows) == brute(rows) != []
