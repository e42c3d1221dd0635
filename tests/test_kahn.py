import random
from collections import deque

import pytest

from siltstone.operators import graph
from siltstone.operators.places import places


def brute(nodes, arcs):
    """By the words: a queue, children by id, what is left by id."""
    out = set()
    for g in {g for g, _ in nodes}:
        ids = sorted({n for h, n in nodes if h == g})
        sources = {n: {a for h, a, b in arcs if h == g and b == n and a != n and a in ids} for n in ids}
        left = {n: len(s) for n, s in sources.items()}
        queue, order = deque(n for n in ids if not left[n]), []
        while queue:
            order.append(n := queue.popleft())
            for child in sorted(c for c in ids if n in sources[c]):
                left[child] -= 1
                if not left[child]:
                    queue.append(child)
        out |= {(g, n, i, i < len(order)) for i, n in enumerate(order + [n for n in ids if n not in order])}
    return out


@pytest.mark.parametrize("small", [graph.SMALL, 60, 0])
def test_order_of_the_queue(spark, small):
    """Many small graphs to a task, and level by level: the same places."""
    rng = random.Random(1)
    nodes, arcs = [], []
    for g in range(12):
        ids = rng.sample(range(60), 5 + 3 * g)
        nodes += [(g, n) for n in ids] + [(g, ids[0])]
        for _ in range(3 * len(ids)):
            a, b = rng.choice(ids), rng.choice([*ids, 99])
            arcs.append((g, min(a, b), max(a, b)) if g % 3 else (g, a, b))
    rows = graph.kahn(spark.createDataFrame(nodes, "graph int, node long"), spark.createDataFrame(arcs, "graph int, src long, dst long"), small=small).collect()
    assert {tuple(r) for r in rows} == brute(nodes, arcs) and len(rows) == len(set(nodes))


def test_no_nodes(spark):
    assert graph.kahn(spark.createDataFrame([], "graph int, node long"), spark.createDataFrame([(1, 1, 2)], "graph int, src long, dst long")).count() == 0


def test_places_of_one_large_group(spark):
    rows = spark.range(5000).selectExpr("if(id % 3 = 0, id, 1) AS g", "(id * 7919) % 5000 AS v").selectExpr("if(g = 1, 1, 2) AS g", "v")
    got = places(rows, ["g"], ["v"]).collect()
    for g in (1, 2):
        assert [r.place for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == list(range(sum(r.g == g for r in got)))
