import random
from collections import deque

import pytest

from siltstone.operators import cycles


def brute(arcs):
    """Component of each node on a cycle, by who reaches whom; and the length of the shortest cycle through its smallest node."""
    on = {}
    for a, b in arcs:
        if a != b:
            on.setdefault(a, set()).add(b)

    def reach(start):
        far, todo = {}, deque([(start, 0)])
        while todo:
            x, d = todo.popleft()
            for y in on.get(x, ()):
                if y not in far:
                    far[y] = d + 1
                    todo.append((y, d + 1))
        return far

    reached = {a: reach(a) for a in on}
    component = {a: min(b for b in reached[a] if b in reached and a in reached[b]) for a in on if a in reached[a]}
    return component, {c: reached[c][c] for c in set(component.values())}, on


def check(spark, arcs, small):
    want, lengths, on = brute(arcs)
    df = spark.createDataFrame(arcs or [(1, 1)], "src long, dst long")
    members = cycles.components(df, small=small)
    rows = members.collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == want
    paths = {}
    for r in cycles.shortest(df, members, small=small).collect():
        paths.setdefault(r.component, {})[r.position] = r.node
    assert {c: len(p) for c, p in paths.items()} == lengths
    for c, p in paths.items():
        way = [p[i] for i in range(len(p))]
        assert way[0] == c and all(b in on[a] for a, b in zip(way, way[1:] + [c], strict=True))
    return paths


@pytest.mark.parametrize("small", [0, 6, cycles.SMALL])
def test_random_graphs(spark, small):
    rng = random.Random(small)
    arcs = [(100 * g + rng.randrange(14), 100 * g + rng.randrange(14)) for g in range(12) for _ in range(6 + 2 * g)]
    arcs += [(5000 + i, 5000 + (i + 1) % 9) for i in range(9)] + [(5003, 6000), (6000, 6001), (4999, 5000)]
    arcs += [(7000 + i, 7000 + i + 1) for i in range(20)]  # a chain without a cycle
    check(spark, sorted(set(arcs)), small)


def test_dense_core_is_coloured(spark):
    """Nothing to trim or fold: two cliques of which one reaches the other."""
    arcs = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(base, base + 4) if a != b] + [(1, 11), (2, 12), (3, 10)]
    check(spark, arcs, 0)


def test_long_ring_takes_few_rounds(spark, monkeypatch):
    turns = []
    plain = cycles._chosen
    monkeypatch.setattr(cycles, "_chosen", lambda *a: turns.append(1) or plain(*a))
    n = 500
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    arcs = [(ids[i], ids[(i + 1) % n]) for i in range(n)]
    path = check(spark, arcs, 2)[0]
    assert len(path) == n and len(turns) < 60


def test_ring_of_100_000_nodes(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")
    members = cycles.components(df)
    assert members.filter("component = 0").count() == n
    assert cycles.shortest(df, members).selectExpr("count(*) AS n", "sum(int(node = position)) AS ok").first() == (n, n)


def test_nothing_and_loops(spark):
    assert check(spark, [], 0) == {} and check(spark, [(1, 1), (1, 2)], 0) == {}
