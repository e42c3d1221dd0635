import random

import pytest

from siltstone.llm import components as c


def brute(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for k in sorted(near):
        if k not in root:
            stack = [k]
            while stack:
                x = stack.pop()
                if x not in root:
                    root[x] = k
                    stack += near[x]
    return root


def found(spark, pairs, small):
    rows = c.components(spark.createDataFrame(pairs, "a long, b long"), small=small).collect()
    assert len(rows) == len({r.key for r in rows})
    return {r.key: r.root for r in rows}


@pytest.mark.parametrize("small", [0, 40, c.SMALL])
def test_against_brute_force(spark, small):
    rng = random.Random(5)
    pairs = [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(500)] + [(7000, i) for i in range(7001, 7200)] + [(9000, 9000), (3, 3), (1, 2), (2, 1)]
    assert found(spark, pairs, small) == brute(pairs)


@pytest.mark.parametrize("length", [300, 5000])
def test_chains_of_any_length_settle(spark, length, monkeypatch):
    """Rounds grow with the logarithm of a chain, in order or out of it, and no limit ends them."""
    rounds = []
    moved = c._moved
    monkeypatch.setattr(c, "_moved", lambda edges, turn: rounds.append(turn) or moved(edges, turn))
    ids = list(range(length))
    random.Random(1).shuffle(ids)
    assert set(found(spark, list(zip(ids, ids[1:], strict=False)), 0).values()) == {0}
    assert len(rounds) <= 2 * length.bit_length()


def test_nothing(spark):
    assert found(spark, [], 0) == {} and found(spark, [(None, 1), (2, None)], 0) == {}
