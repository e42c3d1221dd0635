import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import ngram_join as J
from siltstone.llm import queries
from tests.conftest import SF_DIR


def shingles(text):
    lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False))


def brute_force(texts):
    """(n_shingles, component) of each (id, text), every pair compared."""
    sets = {i: shingles(t) for i, t in texts}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = {}
    for i, s in sets.items():
        near = {}
        for x in s:
            for j in holders.setdefault(x, []):
                near[j] = near.get(j, 0) + 1
            holders[x].append(i)
        for j, both in near.items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both) and (a := find(i)) != (b := find(j)):
                top[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_whole_table(spark, duck):
    texts = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.queries()["op4_parity_sketch_join"](spark, SF_DIR).collect()}
    assert got == brute_force(texts)


def test_crowded_buckets(spark, monkeypatch):
    """Near copies of one text whose smallest is no good leader, and a passage that many texts share."""
    monkeypatch.setattr(J, "SMALL_BUCKET", 4)
    monkeypatch.setattr(J, "LOCAL_STAR", 8)
    monkeypatch.setattr(J, "BLOCK", 16)
    rng = random.Random(5)
    texts = []
    for _ in range(80):
        w = [f"w{i}" for i in range(120)]
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([f"p{k}" for k in range(50)] + [f"y{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    texts += [texts[3]] * 10
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_force(rows)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=200), st.sets(st.integers(0, 2**64 - 1), max_size=60))
def test_hamming_is_a_lower_bound(a, changed):
    one, two = np.array(sorted(a), np.uint64), np.array(sorted(a ^ changed | {1}), np.uint64)
    assert J.hamming(J.sketch_of(one), J.sketch_of(two)) <= len(set(one.tolist()) ^ set(two.tolist()))


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 400), st.randoms(use_true_random=False))
def test_linked_sets_share_a_token(n, rng):
    a = {rng.getrandbits(64) for _ in range(n)}
    d = rng.randint(0, n // 8)
    b = set(list(a)[d:]) | {rng.getrandbits(64) for _ in range(d)}
    x, y = np.array(sorted(a), np.uint64), np.array(sorted(b), np.uint64)
    if J.linked(x, y):
        assert set(J.tokens_of(x).tolist()) & set(J.tokens_of(y).tolist())


def test_awkward_rows(awkward, nothing):
    got = {r.doc_id: r for r in J.classes(awkward).collect()}
    want = brute_force([(r.doc_id, r.text) for r in awkward.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect()])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items() if i is not None} == want
    assert got[0].component_id == 0 and got[0].n_shingles == 0 and got[7].component_id == 6 and got[None].component_id is None
    assert J.classes(nothing).count() == 0
    kept = [r.doc_id for r in J.one_of_each(awkward).collect()]
    assert sorted(i for i in kept if i is not None) == sorted(i for i, (_, c) in want.items() if i == c)


@pytest.mark.parametrize("length", [300, 2500])
def test_chains_of_revisions(spark, length):
    """Each text links only with the one before and the one after, out of order of their ids."""
    rng = random.Random(length)
    words, texts = [f"w{i}" for i in range(84)], []
    for i in range(length):
        at = (i * 11) % 84
        words[at] = f"r{i}"
        words[(at + 1) % 84] = f"s{i}"
        texts.append(" ".join(words))
    ids = list(range(length))
    rng.shuffle(ids)
    pairs = list(zip(ids, texts, strict=True))
    want = brute_force(pairs)
    assert len({c for _, c in want.values()}) == 1
    got = J.classes(spark.createDataFrame(pairs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
