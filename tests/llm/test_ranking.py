import math
import random
import re
from collections import Counter

import pytest

from siltstone.llm import queries, ranking
from tests.conftest import same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=20):
    cut = lambda t: TERM.findall((t or "").translate(UPPER))
    words = [(i, Counter(cut(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in words), sum(c.total() for _, c in words)
    df = Counter(t for _, c in words for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in words:
            m = 75 + 25 * c.total() * n // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in cut(text) if c[t])
            scored += [(-s, i is None, i)] * (s > 0)
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def found(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, ids string, score long")
    items = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, term string, rank long")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in ranking.search(docs, items, **more).collect()), key=str)


def test_query_equals_its_sql(spark, duck):
    same(spark, duck, queries.queries()["op12_impact_ordered"], queries.OP12_SQL)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """Once with small shards, helpings and blocks of items, so that searches stop early and documents are completed."""
    if small:
        for name, value in (("SHARD_DOCS", 150), ("FIRST_HELPING", 4), ("ITEMS_A_BLOCK", 9)):
            monkeypatch.setattr(ranking, name, value)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(vocabulary[min(int(rng.paretovariate(0.5)) - 1, 399)] for _ in range(n))
    docs = [(i, text(rng.randrange(120))) for i in range(700)]
    docs += [(5000 + i, docs[3][1]) for i in range(60)]
    items = [(i, text(rng.randrange(1, 15))) for i in range(25)] + [(90, docs[3][1])]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_searches_stop_early_with_whole_scores():
    import numpy as np

    rng = np.random.default_rng(3)
    docs, vocabulary = 20_000, 12
    tf = np.where(rng.random((docs, vocabulary)) < 0.6, rng.integers(1, 9, (docs, vocabulary)), 0)
    tf[rng.choice(docs, 40, replace=False), 0] = 500
    tf[:, 0] *= tf[:, 0] > 8
    doc, term = np.nonzero(tf)
    row = {"ids": np.arange(docs).tobytes(), "lengths": tf.sum(1).tobytes(), "upto": np.cumsum((tf > 0).sum(1)).tobytes(), "term": term.astype(np.int32).tobytes(), "tf": tf[doc, term].astype(np.int32).tobytes()}
    weights = np.array([6000, *range(1, vocabulary)])
    shard = ranking.Shard(row, weights, docs, int(tf.sum()))
    whole = np.zeros(docs, np.int64)
    np.add.at(whole, doc, shard.impact)
    completed = []
    plain = shard.completed
    shard.completed = lambda d, t: completed.append(len(d)) or plain(d, t)
    ids, scores = shard.best(np.arange(vocabulary), np.ones(vocabulary, np.int64), np.ones(vocabulary, np.int64), 20, 0)
    first = np.lexsort((np.arange(docs), -whole))[:20]
    assert ids.tolist() == first.tolist() and scores.tolist() == whole[first].tolist()
    assert completed and completed[0] <= 320


def test_awkward_rows(spark, awkward, nothing):
    docs = [(r.doc_id, r.text) for r in awkward.collect()]
    items = [(1, "the idiot of alpha"), (2, None), (3, ""), (None, "naïve 日本語 CAFÉ café"), (4, "XXX the the"), (4, "XXX the the"), (5, "no id at all"), (6, "unknownterm")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, docs, [(1, "!")]) == []
