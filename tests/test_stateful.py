"""Streams that come in many files, out of order: the same states as a fold of all events in order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siltstone.streaming import events as E
from siltstone.streaming import stateful as W

SCHEMA = "event_id long, ts timestamp, k string, op string, seconds long, failed boolean"
START = dt.datetime(2024, 1, 1)


def made(seed=3, n=240):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = START + dt.timedelta(minutes=i + rng.randrange(40))  # up to 40 minutes late
        rows.append((i, at, rng.choice("abc"), rng.choice(["set", "get", "get", "delete"]), rng.choice([60, 600, 7200]), rng.random() < 0.6))
    return rows


def folded(rows, fold, what):
    states = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        at = int((r[1] - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
        states[r[2]] = fold.step(states.get(r[2], fold.start()), at, r[0], what(r))
    newest = max(r[1] for r in rows)
    now = int((newest - dt.timedelta(hours=1) - dt.datetime(1970, 1, 1)).total_seconds() * 1000) * 1000
    return {k: fold.view(s, now) for k, s in states.items()}


KINDS = {
    "cache": (W.Cache(), lambda: [F.col("op"), F.col("seconds")], lambda r: [r[3], r[4]]),
    "breaker": (W.Breaker(trip=2, rest=900), lambda: [F.col("failed")], lambda r: [r[5]]),
    "newest": (W.Newest(5), lambda: [F.lit(True)], lambda r: [True]),
}


@pytest.mark.parametrize("kind", KINDS)
def test_same_as_a_fold_in_order(spark, tmp_path, kind):
    rows = made()
    for i in range(0, len(rows), 60):
        spark.createDataFrame(rows[i : i + 60], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/part{i // 60:03}")
    fold, what, plain = KINDS[kind]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    found = W.newest(E.run_available(W.folded(stream, "k", fold, what()), "update", ["k", "version"]), "k").collect()
    want = folded(rows, fold, plain)
    assert {r.k: tuple(list(x) if isinstance(x, list) else x for x in r[1:]) for r in found} == want


def test_many_keys_share_a_group(spark, tmp_path, monkeypatch):
    """Keys of a bucket keep to themselves, null and large ones too, and a group of rows is handed over for each bucket, not for each key."""
    monkeypatch.setattr(W, "BUCKETS", 2)
    groups = spark.sparkContext.accumulator(0)
    inner = W.in_order

    def counted(fold, columns):
        run = inner(fold, columns)

        def once(*args):
            groups.add(1)
            return run(*args)

        return once

    monkeypatch.setattr(W, "in_order", counted)
    keys = [None, 0, 2**60 + 1, *range(7, 100)]
    rows = [(i, START + dt.timedelta(seconds=i), keys[i % len(keys)]) for i in range(4 * len(keys))]
    spark.createDataFrame(rows, "event_id long, ts timestamp, k long").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, k long").parquet(f"{tmp_path}/in")
    found = W.newest(E.run_available(W.folded(stream, "k", W.Newest(2), [F.lit(True)]), "update", ["k", "version"]), "k").collect()
    assert {r.k: r.newest for r in found} == {k: [i + 3 * len(keys), i + 2 * len(keys)] for i, k in enumerate(keys)}
    assert groups.value <= 4  # two buckets, in the batch of rows and in one of timers


def test_breaker_lets_a_trial_through():
    b = W.Breaker(trip=2, rest=10)
    s, seen = b.start(), []
    for second, failed in ((0, True), (1, True), (5, False), (11, True), (12, False), (22, False), (23, True)):
        s = b.step(s, second * 1_000_000, 0, [failed])
        seen.append(b.view(s, second * 1_000_000)[0])
    assert seen == ["CLOSED", "OPEN", "OPEN", "OPEN", "OPEN", "CLOSED", "CLOSED"]
    assert b.view({**s, "open": True, "last": 0}, 10_000_000)[0] == "HALF_OPEN" and (s["trips"], s["refused"]) == (2, 2)
