"""Logs as streams with state and timers: a cache, a circuit breaker, the newest events of each key.

Events of a key are folded in order of event time, whatever order they come in. Those that the watermark has passed are settled: folded for good, so that
the state of a key is a few numbers. Younger ones wait, and each result is that of the settled state with the waiting events
on top. So a late event within the watermark changes results as if it had come in time; one behind the watermark is dropped.
What changes by the mere passing of time (an entry expires, an open breaker lets a trial through) is told by an event-time timer.

Every result has a ``version``, which grows by one with each change of its key; the newest is a key's present state.
"""

from __future__ import annotations

import copy
import json
import pickle
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Fold:
    """What a kind of log does with its events. States are plain values that JSON can hold; times are microseconds."""

    fields = ""  # of the results

    def start(self) -> Any:
        raise NotImplementedError

    def step(self, state: Any, at: int, event_id: int, what: list) -> Any:
        raise NotImplementedError

    def view(self, state: Any, now: int) -> tuple:
        raise NotImplementedError

    def wake(self, state: Any) -> int | None:
        """When the view will change without an event."""
        return None


class Cache(Fold):
    """``set`` (with seconds to live), ``get`` and ``delete``: hits are gets of an entry that has not expired."""

    fields = "sets long, hits long, misses long, deletes long, live boolean"

    def start(self) -> dict:
        return {"sets": 0, "hits": 0, "misses": 0, "deletes": 0, "until": None}

    def step(self, state: dict, at: int, event_id: int, what: list) -> dict:
        op, seconds = what
        if op == "set":
            state["sets"] += 1
            state["until"] = at + int(seconds * 1_000_000)
        elif op == "delete":
            state["deletes"] += 1
            state["until"] = None
        elif op == "get":
            state["hits" if state["until"] is not None and at < state["until"] else "misses"] += 1
        return state

    def view(self, state: dict, now: int) -> tuple:
        return state["sets"], state["hits"], state["misses"], state["deletes"], state["until"] is not None and now < state["until"]

    def wake(self, state: dict) -> int | None:
        return state["until"]


class Breaker(Fold):
    """CLOSED until ``trip`` failures in a row, then OPEN; ``rest`` seconds after the last failure HALF_OPEN: one trial closes it or opens it again."""

    fields = "state string, failures_in_row long, trips long, refused long"

    def __init__(self, trip: int, rest: float):
        self.trip, self.rest = trip, int(rest * 1_000_000)

    def start(self) -> dict:
        return {"open": False, "failures": 0, "last": 0, "trips": 0, "refused": 0}

    def step(self, state: dict, at: int, event_id: int, what: list) -> dict:
        if state["open"] and at - state["last"] < self.rest:
            state["refused"] += 1
        elif what[0]:
            state["failures"] += 1
            state["last"] = at
            if state["failures"] >= self.trip:
                state["open"] = True
                state["trips"] += 1
        else:
            state["failures"], state["open"] = 0, False
        return state

    def view(self, state: dict, now: int) -> tuple:
        name = "CLOSED" if not state["open"] else "HALF_OPEN" if now - state["last"] >= self.rest else "OPEN"
        return name, state["failures"], state["trips"], state["refused"]

    def wake(self, state: dict) -> int | None:
        return state["last"] + self.rest if state["open"] else None


class Newest(Fold):
    """The ids of the last ``most`` events, newest first."""

    fields = "newest array<long>"

    def __init__(self, most: int):
        self.most = most

    def start(self) -> list:
        return []

    def step(self, state: list, at: int, event_id: int, what: list) -> list:
        return [event_id, *state[: self.most - 1]]

    def view(self, state: list, now: int) -> tuple:
        return (state,)


#: Keys are dealt over so many groups. A checkpoint holds for one number only.
BUCKETS = 1_024


def in_order(fold: Fold, columns: list[str]):
    """Runs a fold for each key of a bucket. State: of each key its version, settled fold, next time of change and waiting events; and a timer for the earliest change.

    Each group of rows costs Spark milliseconds to hand over, far more than the fold of a key, so that many keys share a group and come and go at once.
    """

    def run(bucket: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        now = group.getCurrentWatermarkMs() * 1000
        states: dict[str, tuple] = pickle.loads(group.get[0]) if group.exists else {}
        new: dict[str, list] = {key: [] for key, (_, _, due, _) in states.items() if due is not None and due * 1000 < now}
        for frame in [] if group.hasTimedOut else frames:
            for key, line in zip(frame["key"], frame["event"], strict=True):
                new.setdefault(key, []).append(line)
        rows = []
        for key, lines in new.items():
            version, settled, _, waiting = states.get(key) or (0, fold.start(), None, [])
            events = sorted([*waiting, *((*list(json.loads(line).values())[:2], line) for line in lines)])
            passed = sum(at < now for at, _, _ in events)
            for at, i, line in events[:passed]:
                settled = fold.step(settled, at, i, list(json.loads(line).values())[2:])
            state = copy.copy(settled)
            for at, i, line in events[passed:]:
                state = fold.step(state, at, i, list(json.loads(line).values())[2:])
            # a timer goes off when the watermark is past it: at the first millisecond at which the last event has passed, or the view has changed
            wake = fold.wake(state)
            due = [at // 1000 for at, _, _ in events[passed:][-1:]] + ([(wake - 1) // 1000] if wake is not None and wake > now else [])
            states[key] = version + 1, settled, min(due, default=None), events[passed:]
            rows.append((key, version + 1, *fold.view(state, now)))
        group.update((pickle.dumps(states),))
        due = [due for _, _, due, _ in states.values() if due is not None]
        if due:
            group.setTimeoutTimestamp(max(1, min(due)))
        yield pd.DataFrame(rows, columns=columns)

    return run


def folded(events: DataFrame, key: str, fold: Fold, what: list[F.Column], late: str = "1 hour") -> DataFrame:
    """key, version and the fold's fields, each time they may have changed. ``events`` is a stream with ts and event_id."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)  # the state store on disk
    written = {"ignoreNullFields": "false"}
    event = F.struct(F.unix_micros("ts").alias("at"), "event_id", *[w.alias(f"w{i}") for i, w in enumerate(what)])
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")
    rows = events.withWatermark("ts", late).select(bucket, "ts", F.to_json(F.struct(key), written).alias("key"), F.to_json(event, written).alias("event"))
    schema = f"key string, version long, {fold.fields}"
    run = in_order(fold, [part.split()[0] for part in schema.split(", ")])
    found = rows.groupBy("bucket").applyInPandasWithState(run, schema, "keys binary", "update", "EventTimeTimeout")
    return found.select(F.from_json("key", T.StructType([events.schema[key]]))[key].alias(key), *found.columns[1:])


def newest(results: DataFrame, key: str) -> DataFrame:
    """The present state of each key, of all results that a run wrote."""
    last = results.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in results.columns if c not in (key, "version")]), "version").alias("x"))
    return last.select(key, "x.*")
