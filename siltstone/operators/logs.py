"""Request logs: rates, latencies, histories, streaks, breakers, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import values_at


def rate_windows(events: DataFrame, client: str, limit: int, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Requests of each client in fixed windows, and how many of them are over the limit."""
    bucket = F.window(F.col(ts).cast("timestamp"), f"{seconds} seconds")
    counts = events.groupBy(client, bucket.alias("w")).agg(F.count("*").alias("n"))
    return counts.select(client, F.col("w.start").alias("window_start"), "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("n_refused"))


def floor_rank_percentiles(events: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The value at place floor(n * share) of the sorted values, counted from 0; keys of any size."""
    places = {f"p{round(s * 100)}": (lambda n, s=s: F.least(F.floor(n * s), n - 1)) for s in shares}
    return values_at(events, key, value, places).drop("mean")


def approximate_percentiles(events: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """The same by sketches, for keys with more rows than a task should sort."""
    return events.groupBy(key).agg(F.percentile_approx(value, [float(s) for s in shares], 10_000).alias("percentiles"))


def history(events: DataFrame, key: str, most: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest rows of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return events.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def running_mean(events: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running_mean", F.avg(value).over(w))


def streaks(events: DataFrame, key: str, failed: Column, order: list[str]) -> DataFrame:
    """Runs of failures in a row: key, streak number and length."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = events.withColumn("failed", failed).withColumn("island", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.filter("failed").groupBy(key, "island").agg(F.count("*").alias("streak"))


def health(events: DataFrame, key: str, failed: Column, order: list[str], streak_limit: int = 3, least_success: float = 0.8) -> DataFrame:
    """Success rate, longest failure streak, and whether the key is healthy."""
    longest = streaks(events, key, failed, order).groupBy(key).agg(F.max("streak").alias("longest_streak"))
    rate = events.groupBy(key).agg(F.round(F.avg(F.when(failed, 0.0).otherwise(1.0)), 6).alias("success_rate"), F.count("*").alias("n"))
    out = rate.join(longest, key, "left").withColumn("longest_streak", F.coalesce("longest_streak", F.lit(0)))
    return out.withColumn("healthy", (F.col("longest_streak") < streak_limit) & (F.col("success_rate") >= least_success))


def breaker(events: DataFrame, key: str, failed: Column, order: list[str], trip: int = 3, rest: int = 5, ts: str = "ts", span: str = "1 hour") -> DataFrame:
    """Circuit breaker states: CLOSED until ``trip`` failures in a row, then OPEN for ``rest`` requests, then one trial.

    A stretch of outcomes takes every state to one that does not depend on what came before, so the
    events of a key are folded in spans of time side by side, from each of the trip + rest + 1 states,
    and the spans' tables are folded after. A task holds a span of a key, then one row for each of its spans.
    """
    states = trip + rest + 1  # CLOSED with 0.. failures, OPEN with 0.. requests refused, HALF_OPEN
    new = lambda s, state, trips, refused: F.struct(state.cast("int").alias("state"), (s["trips"] + trips).cast("int").alias("trips"), (s["refused"] + refused).cast("int").alias("refused"))
    start = lambda i: F.struct(F.lit(i).alias("state"), F.lit(0).alias("trips"), F.lit(0).alias("refused"))

    def step(s: Column, fails: Column) -> Column:
        closed, half = s["state"] < trip, s["state"] == trip + rest
        opens = fails & (half | (s["state"] == trip - 1))
        return (
            F.when(opens, new(s, F.lit(trip), 1, 0))
            .when(closed & fails, new(s, s["state"] + 1, 0, 0))
            .when(closed | half, new(s, F.lit(0), 0, 0))
            .otherwise(new(s, s["state"] + 1, 0, 1))
        )

    dealt = events.withColumn("failed", failed).groupBy(key, F.window(F.col(ts).cast("timestamp"), span)["start"].alias("span"))
    lists = dealt.agg(F.sort_array(F.collect_list(F.struct(*order, "failed"))).alias("events"))
    every = F.array(*[start(i) for i in range(states)])
    table = F.aggregate("events", every, lambda a, e: F.transform(a, lambda s: step(s, e["failed"])))
    spans = lists.select(key, "span", table.alias("table")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("span", "table"))).alias("spans"))

    def through(s: Column, x: Column) -> Column:
        then = F.get(x["table"], s["state"])
        return new(s, then["state"], then["trips"], then["refused"])

    state = F.when(F.col("s.state") < trip, "CLOSED").when(F.col("s.state") < trip + rest, "OPEN").otherwise("HALF_OPEN")
    return spans.select(key, F.aggregate("spans", start(0), through).alias("s")).select(key, state.alias("state"), "s.trips", "s.refused")


def unexpired(entries: DataFrame, key: str, as_of: Column, written: str = "ts", ttl: str = "ttl_seconds") -> DataFrame:
    """The latest entry of each key, if it has not expired."""
    w = Window.partitionBy(key).orderBy(F.desc(written), F.desc("event_id"))
    latest = entries.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
    return latest.filter(F.unix_timestamp(F.col(written).cast("timestamp")) + F.col(ttl) > F.unix_timestamp(as_of.cast("timestamp")))


def hit_rates(events: DataFrame, key: str, hit: Column, value: str) -> DataFrame:
    n_hits = F.sum(F.when(hit, 1).otherwise(0)).cast("long")
    return events.groupBy(key).agg(F.count("*").alias("n"), n_hits.alias("n_hits"), F.round(n_hits / F.count("*"), 6).alias("hit_rate"), F.round(F.avg(value), 6).alias("avg_value"))


def roll_up(parts: DataFrame, ok: Column) -> DataFrame:
    """ok if all parts are, degraded if some are, else down; one row."""
    n_ok = F.sum(F.when(ok, 1).otherwise(0))
    return parts.agg(F.when(n_ok == F.count("*"), "ok").when(n_ok > 0, "degraded").otherwise("down").alias("status"), F.count("*").alias("n_parts"))


def gaps(events: DataFrame, key: str, order: list[str], ts: str = "ts") -> DataFrame:
    """Seconds since the key's previous event."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    return events.withColumn("at", seconds).withColumn("gap", F.col("at") - F.lag("at").over(Window.partitionBy(key).orderBy(*order))).drop("at")
