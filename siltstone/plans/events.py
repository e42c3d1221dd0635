"""Registered queries: request logs, streams, star-schema extras."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources.tables import table
from ..streaming import events as E
from ..streaming import stateful as W

QUERIES, SQL = {}, {}
FAILED = "event_type = 'error'"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, greatest(count(*) - 1, 0) AS n_refused FROM events GROUP BY 1, 2""")
def rate_limit_windows(spark, sf_dir):
    found = L.rate_windows(table(spark, sf_dir, "events"), "user_id", 1, 3600)
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(value) FILTER (place = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (place = least(floor(n * 0.95), n - 1)) AS p95, max(value) FILTER (place = least(floor(n * 0.99), n - 1)) AS p99 FROM r GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return L.floor_rank_percentiles(table(spark, sf_dir, "events"), "event_type", "value")


@query("SELECT user_id, event_id, nth FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INT) AS nth FROM events) WHERE nth <= 3")
def history_topn(spark, sf_dir):
    return L.history(table(spark, sf_dir, "events"), "user_id", 3).select("user_id", "event_id", "nth")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 8) AS running_mean FROM events")
def running_mean(spark, sf_dir):
    return L.running_mean(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"]).select("event_id", F.round("running_mean", 8).alias("running_mean"))


STREAKS_SQL = f"""marked AS (SELECT *, sum(CASE WHEN {FAILED} THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
streaks AS (SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS streak FROM marked WHERE {FAILED} GROUP BY ALL)"""


@query(f"WITH {STREAKS_SQL} SELECT * FROM streaks")
def failure_streaks(spark, sf_dir):
    return L.streaks(table(spark, sf_dir, "events"), "user_id", F.expr(FAILED), ["ts", "event_id"])


@query(f"""WITH {STREAKS_SQL}, l AS (SELECT user_id, max(streak) AS longest_streak FROM streaks GROUP BY user_id), r AS (SELECT user_id, round(avg(CASE WHEN {FAILED} THEN 0.0::DOUBLE ELSE 1 END), 6) AS success_rate, count(*) AS n FROM events GROUP BY user_id)
SELECT user_id, success_rate, n, coalesce(longest_streak, 0) AS longest_streak, coalesce(longest_streak, 0) < 3 AND success_rate >= 0.8 AS healthy FROM r LEFT JOIN l USING (user_id)""")
def agent_health(spark, sf_dir):
    return L.health(table(spark, sf_dir, "events"), "user_id", F.expr(FAILED), ["ts", "event_id"])


@query(f"""WITH RECURSIVE e AS (SELECT user_id, {FAILED} AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
walk(user_id, n, state, k, trips, refused) AS (SELECT DISTINCT user_id, 0::BIGINT, 'CLOSED', 0, 0, 0 FROM events
UNION ALL SELECT e.user_id, e.n, CASE w.state WHEN 'CLOSED' THEN CASE WHEN e.failed AND w.k + 1 >= 2 THEN 'OPEN' ELSE 'CLOSED' END WHEN 'OPEN' THEN CASE WHEN w.k + 1 >= 3 THEN 'HALF_OPEN' ELSE 'OPEN' END ELSE CASE WHEN e.failed THEN 'OPEN' ELSE 'CLOSED' END END,
  CASE w.state WHEN 'CLOSED' THEN CASE WHEN e.failed AND w.k + 1 < 2 THEN w.k + 1 ELSE 0 END WHEN 'OPEN' THEN CASE WHEN w.k + 1 >= 3 THEN 0 ELSE w.k + 1 END ELSE 0 END,
  w.trips + CASE WHEN e.failed AND (w.state = 'HALF_OPEN' OR (w.state = 'CLOSED' AND w.k + 1 >= 2)) THEN 1 ELSE 0 END, w.refused + CASE WHEN w.state = 'OPEN' THEN 1 ELSE 0 END
  FROM walk w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, arg_max(state, n) AS state, arg_max(trips, n) AS trips, arg_max(refused, n) AS refused FROM walk GROUP BY user_id""")
def circuit_breaker(spark, sf_dir):
    return L.breaker(table(spark, sf_dir, "events"), "user_id", F.expr(FAILED), ["ts", "event_id"], trip=2, rest=3)


@query("""WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1)
SELECT user_id, event_id FROM latest WHERE floor(epoch(ts)) + 86400 * (1 + event_id % 7) > epoch(TIMESTAMP '2024-01-31')""")
def ttl_latest(spark, sf_dir):
    entries = table(spark, sf_dir, "events").withColumn("ttl_seconds", 86400 * (1 + F.col("event_id") % 7))
    return L.unexpired(entries, "user_id", F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id", "event_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_hits, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 6) AS hit_rate, round(avg(value), 6) AS avg_value FROM events GROUP BY event_type")
def cache_hit_rate(spark, sf_dir):
    return L.hit_rates(table(spark, sf_dir, "events"), "event_type", F.col("value") > 50, "value")


@query("""WITH p AS (SELECT event_type, avg(value) AS v FROM events GROUP BY event_type) SELECT CASE WHEN count(*) FILTER (v > 0) = count(*) THEN 'ok' WHEN count(*) FILTER (v > 0) > 0 THEN 'degraded' ELSE 'down' END AS status, count(*) AS n_parts FROM p""")
def service_status(spark, sf_dir):
    parts = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("v"))
    return L.roll_up(parts, F.col("v") > 0)


@query("SELECT event_id, round(epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS gap FROM events")
def domain_gaps(spark, sf_dir):
    return L.gaps(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", F.round("gap", 3).alias("gap"))


@query("SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def streaming_rate_windows(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    counts = E.rate_windows(E.event_stream(spark, sf_dir, schema), "event_type", 21600)
    return E.run_available(counts, "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id FROM events")
def streaming_first_seen(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return E.run_available(E.once_within(E.event_stream(spark, sf_dir, schema), ["user_id"])).select("user_id")


@query(f"""WITH marked AS (SELECT *, {FAILED} AS failed, sum(CASE WHEN {FAILED} THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events),
runs AS (SELECT event_type, island, count(*) FILTER (failed) AS run, max(ts) AS last_ts FROM marked GROUP BY ALL)
SELECT event_type, max_by(run, island) AS failures_in_row, count(*) FILTER (run >= 2) AS trips, max_by(run, island) >= 2 AS open FROM runs GROUP BY event_type""")
def streaming_breaker(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    events = E.event_stream(spark, sf_dir, schema).withColumn("failed", F.expr(FAILED))
    return E.run_available(E.breaker_states(events, "event_type", trip=2), "update", ["event_type"])


@query("SELECT n_name, r_name, count(*) AS n, CAST(grouping(n_name) AS INT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def customer_rollup(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.grouping("n_name").cast("int").alias("level"))


@query("""WITH b AS (SELECT unnest([time_bucket(INTERVAL '1 day', ts), time_bucket(INTERVAL '1 day', ts - INTERVAL '12 hours') + INTERVAL '12 hours']) AS window_start, event_type FROM events)
SELECT window_start, event_type, count(*) AS n FROM b GROUP BY ALL""")
def sliding_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = e.groupBy(F.window("ts", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("""WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL '1 day' AS cut FROM events), s AS (SELECT *, sum(coalesce(cut, false)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, session""")
def user_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = e.groupBy("user_id", F.session_window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY ALL")
def lineitem_summary(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


# Streams with state and timers. The watermark at the end is an hour behind the newest event, in milliseconds.
AS_OF_SQL = "(SELECT epoch_ms(max(ts)) - 3600000 FROM events)"
OP = "CASE event_type WHEN 'purchase' THEN 'set' WHEN 'error' THEN 'delete' ELSE 'get' END"


def streamed(spark, sf_dir, key, fold, what):
    events = E.event_stream(spark, sf_dir, table(spark, sf_dir, "events").schema)
    return W.newest(E.run_available(W.folded(events, key, fold, what), "update", [key, "version"]), key)


@query(f"""WITH e AS (SELECT *, {OP} AS op FROM events),
seen AS (SELECT *, last_value(CASE op WHEN 'set' THEN epoch_us(ts) + 3600000000 * (1 + event_id % 48) WHEN 'delete' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS until,
  last_value(CASE op WHEN 'set' THEN epoch_us(ts) + 3600000000 * (1 + event_id % 48) WHEN 'delete' THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM e)
SELECT user_id, count(*) FILTER (op = 'set') AS sets, count(*) FILTER (op = 'get' AND epoch_us(ts) < coalesce(until, 0)) AS hits, count(*) FILTER (op = 'get' AND epoch_us(ts) >= coalesce(until, 0)) AS misses,
  count(*) FILTER (op = 'delete') AS deletes, coalesce(any_value(final) > {AS_OF_SQL} * 1000, false) AS live FROM seen GROUP BY user_id""")
def streaming_cache(spark, sf_dir):
    """Each user's log as a cache key: purchases set it for up to two days, errors delete it, all else reads it."""
    return streamed(spark, sf_dir, "user_id", W.Cache(), [F.expr(OP), 3600 * (1 + F.col("event_id") % 48)])


@query(f"""WITH RECURSIVE n AS (SELECT user_id, event_type = 'error' AS failed, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth FROM events),
walk AS (SELECT user_id, CAST(0 AS BIGINT) AS nth, false AS open, CAST(0 AS BIGINT) AS failures, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS trips, CAST(0 AS BIGINT) AS refused FROM events GROUP BY user_id
  UNION ALL SELECT w.user_id, n.nth, CASE WHEN w.open AND n.t - w.last < 86400000000 THEN true ELSE n.failed AND w.failures + 1 >= 2 END,
    CASE WHEN w.open AND n.t - w.last < 86400000000 THEN w.failures WHEN n.failed THEN w.failures + 1 ELSE 0 END,
    CASE WHEN n.failed AND NOT (w.open AND n.t - w.last < 86400000000) THEN n.t ELSE w.last END,
    w.trips + CAST(n.failed AND NOT (w.open AND n.t - w.last < 86400000000) AND w.failures + 1 >= 2 AS INT), w.refused + CAST(w.open AND n.t - w.last < 86400000000 AS INT)
  FROM walk w JOIN n ON n.user_id = w.user_id AND n.nth = w.nth + 1)
SELECT user_id, CASE WHEN NOT open THEN 'CLOSED' WHEN last + 86400000000 <= {AS_OF_SQL} * 1000 THEN 'HALF_OPEN' ELSE 'OPEN' END AS state, failures AS failures_in_row, trips, refused
FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY nth DESC) = 1""")
def streaming_timed_breaker(spark, sf_dir):
    """Two failures in a row open a user's breaker for a day."""
    return streamed(spark, sf_dir, "user_id", W.Breaker(trip=2, rest=86400), [F.expr(FAILED)])


@query("SELECT user_id, event_id, nth FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth <= 20")
def streaming_recent(spark, sf_dir):
    found = streamed(spark, sf_dir, "user_id", W.Newest(20), [F.lit(True)])
    return found.select("user_id", F.posexplode("newest").alias("nth", "event_id")).select("user_id", "event_id", (F.col("nth") + 1).cast("long").alias("nth"))
