"""Queries with state by key, over the events table; the streaming forms of the same steps are in quern.streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.queries.registry import query
from quern.sources.tables import table
from quern.streaming import counters as op

HOUR = 3_600_000


def _events(spark, d):
    return table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "event_type")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events),
f AS (SELECT user_id, event_id, at_ms, k, at_ms AS window_start, 1::BIGINT AS hits FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.event_id, e.at_ms, e.k, CASE WHEN e.at_ms >= f.window_start + 86400000 THEN e.at_ms ELSE f.window_start END, CASE WHEN e.at_ms >= f.window_start + 86400000 THEN 1 ELSE f.hits + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)
SELECT user_id, event_id, at_ms, window_start, hits FROM f""")
def fixed_window_limit(spark, d):
    return op.fold(_events(spark, d), "user_id", "event_id", "at_ms", op.fixed_window(24 * HOUR), ["window_start", "hits"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS at_ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM events WHERE event_type = 'error'),
f AS (SELECT user_id, event_id, at_ms, k, at_ms AS last_failure, 1::BIGINT AS failures, 0::BIGINT AS locked_until FROM e WHERE k = 1
UNION ALL SELECT user_id, event_id, at_ms, k, at_ms, n, CASE WHEN n >= 5 THEN at_ms + 86400000 WHEN fresh OR locked_until <= at_ms THEN 0 ELSE locked_until END
FROM (SELECT *, CASE WHEN fresh THEN 1 ELSE failures + 1 END AS n FROM (SELECT e.*, f.failures, f.locked_until, CASE WHEN f.locked_until <> 0 THEN f.locked_until <= e.at_ms ELSE e.at_ms - f.last_failure > 259200000 END AS fresh
FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)))
SELECT user_id, event_id, at_ms, last_failure, failures, locked_until FROM f""")
def lockout_state(spark, d):
    failures = _events(spark, d).filter("event_type = 'error'")
    return op.fold(failures, "user_id", "event_id", "at_ms", op.lockout(72 * HOUR, 24 * HOUR), ["last_failure", "failures", "locked_until"])


@query("""SELECT user_id, event_id, recent, recent > 3 AS limited FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 RANGE BETWEEN 43199999 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def rolling_rpm(spark, d):
    return op.rolling(_events(spark, d), "user_id", "at_ms", 12 * HOUR, 3).select("user_id", "event_id", "recent", "limited")


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY start""")
def hourly_rates(spark, d):
    e = table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.upper("event_type").alias("severity"))
    return op.rates(e, "ts", "1 hour", "1 day").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "errors")


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 6 HOUR, true) AS opens FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS stop, count(*) AS n FROM s GROUP BY user_id, session""")
def event_sessions(spark, d):
    e = table(spark, d, "events").filter("user_id is not null and ts is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return op.sessions(e, "user_id", "ts", "6 hours", "1 day").select("user_id", shown("start").alias("start"), shown("end").alias("stop"), "n")
