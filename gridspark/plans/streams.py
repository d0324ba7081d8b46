"""Queries: streaming jobs, run over all that is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.plans.registry import query
from gridspark.streaming import incremental as inc


def _events(spark, d):
    return inc.read_stream(spark, f"{d}/events.parquet")


@query("SELECT event_type, count(*) AS cells FROM events GROUP BY 1")
def str01_stream_inventory(spark, d):
    return inc.run_available(inc.stream_inventory(_events(spark, d), ["event_type"]), "complete")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def str02_latest_request(spark, d):
    latest = inc.latest_request(_events(spark, d), "user_id", "event_id", ["event_type", "value"])
    return inc.run_available(latest, "update", ["user_id"])


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def str02_latest_with_expiry(spark, d):
    """The newest request of each user by keyed state that timers delete: one row each time it changes, of which the last is taken."""
    with inc.with_rocksdb(spark):
        latest = inc.latest_with_expiry(_events(spark, d), "user_id", "event_id", ["event_type", "value"], "ts", "1 day", 10_000 * 86_400_000)
        return inc.run_available(latest, "update", ["user_id"])


def _plain(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@query("""SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS "end", count(*) AS samples, max(value) AS peak, count(*) FILTER (value > 20) AS breaches FROM events GROUP BY 1, 2""")
def str03_telemetry_windows(spark, d):
    return _plain(inc.run_available(inc.telemetry_windows(_events(spark, d), "ts", "value", 20.0, "1 day", by=["event_type"]), "complete"))


@query("""SELECT s AS start, s + INTERVAL 12 HOUR AS "end", count(*) AS samples, max(value) AS peak, count(*) FILTER (value > 20) AS breaches FROM (SELECT *, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY s""")
def str03_sliding_windows(spark, d):
    return _plain(inc.run_available(inc.telemetry_windows(_events(spark, d), "ts", "value", 20.0, "12 hours", "6 hours"), "complete"))


@query(
    """, g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 2 HOUR, TRUE)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS samples, max(value) AS peak, count(*) FILTER (value > 20) AS breaches FROM s GROUP BY user_id, k"""
)
def str03_sessions(spark, d):
    return _plain(inc.run_available(inc.telemetry_sessions(_events(spark, d), "ts", "value", 20.0, "2 hours", ["user_id"]), "complete"))


@query("SELECT count(*) AS events, count(DISTINCT event_id) AS ids FROM events")
def str02_without_repeats(spark, d):
    """Every event delivered twice, and kept once."""
    twice = _events(spark, d).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    kept = inc.run_available(inc.without_repeats(twice, ["event_id"], "ts", "1 day"), "append")
    return kept.agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))
