"""Batch equivalents of the streaming jobs, registered for the oracle check."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlane.plans.registry import register
from searchlane.sources.tables import Tables
from searchlane.streaming.jobs import session_scores_batch, windowed_scores_batch


@register("hourly_event_scores", sql="""
SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, event_type,
       round(avg(value), 6) AS mean_value, count(*)::BIGINT AS n
FROM events GROUP BY date_trunc('hour', ts), event_type""")
def q_hourly_event_scores(spark, sf_dir):
    """X4 batch form: tumbling one-hour mean per event type over ``events``."""
    e = Tables(spark, sf_dir).events
    w = windowed_scores_batch(e)
    return w.select(F.unix_timestamp("window.start").alias("window_start"), "event_type",
                    F.round("mean_value", 6).alias("mean_value"), F.col("n").cast("long"))


@register("user_sessions", sql="""
WITH e AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 6 HOUR THEN 1 ELSE 0 END)
             OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM e)
SELECT user_id, epoch_us(min(ts))::BIGINT AS session_start_us, epoch_us(max(ts))::BIGINT + 21600000000 AS session_end_us,
       round(avg(value), 6) AS mean_value, count(*)::BIGINT AS n
FROM i GROUP BY user_id, island""")
def q_user_sessions(spark, sf_dir):
    """X4 session form: events of a user less than six hours apart, over all ``events``."""
    w = session_scores_batch(Tables(spark, sf_dir).events, gap="6 hours")
    return w.select("user_id", F.unix_micros(F.col("session.start").cast("timestamp")).alias("session_start_us"),
                    F.unix_micros(F.col("session.end").cast("timestamp")).alias("session_end_us"),
                    F.round("mean_value", 6).alias("mean_value"), F.col("n").cast("long"))
