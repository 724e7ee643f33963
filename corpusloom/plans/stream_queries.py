"""Streaming queries, drained to the end and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import table
from corpusloom.streaming import streams


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counters(spark, sf):
    return streams.drain(streams.counters(streams.source(spark, f"{sf}/events.parquet"), ["event_type"]), "complete")


@query("SELECT time_bucket(INTERVAL '60 seconds', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def stream_rate_windows(spark, sf):
    return streams.drain(streams.rate_windows(streams.source(spark, f"{sf}/events.parquet")), "complete")


@query("SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL '20 seconds', ts) - INTERVAL '20 seconds' * unnest([0, 1, 2]) AS window_start FROM events) GROUP BY window_start")
def stream_sliding_quota(spark, sf):
    """Calls of every 60 seconds, each 20 seconds anew."""
    return streams.drain(streams.rate_windows(streams.source(spark, f"{sf}/events.parquet"), slide="20 seconds"), "complete")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    return streams.drain(streams.first_seen(streams.source(spark, f"{sf}/events.parquet"), ["user_id", "event_type"]).select("user_id", "event_type"), "append")


_MS = "epoch_ms(ts)"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, value, {_MS} AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, value) AS k FROM events),
    s AS (SELECT user_id, k, value, ms FROM e WHERE k = 1
        UNION ALL SELECT e.user_id, e.k, CASE WHEN e.value >= s.value OR e.ms - s.ms >= 4000 THEN e.value ELSE s.value END, CASE WHEN e.value >= s.value OR e.ms - s.ms >= 4000 THEN e.ms ELSE s.ms END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, arg_max(value, k) AS value FROM s GROUP BY user_id""")
def stream_progress(spark, sf):
    return streams.drain(streams.progress(streams.source(spark, f"{sf}/events.parquet")), "update", "user_id")


@query("""WITH RECURSIVE e AS (SELECT user_id, CASE WHEN value < 50 THEN -1 ELSE 1 END AS step, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE WHEN value < 50 THEN -1 ELSE 1 END) AS k FROM events),
    s AS (SELECT user_id, k, greatest(0, step) AS n FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, greatest(0, s.n + e.step) FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
    SELECT user_id, arg_max(n, k) AS n FROM s GROUP BY user_id""")
def stream_taps(spark, sf):
    steps = streams.source(spark, f"{sf}/events.parquet").select("user_id", "ts", F.when(F.col("value") < 50, -1).otherwise(1).alias("step"))
    return streams.drain(streams.taps(steps, "user_id", "step"), "update", "user_id")


@query("SELECT DISTINCT event_id FROM events WHERE event_id % 3 <> 0")
def stream_new_files(spark, sf):
    """Events whose id the ledger lacks, batch by batch."""
    ledger = table(spark, sf, "events").filter("event_id % 3 = 0").select("event_id")
    seen = streams.first_seen(streams.source(spark, f"{sf}/events.parquet"), ["event_id"])
    return streams.new_only(streams.drain(seen.select("event_id"), "append"), ledger, "event_id")
