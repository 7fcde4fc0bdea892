"""Queries of streams: what there is, processed with a checkpoint, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import panel, shared
from ..streaming import events as E
from ..streaming import notices as N
from .registry import query, rnd


def _run(spark, sf, build, mode):
    path = shared.folder(spark, "stream")
    return E.run_available(build(E.read(spark, f"{sf}/events.parquet")), path.rpartition("/")[2], f"{path}/checkpoint", mode)


def _notices(spark, sf, idle_days=30):
    """What the stream has settled, and what still waits for the watermark in its checkpoint."""
    path = f"{shared.folder(spark, 'stream')}/checkpoint"
    settled = E.run_available(N.notices(E.read(spark, f"{sf}/events.parquet"), idle_days=idle_days), path.split("/")[-2], path, "append")
    return settled.unionByName(N.unsettled(spark, path, idle_days))


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf):
    x = _run(spark, sf, E.tumbling, "complete")
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", rnd("total", 4).alias("total"))


@query("SELECT CAST(d + CAST(k AS INTEGER) AS TIMESTAMP) AS start, event_type, count(*) AS n, max(value) AS top FROM (SELECT CAST(ts AS DATE) AS d, event_type, value, unnest([0, -1]) AS k FROM events) GROUP BY 1, 2")
def stream_sliding(spark, sf):
    x = _run(spark, sf, E.sliding, "complete")
    return x.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "top")


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    return _run(spark, sf, lambda e: E.dedup(e.unionByName(e), ["event_id"]).select("event_id", "user_id", "event_type"), "append")


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS s FROM events), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, g")
def stream_session(spark, sf):
    x = _run(spark, sf, E.sessions, "complete")
    return x.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("WITH s AS (SELECT user_id, event_id, CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS state, lag(CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, event_id, state FROM s WHERE p IS NULL OR p <> state")
def stream_state_change(spark, sf):
    """Changes of a user's state and its first state, whatever the pauses between events."""
    x = _notices(spark, sf, idle_days=36500)
    return x.where("kind = 'change' or before is null").select(F.col("key").alias("user_id"), "event_id", F.col("now").alias("state"))


_STATES = "CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END"


@query(f"""WITH s AS (SELECT user_id, event_id, ts, {_STATES} AS now, lag({_STATES}) OVER w AS p, lag(ts) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT user_id, event_id, ts, now, t IS NULL OR ts - t > INTERVAL 2 DAY AS fresh, CASE WHEN ts - t <= INTERVAL 2 DAY THEN p END AS before, t FROM s)
SELECT user_id AS key, 'daily' AS kind, event_id, ts AS at, before, now FROM n WHERE fresh OR CAST(ts AS DATE) <> CAST(t AS DATE)
UNION ALL SELECT user_id, 'change', event_id, ts, before, now FROM n WHERE before <> now""")
def stream_notices(spark, sf):
    return _notices(spark, sf, idle_days=2).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS long_usd, round(sum(CASE WHEN event_type <> 'purchase' THEN value ELSE 0 END), 4) AS short_usd FROM events GROUP BY 1, 2")
def daily_flows(spark, sf):
    e = panel.read(spark, sf, "events")
    buy = F.col("event_type") == "purchase"
    g = e.groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"))
    return g.agg(rnd(F.sum(F.when(buy, F.col("value")).otherwise(0.0)), 4).alias("long_usd"), rnd(F.sum(F.when(buy, 0.0).otherwise(F.col("value"))), 4).alias("short_usd"))
