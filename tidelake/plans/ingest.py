"""Queries of ingestion: versioned tables and merges, catching up, landed payloads."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from ..sources import catchup, panel, payloads, shared
from ..sources.versioned import VersionedTable
from .registry import query, rnd


def _quarters(events):
    """Events with the quarter of the whole time span that they fall into, 0 to 3."""
    span = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else F.lit(c).cast("timestamp"))
    share = (us("ts") - us(span["a"])) / (us(span["b"]) - us(span["a"]) + 1)
    return events.withColumn("_q", F.floor(share * 4))


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def incremental_merge(spark, sf):
    """All events, merged in four batches that come newest first, one of them twice."""
    e = _quarters(panel.read(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value"))
    t = VersionedTable(spark, shared.folder(spark, "latest"), ["user_id"], buckets=16)
    for k in (3, 1, 0, 1, 2):
        t.merge(e.where(F.col("_q") == k).drop("_q"), ["ts", "event_id"], k)
    return t.read()


@query("WITH s AS (SELECT min(ts) AS a, max(ts) AS b FROM events) SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events, s WHERE floor((epoch_us(ts) - epoch_us(a)) / (epoch_us(b) - epoch_us(a) + 1) * 4) < 2 GROUP BY user_id")
def table_as_of(spark, sf):
    """The table as it was two merges ago."""
    e = _quarters(panel.read(spark, sf, "events").select("user_id", "ts", "event_id", "value"))
    t = VersionedTable(spark, shared.folder(spark, "as-of"), ["user_id"], buckets=16)
    for k in range(4):
        t.merge(e.where(F.col("_q") == k).drop("_q"), ["ts", "event_id"], k)
    return t.read(t.version() - 2)


@query("""WITH m AS (SELECT o_orderpriority AS run_id, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1), l AS (SELECT l_returnflag AS run_id, count(*) AS n, round(max(l_quantity), 4) AS top FROM lineitem GROUP BY 1)
SELECT run_id, n, mean, CAST(NULL AS DOUBLE) AS top FROM m UNION ALL SELECT run_id, n, NULL, top FROM l""")
def run_catalog(spark, sf):
    """Runs of two kinds in one catalog: the second brings a column of its own, and run ids stay unique."""
    t = VersionedTable(spark, shared.folder(spark, "runs"), ["run_id"], buckets=4)
    t.append(panel.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean")), "first")
    t.append(panel.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run_id")).agg(F.count(F.lit(1)).alias("n"), rnd(F.max("l_quantity"), 4).alias("top")), "second")
    return t.read()


@query("SELECT CAST(ts AS DATE) AS date, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def catch_up_days(spark, sf):
    """Daily rows, filled by a job that stops after one run of days and is started again."""
    e = panel.read(spark, sf, "events").withColumn("date", F.to_date("ts"))
    span = e.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    t = VersionedTable(spark, shared.folder(spark, "daily"), ["date", "event_type"], buckets=8)

    def compute(a: datetime.date, b: datetime.date):
        return e.where(F.col("date").between(F.lit(a), F.lit(b))).groupBy("date", "event_type").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("value"), 4).alias("total"))

    catchup.catch_up(t, compute, span["a"], span["b"], step=10, most=1)
    catchup.catch_up(t, compute, span["a"], span["b"], step=10)
    return t.read()


def landed_series(events, kind: str, names: tuple[str, ...] = ("close",)):
    """Responses as a provider would send them: one a user, with all its events as points."""
    point = F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("time"), *(F.col(n) for n in names))
    lines = events.groupBy(F.concat(F.lit("u"), F.col("user_id")).alias("key")).agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", point.alias("p")))).alias("ps"), F.max("ts").cast("timestamp").alias("fetched_at"))
    body = F.to_json(F.struct(F.lit("0").alias("code"), F.transform("ps", lambda x: x["p"]).alias("data")))
    return lines.select(F.lit(kind).alias("kind"), "key", "fetched_at", body.alias("line"))


@query("SELECT 'u' || user_id AS asset_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS funding_rate FROM events GROUP BY 1, 2")
def payload_funding(spark, sf):
    e = panel.read(spark, sf, "events").withColumn("close", F.col("value"))
    x = payloads.facts(landed_series(e, "funding"), "funding")
    return x.select("asset_id", "date", rnd("funding_rate").alias("funding_rate"))


@query("SELECT 'u' || user_id AS asset_id, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS open_interest_usd FROM events GROUP BY 1, 2")
def payload_open_interest(spark, sf):
    e = panel.read(spark, sf, "events").withColumn("close", F.col("value"))
    return payloads.facts(landed_series(e, "open_interest"), "open_interest")


@query("""WITH d AS (SELECT 'u' || user_id AS asset_id, CAST(ts AS DATE) AS date, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS l, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS s FROM events GROUP BY 1, 2),
f AS (SELECT asset_id, min(date) AS a FROM d WHERE l > 0 OR s > 0 GROUP BY 1)
SELECT asset_id, date, round(l, 4) AS long_liquidation_usd, round(s, 4) AS short_liquidation_usd FROM d JOIN f USING (asset_id) WHERE date >= a""")
def payload_liquidations(spark, sf):
    side = lambda kind: F.when(F.col("event_type") == kind, F.col("value")).otherwise(0.0)
    e = panel.read(spark, sf, "events").withColumn("longLiquidationUsd", side("purchase")).withColumn("short_liquidation_usd", side("error"))
    x = payloads.facts(landed_series(e, "liquidations", ("longLiquidationUsd", "short_liquidation_usd")), "liquidations")
    return x.select("asset_id", "date", rnd("long_liquidation_usd", 4).alias("long_liquidation_usd"), rnd("short_liquidation_usd", 4).alias("short_liquidation_usd"))


@query("SELECT CAST(o_custkey AS VARCHAR) AS asset_id, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2")
def payload_ohlc(spark, sf):
    """Candles of a day in responses [[ms, o, h, l, c], ...]; each order is a candle, its key the millisecond of the day."""
    o = panel.read(spark, sf, "orders").withColumn("n", F.row_number().over(panel.Window.partitionBy("o_custkey", "o_orderdate").orderBy("o_orderkey")))
    ms = F.unix_millis(F.col("o_orderdate").cast("timestamp")) + F.col("n")
    price = F.col("o_totalprice").cast("string")
    candle = F.concat(F.lit("["), F.concat_ws(",", ms.cast("string"), price, price, price, price), F.lit("]"))
    lines = o.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(candle), ","), F.lit("]")).alias("line"))
    return payloads.facts(lines.select(F.lit("ohlc").alias("kind"), "key", F.current_timestamp().alias("fetched_at"), "line"), "ohlc")


@query("SELECT user_id, CAST(ts AS DATE) AS date, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def variant_props(spark, sf):
    """A number inside each event's JSON text, by VARIANT."""
    e = panel.read(spark, sf, "events").withColumn("v", F.try_parse_json("props"))
    return e.groupBy("user_id", F.to_date("ts").alias("date")).agg(F.sum(F.try_variant_get("v", "$.k", "bigint")).alias("k"), F.count(F.lit(1)).alias("n"))


@query("""SELECT 'u' || event_id AS key, CASE event_type WHEN 'error' THEN 'error: too many requests' WHEN 'click' THEN 'not json' WHEN 'view' THEN 'unknown kind' ELSE 'no data' END AS reason, event_type = 'error' AS retry FROM events WHERE event_type <> 'purchase'""")
def payload_rejects(spark, sf):
    """Lines made from events so that all but purchases are bad, each kind in its own way."""
    kind = F.col("event_type")
    line = F.when(kind == "error", '{"code": "429", "msg": "Too Many Requests"}').when(kind == "click", F.concat(F.lit('{"data": '), "props")).when(kind == "purchase", F.format_string('{"code": "0", "data": [{"time": 0, "close": %s}]}', F.col("value").cast("string"))).otherwise('{"code": "0", "data": [{"time": null}]}')
    x = panel.read(spark, sf, "events").select(F.when(kind == "view", "telegram").otherwise("funding").alias("kind"), F.concat(F.lit("u"), "event_id").alias("key"), F.col("ts").cast("timestamp").alias("fetched_at"), line.alias("line"))
    return payloads.rejected(x).select("key", "reason", "retry")
