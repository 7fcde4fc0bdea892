"""Queries of curation and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import windows as W
from ..sources import panel
from .registry import P1, P3, P4, SNAP, p1, p3, p4, query, rnd, snap

_DIRTY = f"{P1}, x AS (SELECT asset_id, date, CASE WHEN asset_id % 17 = 0 AND day(date) = 9 THEN -close WHEN asset_id % 19 = 0 AND day(date) = 12 THEN close * 5000 ELSE close END AS close, CASE WHEN asset_id % 23 = 0 AND day(date) = 5 THEN -1 ELSE marketcap END AS marketcap, CASE WHEN asset_id % 29 = 0 AND day(date) = 20 THEN volume * 100000 ELSE volume END AS volume FROM p1)"


def dirty(spark, sf):
    a, d = F.col("asset_id"), F.dayofmonth("date")
    return p1(spark, sf).select("asset_id", "date", F.when((a % 17 == 0) & (d == 9), -F.col("close")).when((a % 19 == 0) & (d == 12), F.col("close") * 5000).otherwise(F.col("close")).alias("close"), F.when((a % 23 == 0) & (d == 5), -1.0).otherwise(F.col("marketcap")).alias("marketcap"), F.when((a % 29 == 0) & (d == 20), F.col("volume") * 100000).otherwise(F.col("volume")).alias("volume"))


_LOG = """a AS (SELECT *, CASE WHEN close > 0 THEN close END AS c1, CASE WHEN marketcap >= 0 THEN marketcap END AS m1, CASE WHEN volume >= 0 THEN volume END AS v1 FROM x),
b AS (SELECT *, c1 / nullif(lag(c1) OVER w, 0) - 1 AS r FROM a WINDOW w AS (PARTITION BY asset_id ORDER BY date)), c AS (SELECT *, coalesce(abs(r) > 5, false) AS sp, lead(r) OVER w AS r2, coalesce(lead(abs(r) > 5) OVER w, false) AS sp2, median(m1) OVER f AS mm, median(v1) OVER f AS mv FROM b WINDOW w AS (PARTITION BY asset_id ORDER BY date), f AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT asset_id, date, 'close' AS dataset, 'not_positive' AS rule, round(close, 6) AS old_value FROM c WHERE close IS NOT NULL AND c1 IS NULL
UNION ALL SELECT asset_id, date, 'marketcap', 'negative', round(marketcap, 6) FROM c WHERE marketcap IS NOT NULL AND m1 IS NULL
UNION ALL SELECT asset_id, date, 'volume', 'negative', round(volume, 6) FROM c WHERE volume IS NOT NULL AND v1 IS NULL
UNION ALL SELECT asset_id, date, 'close', 'jump_revert', round(c1, 6) FROM c WHERE sp AND sp2 AND sign(r) <> sign(r2)
UNION ALL SELECT asset_id, date, 'marketcap', 'spike', round(m1, 6) FROM c WHERE m1 > 20 * mm
UNION ALL SELECT asset_id, date, 'volume', 'spike', round(v1, 6) FROM c WHERE v1 > 50 * mv"""


@query(f"WITH {_DIRTY}, {_LOG}")
def repair_log(spark, sf):
    return Q.clean_panel(dirty(spark, sf))[1].select("asset_id", "date", "dataset", "rule", rnd("old_value").alias("old_value"))


@query(f"""WITH {P3}, g AS (SELECT asset_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p3 WHERE asset_id % 10 <> 0 GROUP BY asset_id), d AS (SELECT g.asset_id, g.date, close FROM g LEFT JOIN p3 USING (asset_id, date)), r AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
m AS (SELECT *, coalesce(r > 1 AND lead(r, 1) OVER w < -0.5, false) AS s1, coalesce(r > 1 AND lead(r, 2) OVER w < -0.5, false) AS s2, coalesce(r > 1 AND lead(r, 3) OVER w < -0.5, false) AS s3 FROM r WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
f AS (SELECT *, s1 OR bool_or(s2) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) OR bool_or(s3) OVER (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM m)
SELECT asset_id, count(*) AS days, count(CASE WHEN NOT a THEN close END) AS priced, count(*) FILTER (WHERE a) AS winsorized FROM f GROUP BY 1""")
def silver_price(spark, sf):
    d = p3(spark, sf)
    s = Q.silver_prices(d, d.where("asset_id % 10 = 0").select("asset_id"))
    return s.groupBy("asset_id").agg(F.count(F.lit(1)).alias("days"), F.count("close").alias("priced"), F.count_if(F.col("is_winsorized")).alias("winsorized"))


@query(f"""WITH {P4}, d AS (SELECT asset_id, instrument_id, exchange, date, avg(CASE WHEN date >= DATE '1998-01-01' THEN rate / 100 ELSE rate END) AS rate FROM p4 GROUP BY 1, 2, 3, 4), g AS (SELECT asset_id, instrument_id, exchange, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY 1, 2, 3),
f AS (SELECT g.*, d.rate AS r, last_value(d.rate IGNORE NULLS) OVER (PARTITION BY g.asset_id, g.instrument_id, g.exchange ORDER BY g.date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM g LEFT JOIN d ON d.asset_id = g.asset_id AND d.instrument_id = g.instrument_id AND d.exchange = g.exchange AND d.date = g.date)
SELECT asset_id, instrument_id, exchange, count(*) AS n, count(*) FILTER (WHERE r IS NULL) AS n_filled, round(avg(v), 8) AS rate FROM f WHERE v IS NOT NULL GROUP BY 1, 2, 3""")
def silver_funding(spark, sf):
    s = Q.silver_funding(p4(spark, sf), "1998-01-01", least_assets=5)
    return s.groupBy("asset_id", "instrument_id", "exchange").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_ffilled")).alias("n_filled"), rnd(F.avg("rate"), 8).alias("rate"))


@query(f"""WITH {SNAP}, b AS (SELECT rebalance_date, asset_id, CASE WHEN month(rebalance_date) = 6 THEN weight * 0.9 ELSE weight END AS weight FROM snap), g AS (SELECT rebalance_date, sum(weight) AS w, count(*) AS n FROM b GROUP BY 1)
SELECT 'weights' AS rule, rebalance_date, printf('%.4f', w) AS detail FROM g WHERE abs(w - 1) > 0.001 UNION ALL SELECT 'size', rebalance_date, CAST(n AS VARCHAR) FROM g WHERE n <> 20 UNION ALL SELECT 'forbidden', rebalance_date, CAST(asset_id AS VARCHAR) FROM b WHERE asset_id % 37 = 0
UNION ALL SELECT 'ineligible', rebalance_date, CAST(asset_id AS VARCHAR) FROM b WHERE asset_id % 31 = 0""")
def inv_weights(spark, sf):
    s = snap(spark, sf)
    b = s.withColumn("weight", F.when(F.month("rebalance_date") == 6, F.col("weight") * 0.9).otherwise(F.col("weight")))
    return Q.basket_invariants(b, s.where("asset_id % 31 <> 0"), s.where("asset_id % 37 = 0"), 20)


@query(f"WITH {P1}, r AS (SELECT date, close / nullif(lag(close) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1 AS r FROM p1), d AS (SELECT date, CASE WHEN day(date) % 7 <> 0 THEN avg(r) END AS r, count(*) / 200.0 AS t FROM r GROUP BY date), f AS (SELECT min(date) AS f FROM d WHERE r IS NOT NULL) SELECT round(1 - count(r) / count(*), 6) AS nan_share, count(*) FILTER (WHERE abs(r) > 0.5) AS extreme, count(*) FILTER (WHERE t > 0.95) AS high_turnover FROM d, f WHERE date >= f")
def inv_nan_share(spark, sf):
    r = p1(spark, sf).withColumn("r", W.simple_return("close", W.by())).groupBy("date").agg(F.avg("r").alias("m"), (F.count(F.lit(1)) / 200.0).alias("t"))
    x = Q.result_invariants(r.withColumn("r", F.when(F.dayofmonth("date") % 7 != 0, F.col("m"))), "r", "t")
    return x.select(rnd("nan_share").alias("nan_share"), "extreme", "high_turnover")


@query("SELECT 'orders' AS \"table\", (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS orphans, 'error' AS severity UNION ALL SELECT 'suppliers', (SELECT count(DISTINCT s_suppkey) FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)), 'warning'")
def ref_integrity(spark, sf):
    dim = panel.read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return Q.orphans({"orders": (panel.read(spark, sf, "orders"), "o_custkey"), "suppliers": (panel.read(spark, sf, "supplier"), "s_suppkey")}, dim, "id", ["suppliers"])


@query("""SELECT 'null:l_orderkey' AS rule, count(*) FILTER (WHERE l_orderkey IS NULL) AS n FROM lineitem UNION ALL SELECT 'null:l_linenumber', count(*) FILTER (WHERE l_linenumber IS NULL) FROM lineitem UNION ALL SELECT 'positive:l_discount', count(*) FILTER (WHERE l_discount <= 0) FROM lineitem UNION ALL SELECT 'positive:l_quantity', count(*) FILTER (WHERE l_quantity <= 0) FROM lineitem
UNION ALL SELECT 'duplicate_keys', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def table_validator(spark, sf):
    return Q.validate_table(panel.read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], positive=["l_discount", "l_quantity"])


@query(f"""WITH {P3}, w AS (SELECT CAST(date_trunc('week', date) AS DATE) + CASE WHEN month(date) = 12 AND day(date) > 25 THEN 1 ELSE 0 END AS decision_date, avg(close) / 1000 AS v FROM p3 GROUP BY 1), s AS (SELECT *, decision_date - lag(decision_date) OVER (ORDER BY decision_date) AS st, isodow(decision_date) AS d FROM w)
SELECT count(*) FILTER (WHERE v IS NULL) AS empty, count(*) FILTER (WHERE NOT v BETWEEN 0.001 AND 3) AS out_of_range, count(*) FILTER (WHERE st <> 7) AS bad_step, count(*) FILTER (WHERE d <> 1) AS bad_weekday FROM s""")
def gold_gate(spark, sf):
    late = F.when((F.month("date") == 12) & (F.dayofmonth("date") > 25), 1).otherwise(0)
    d = p3(spark, sf).groupBy(F.date_add(F.to_date(F.date_trunc("week", "date")), late).alias("decision_date")).agg((F.avg("close") / 1000).alias("v"))
    return Q.weekly_gate(d, "v", 0.001, 3.0)


@query("SELECT CAST(max(o_orderdate) AS DATE) AS last, CAST(DATE '2001-08-10' - CAST(max(o_orderdate) AS DATE) AS INTEGER) AS days, DATE '2001-08-10' - CAST(max(o_orderdate) AS DATE) > 3 AS stale FROM orders")
def freshness_gate(spark, sf):
    o = panel.read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    return Q.staleness(o, F.lit("2001-08-10").cast("date"))


@query("""WITH d AS (SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) * CASE WHEN user_id % 13 = 0 THEN 0.5 ELSE 1 END AS high, min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1, 2)
SELECT asset_id, date FROM d WHERE high < greatest(open, close) OR low > least(open, close) OR high < low OR least(open, high, low, close) <= 0""")
def ohlc_bounds(spark, sf):
    e = panel.read(spark, sf, "events").groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"))
    d = e.agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"))
    return Q.ohlc_violations(d.withColumn("high", F.col("high") * F.when(F.col("asset_id") % 13 == 0, 0.5).otherwise(1.0))).select("asset_id", "date")


@query(f"WITH {P3}, s AS (SELECT asset_id, date - lag(date) OVER (PARTITION BY asset_id ORDER BY date) AS s FROM p3) SELECT asset_id, count(*) FILTER (WHERE s = 0) AS repeated, count(*) FILTER (WHERE s > 1) AS gaps, CAST(max(s) AS INTEGER) AS longest FROM s GROUP BY 1")
def temporal_audit(spark, sf):
    return Q.temporal_violations(p3(spark, sf))


@query(f"WITH {P3}, a AS (SELECT asset_id, arg_max(close, date) AS before FROM p3 WHERE date <= DATE '1998-01-31' GROUP BY 1), b AS (SELECT asset_id, arg_max(close, date) AS after FROM p3 WHERE date <= DATE '1998-06-30' GROUP BY 1) SELECT a.asset_id, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN abs(after / before - 1) > 0.25 THEN 'fail' WHEN abs(after / before - 1) > 0.15 THEN 'warn' ELSE 'ok' END AS status FROM a JOIN b ON a.asset_id = b.asset_id")
def bands_check(spark, sf):
    from ..operators import asof

    d = p3(spark, sf).select("asset_id", "date", "close")
    at = lambda day: asof.latest_per_key(d, ["asset_id"], "date", F.lit(day).cast("date"))
    x = Q.change_bands(at("1998-01-31"), at("1998-06-30"), "asset_id", "close")
    return x.select("asset_id", rnd("before", 4).alias("before"), rnd("after", 4).alias("after"), "status")


@query("SELECT s_suppkey AS asset_id, CAST(o.first AS DATE) AS onboard_date, DATE '1995-01-05' AS rebalance_date FROM supplier JOIN (SELECT l_suppkey, min(l_shipdate) AS first FROM lineitem GROUP BY 1) o ON l_suppkey = s_suppkey WHERE CAST(o.first AS DATE) > DATE '1995-01-05'")
def perp_invariants(spark, sf):
    listed = panel.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id")).agg(F.min(F.to_date("l_shipdate")).alias("onboard_date"))
    e = panel.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset_id"), F.lit("1995-01-05").cast("date").alias("rebalance_date"))
    return Q.listing_invariants(e, listed)
