"""Queries of joins, links, ledgers and payloads that no other plan shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as V
from ..operators import mapping as M
from ..operators import portfolio as L
from ..operators import quality as Q
from ..sources import catalog, panel
from .registry import MKT, P1, P2, P3, mkt, p1, p2, p3, query, rnd


def _daily(spark, sf, column, name):
    return panel.read(spark, sf, "lineitem").groupBy(F.to_date(column).alias("date")).agg(F.count(F.lit(1)).alias(name))


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS m FROM lineitem GROUP BY 1) SELECT a.date AS date, b.date AS date_right, n, m FROM a FULL JOIN b ON a.date = b.date")
def full_join_left_key(spark, sf):
    a = panel.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return V.full_join(a, _daily(spark, sf, "l_shipdate", "m"), "date", coalesced=False).select("date", "date_right", "n", "m")


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS m FROM lineitem GROUP BY 1) SELECT coalesce(a.date, b.date) AS date, n, m FROM a FULL JOIN b ON a.date = b.date")
def full_join_coalesced(spark, sf):
    a = panel.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return V.full_join(a, _daily(spark, sf, "l_shipdate", "m"), "date")


@query("WITH a AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS m FROM lineitem GROUP BY 1), c AS (SELECT CAST(l_shipdate AS DATE) AS date, max(l_tax) AS k FROM lineitem GROUP BY 1) SELECT date, n, m, k FROM a JOIN b USING (date) JOIN c USING (date) ORDER BY date DESC LIMIT 90")
def three_way_last(spark, sf):
    a = panel.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    c = panel.read(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("date")).agg(F.max("l_tax").alias("k"))
    return V.last_common([a, _daily(spark, sf, "l_shipdate", "m"), c], 90)


@query("SELECT o_orderkey, o_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def many_to_one(spark, sf):
    dim = panel.read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return V.many_to_one(panel.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), dim, ["o_custkey"])


@query(f"WITH {MKT} SELECT date, CASE WHEN r > 0 THEN 'UP' ELSE 'DOWN' END AS regime, round(r_alts, 8) AS ret FROM mkt")
def align_regimes(spark, sf):
    m = mkt(spark, sf)
    x = V.align_regimes(m.select("date", F.when(F.col("r") > 0, "UP").otherwise("DOWN").alias("regime")), m.select("date", F.col("r_alts").alias("r_ls"), "r"))
    return x.select("date", "regime", rnd("ret", 8).alias("ret"))


@query("""WITH i AS (SELECT c_custkey AS instrument_id, CASE c_custkey % 3 WHEN 0 THEN upper(n_name) WHEN 1 THEN 'ID' || n_nationkey ELSE 'NONE' END AS base_asset_symbol FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT instrument_id, base_asset_symbol, coalesce((SELECT 'id' || n_nationkey FROM nation WHERE upper(n_name) = base_asset_symbol), (SELECT 'id' || n_nationkey FROM nation WHERE 'ID' || n_nationkey = base_asset_symbol)) AS asset_id FROM i""")
def link_instruments(spark, sf):
    n = panel.read(spark, sf, "nation")
    c = panel.read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey") % 3
    i = c.select(F.col("c_custkey").alias("instrument_id"), F.when(k == 0, F.upper("n_name")).when(k == 1, F.concat(F.lit("ID"), "n_nationkey")).otherwise("NONE").alias("base_asset_symbol"))
    return M.link_instruments(i, n.select(F.concat(F.lit("id"), "n_nationkey").alias("asset_id"), F.col("n_name").alias("symbol")))


@query("""WITH p AS (SELECT n_nationkey, CASE WHEN n_nationkey < 15 THEN lower(n_name) ELSE 'x' || n_nationkey END AS provider_id FROM nation)
SELECT provider_id, CASE WHEN n_nationkey % 7 = 0 THEN 'manual' || n_nationkey WHEN n_nationkey < 15 THEN 'A' || n_nationkey ELSE upper(provider_id) END AS asset_id,
CASE WHEN n_nationkey % 7 = 0 THEN 'manual' WHEN n_nationkey < 15 THEN 'exact' ELSE 'fallback' END AS mapping_method, CASE WHEN n_nationkey % 7 = 0 OR n_nationkey < 15 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM p""")
def map_with_confidence(spark, sf):
    n = panel.read(spark, sf, "nation")
    key = F.col("n_nationkey")
    p = n.select(key, F.when(key < 15, F.lower("n_name")).otherwise(F.concat(F.lit("x"), key)).alias("provider_id"))
    over = p.where(key % 7 == 0).select("provider_id", F.concat(F.lit("manual"), key).alias("asset_id"))
    return M.map_with_confidence(p.select("provider_id"), n.select(F.concat(F.lit("A"), key).alias("asset_id"), F.col("n_name").alias("symbol")), over)


_LEDGER = "l AS (SELECT o_orderpriority AS cohort, o_custkey AS ticker, CASE WHEN o_orderkey % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS side, CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE 'CLOSED' END AS status FROM orders)"


def _ledger(spark, sf):
    o = panel.read(spark, sf, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, "SHORT").otherwise("LONG").alias("side")
    return o.select(F.col("o_orderpriority").alias("cohort"), F.col("o_custkey").alias("ticker"), side, F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status"))


@query(f"WITH {_LEDGER}, w AS (SELECT DISTINCT '1-URGENT' AS cohort, ticker, side FROM l) SELECT cohort, ticker, side FROM w WHERE EXISTS (SELECT 1 FROM l WHERE l.cohort = w.cohort AND l.ticker = w.ticker AND l.side = w.side AND status = 'OPEN')")
def has_open(spark, sf):
    x = _ledger(spark, sf)
    return L.has_open(x, x.select(F.lit("1-URGENT").alias("cohort"), "ticker", "side").distinct())


@query("""SELECT o_orderkey, round(1000.0 / o_totalprice, 8) AS quantity, round(o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1.15 ELSE 0.85 END, 4) AS stop_price_usd, CAST(o_orderdate AS DATE) + 45 AS exit_date_target_utc, 'OPEN' AS status FROM orders""")
def trade_rows(spark, sf):
    o = panel.read(spark, sf, "orders")
    side = F.when(F.col("o_orderkey") % 2 == 0, "SHORT").otherwise("LONG").alias("side")
    x = L.trade_rows(o.select("o_orderkey", side, F.col("o_totalprice").cast("double").alias("entry_price_usd"), F.lit(1000.0).alias("notional_usd"), F.to_date("o_orderdate").alias("entry_date_utc")), 0.15, 45)
    return x.select("o_orderkey", rnd("quantity", 8).alias("quantity"), rnd("stop_price_usd", 4).alias("stop_price_usd"), "exit_date_target_utc", "status")


@query(f"WITH {P2} SELECT asset_id, date, row_number() OVER (PARTITION BY asset_id ORDER BY date) > 60 AS valid FROM p2")
def burn_in(spark, sf):
    return p2(spark, sf).select("asset_id", "date", Q.burn_in(60, "asset_id").alias("valid"))


@query("SELECT o_orderpriority, o_orderstatus, GROUPING(o_orderpriority) * 2 + GROUPING(o_orderstatus) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_totals(spark, sf):
    g = panel.read(spark, sf, "orders").cube("o_orderpriority", "o_orderstatus")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, o_orderstatus, GROUPING(o_orderpriority) * 2 + GROUPING(o_orderstatus) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_totals(spark, sf):
    g = panel.read(spark, sf, "orders").rollup("o_orderpriority", "o_orderstatus")
    return g.agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), rnd(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderpriority, o_orderstatus, year(o_orderdate) AS year, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority, year(o_orderdate)), (o_orderstatus), ())")
def grouping_sets(spark, sf):
    o = panel.read(spark, sf, "orders").withColumn("year", F.year("o_orderdate").cast("long"))
    keys = [F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("year")]
    return o.groupingSets([[keys[0], keys[2]], [keys[1]], []], *keys).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MKT}, l AS (SELECT CASE WHEN r_major > 0.05 THEN 'Green' WHEN r_major > -0.05 THEN 'Yellow' WHEN r_major IS NOT NULL THEN 'Red' END AS label, r_alts / 100 AS y FROM mkt) SELECT label, count(*) AS n, round(avg(y), 6) AS mean, round(median(y), 6) AS median, round(stddev_samp(y), 6) AS std, round(avg(CASE WHEN y < 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(exp(sum(ln(1 + y))) - 1, 4) AS compounded FROM l WHERE label IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def label_summary(spark, sf):
    from ..operators import stats

    m = mkt(spark, sf).select(F.when(F.col("r_major") > 0.05, "Green").when(F.col("r_major") > -0.05, "Yellow").when(F.col("r_major").isNotNull(), "Red").alias("label"), (F.col("r_alts") / 100).alias("y"))
    return stats.label_summary(m, "label", "y").select("label", "n", *(rnd(c).alias(c) for c in ("mean", "median", "std", "hit_rate")), rnd("compounded", 4).alias("compounded"))


@query("WITH d AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1), e AS (SELECT max(date) AS e FROM d), m AS (SELECT avg(n) AS a, stddev_pop(n) AS b, avg(mean) AS c, stddev_pop(mean) AS f FROM d, e WHERE date < e) SELECT date, n, mean, CASE WHEN date = e THEN round((n - a) / nullif(b, 0), 4) END AS z_n, CASE WHEN date = e THEN round((mean - c) / nullif(f, 0), 4) END AS z_mean FROM d, e, m")
def append_day_features(spark, sf):
    """A stored history of daily features; the newest day comes with its z-scores against it and is appended, once however often the job runs."""
    from ..sources import shared
    from ..sources.versioned import VersionedTable

    d = panel.read(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("mean"))
    last = d.agg(F.max("date")).first()[0]
    t = VersionedTable(spark, shared.folder(spark, "features"), ["date"], buckets=4)
    t.append(d.where(F.col("date") < F.lit(last)), "history")
    for _ in range(2):
        z = V.z_of_day(d.where(F.col("date") == F.lit(last)), t.read(), ["n", "mean"])
        t.append(z.withColumns({"z_n": rnd("z_n", 4), "z_mean": rnd("z_mean", 4)}), f"day:{last}")
    return t.read()


@query("SELECT l_returnflag, TRUE AS distinct_close, TRUE AS median_close FROM lineitem GROUP BY 1")
def sketches(spark, sf):
    """Approximate distinct count (5 % asked for) and quantile, held against the exact ones within three times the error asked for."""
    li = panel.read(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice")
    x = li.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey", 0.05).alias("a"), F.percentile_approx("l_extendedprice", 0.5, 1000).alias("q"))
    # apart from the sketches, which an aggregate with an exact distinct count would build for each flag and order
    e = li.select("l_returnflag", "l_orderkey").distinct().groupBy(F.col("l_returnflag").alias("f")).agg(F.count("l_orderkey").alias("e"))
    x = x.join(e, F.col("l_returnflag").eqNullSafe(F.col("f"))).select(F.col("f"), "a", "e", "q")
    rank = F.avg((F.col("l_extendedprice") <= F.col("q")).cast("double"))
    y = li.join(F.broadcast(x), F.col("l_returnflag").eqNullSafe(F.col("f"))).groupBy("l_returnflag").agg(rank.alias("rank"), F.first("a").alias("a"), F.first("e").alias("e"))
    return y.select("l_returnflag", (F.abs(F.col("a") - F.col("e")) <= 0.15 * F.col("e")).alias("distinct_close"), (F.abs(F.col("rank") - 0.5) <= 0.01).alias("median_close"))


@query(f"WITH {P1} SELECT asset_id, date, round(close, 6) AS value FROM p1")
def payload_facts(spark, sf):
    ms = F.unix_millis(F.col("date").cast("timestamp")).cast("double")
    points = p1(spark, sf).select("asset_id", F.array(ms + 3.6e6, "close").alias("p"), F.array(ms, F.lit(-1.0)).alias("early"))
    sent = points.groupBy("asset_id").agg(F.to_json(F.concat(F.collect_list("p"), F.collect_list("early"))).alias("payload"))
    return catalog.facts_from_payloads(sent).select("asset_id", "date", rnd("value").alias("value"))


@query(f"WITH {P3}, a AS (SELECT asset_id, date, close FROM p3), c AS (SELECT asset_id, date, 100.0 * sum(ln(close)) OVER (PARTITION BY asset_id ORDER BY date) AS x, sum(close) OVER (PARTITION BY asset_id ORDER BY date) AS s FROM a) SELECT asset_id, date, round(exp(x / 100000.0), 5) AS compounded, round(s, 4) AS additive FROM c")
def additive_and_compounded(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("asset_id").orderBy("date")
    x = p3(spark, sf).select("asset_id", "date", F.sum(F.ln("close")).over(w).alias("l"), F.sum("close").over(w).alias("s"))
    return x.select("asset_id", "date", rnd(F.exp(F.col("l") / 1000.0), 5).alias("compounded"), rnd("s", 4).alias("additive"))
