"""Queries of backtests, indices and portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import asof, backtest, portfolio
from ..operators import windows as W
from ..sources import panel
from .features import scored
from .registry import MKT, P2, P3, SNAP, mkt, p2, p3, query, rnd, snap

_RET = f"""{P3}, ret AS (SELECT asset_id, date, CASE WHEN x IS NOT NULL THEN greatest(-0.5, least(0.5, x)) / 10 END AS r FROM (SELECT asset_id, date, close / nullif(lag(close) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1 AS x FROM p3)),
dts AS (SELECT rebalance_date, lead(rebalance_date) OVER (ORDER BY rebalance_date) AS nxt FROM (SELECT DISTINCT rebalance_date FROM snap)),
held AS (SELECT date, rebalance_date FROM (SELECT DISTINCT date FROM ret) d JOIN dts ON date > rebalance_date AND date <= coalesce(nxt, DATE '9999-12-31'))"""
_BASK = """bas AS (SELECT h.date, h.rebalance_date, sum(s.weight) AS w, coalesce(sum(s.weight) FILTER (WHERE r IS NOT NULL), 0) AS covered, sum(s.weight * r) AS s, count(*) AS n FROM held h JOIN snap s ON s.rebalance_date = h.rebalance_date LEFT JOIN ret ON ret.date = h.date AND ret.asset_id = s.asset_id GROUP BY 1, 2)"""
_TURN = """ti AS (SELECT *, dense_rank() OVER (ORDER BY rebalance_date) AS i FROM snap), tp AS (SELECT i + 1 AS i, asset_id, weight AS w0 FROM ti), tb AS (SELECT coalesce(a.i, b.i) AS i, weight, w0 FROM ti a FULL JOIN tp b ON b.i = a.i AND b.asset_id = a.asset_id),
tt AS (SELECT i, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) AS t FROM tb GROUP BY i), cost AS (SELECT rebalance_date, CASE WHEN tt.i = 1 THEN 1.0 ELSE t * {0} END AS t FROM tt JOIN (SELECT DISTINCT i, rebalance_date FROM ti) d ON d.i = tt.i)"""


def returns(spark, sf):
    r = W.simple_return("close", W.by())
    return p3(spark, sf).select("asset_id", "date", (C.clamp(r, -0.5, 0.5) / 10).alias("r"))


@query(f"WITH {SNAP}, {_RET}, {_BASK} SELECT date, rebalance_date, CASE WHEN covered >= 0.1 * w THEN round(coalesce(s, 0) / w, 6) END AS r_nan, round(s / nullif(covered, 0), 6) AS r_renorm, round(coalesce(s, 0) / w, 6) AS r_zero, n FROM bas")
def basket_policies(spark, sf):
    r, s = returns(spark, sf), snap(spark, sf)
    get = lambda p, c: backtest.basket_returns(r, s, p, 0.1).select("date", rnd("r_basket").alias(c))
    a = backtest.basket_returns(r, s, "nan", 0.1).select("date", "rebalance_date", rnd("r_basket").alias("r_nan"), "n")
    return a.join(get("renormalize", "r_renorm"), "date").join(get("conservative_zero", "r_zero"), "date")


@query(f"""WITH {SNAP}, {_RET}, {_BASK}, {_TURN.format('0.5')}, {MKT.replace(P2, P2)}, j AS (SELECT bas.date, bas.rebalance_date, r_major / 500 AS m, coalesce(s, 0) / w AS b, CASE WHEN row_number() OVER (PARTITION BY bas.rebalance_date ORDER BY bas.date) = 1 THEN t * 0.001 ELSE 0 END AS c FROM bas JOIN cost ON cost.rebalance_date = bas.rebalance_date LEFT JOIN mkt ON mkt.date = bas.date)
SELECT date, rebalance_date, round(m, 6) AS r_major, round(b, 6) AS r_basket, round(c, 6) AS cost, round(m - b - c, 6) AS r_net, round(exp(sum(ln(1 + coalesce(m - b - c, 0))) OVER (ORDER BY date)), 5) AS equity FROM j""")
def ls_engine(spark, sf):
    major = mkt(spark, sf).select("date", (F.col("r_major") / 500).alias("r_major"))
    x = backtest.long_short(returns(spark, sf), snap(spark, sf), major, "conservative_zero")
    return x.select("date", "rebalance_date", rnd("r_major").alias("r_major"), rnd("r_basket").alias("r_basket"), rnd("cost").alias("cost"), rnd("r_net").alias("r_net"), rnd("equity", 5).alias("equity"))


_SIGN = "snap0x AS (SELECT 1), sg AS (SELECT rebalance_date, asset_id, CASE WHEN rank % 2 = 0 THEN -weight ELSE weight END AS weight FROM snap)"


@query(f"""WITH {SNAP}, {_RET}, {_SIGN}, {_TURN.format('1.0').replace('FROM snap)', 'FROM sg)')}, g AS (SELECT h.date, h.rebalance_date, coalesce(sum(weight * r) FILTER (WHERE weight > 0), 0) AS l, coalesce(sum(weight * r) FILTER (WHERE weight < 0), 0) AS s, sum(abs(weight)) AS gross FROM held h JOIN sg ON sg.rebalance_date = h.rebalance_date JOIN ret ON ret.date = h.date AND ret.asset_id = sg.asset_id GROUP BY 1, 2)
SELECT g.date, g.rebalance_date, round(l, 6) AS long_pnl, round(s, 6) AS short_pnl, round(gross, 6) AS gross, round(CASE WHEN row_number() OVER (PARTITION BY g.rebalance_date ORDER BY g.date) = 1 THEN t * 0.0005 ELSE 0 END, 6) AS cost FROM g JOIN cost ON cost.rebalance_date = g.rebalance_date""")
def basket_pnl(spark, sf):
    s = snap(spark, sf).withColumn("weight", F.when(F.col("rank") % 2 == 0, -F.col("weight")).otherwise(F.col("weight")))
    x = backtest.basket_pnl(returns(spark, sf), s)
    return x.select("date", "rebalance_date", *(rnd(c).alias(c) for c in ("long_pnl", "short_pnl", "gross", "cost")))


@query(f"""WITH {MKT}, {SNAP}, t AS (SELECT date, r_alts / 50 AS r, CASE WHEN r_major > 0 THEN 0.5 ELSE -0.5 END AS w FROM mkt WHERE r_alts IS NOT NULL), d AS (SELECT *, w - coalesce(lag(w) OVER (ORDER BY date), 0) AS dw FROM t)
SELECT date, round(w * r, 8) AS gross, round(abs(dw) * 0.0006, 8) AS cost, round(-w * 0.0001 * 3, 8) AS funding, round(w * r - abs(dw) * 0.0006 - w * 0.0001 * 3, 8) AS net FROM d""")
def daily_pnl_costs(spark, sf):
    t = mkt(spark, sf).where("r_alts is not null").select("series", "date", (F.col("r_alts") / 50).alias("r"), F.when(F.col("r_major") > 0, 0.5).otherwise(-0.5).alias("w"))
    x = portfolio.daily_pnl(t, "w", "r", F.lit(0.0001), fee=0.0004, slippage=0.0002)
    return x.select("date", *(rnd(c, 8).alias(c) for c in ("gross", "cost", "funding", "net")))


@query(f"""WITH {P2}, b AS (SELECT date, close AS b FROM p2 WHERE asset_id = '1-URGENT'), w(asset_id, weight) AS (VALUES ('2-HIGH', 0.4), ('3-MEDIUM', 0.3), ('4-NOT SPECIFIED', 0.2), ('5-LOW', 0.1)), g AS (SELECT b.date, sum(weight * b / nullif(close, 0)) AS s, sum(weight) AS w FROM b JOIN p2 ON p2.date = b.date AND p2.asset_id <> '1-URGENT' JOIN w ON w.asset_id = p2.asset_id GROUP BY 1)
SELECT date, CASE WHEN w >= 0.6 * 1.0 THEN round(s / w, 6) END AS level FROM g""")
def index_fixed_weight(spark, sf):
    w = spark.createDataFrame([("2-HIGH", 0.4), ("3-MEDIUM", 0.3), ("4-NOT SPECIFIED", 0.2), ("5-LOW", 0.1)], "asset_id string, weight double")
    return backtest.fixed_weight_index(p2(spark, sf), w, "1-URGENT", 0.6).withColumn("level", rnd("level"))


_ONE = 10**12


@query(f"""WITH RECURSIVE {P2}, q AS (SELECT min(date) AS rd FROM p2 GROUP BY date_trunc('quarter', date)), px AS (SELECT asset_id, date, CAST(floor(close * 1000000 + 0.501) AS HUGEINT) AS p, CAST(floor(marketcap * 100 + 0.501) AS HUGEINT) AS m FROM p2),
w0 AS (SELECT rd, asset_id, p AS p0, m FROM px JOIN q ON date = rd WHERE p > 0), w AS (SELECT rd, asset_id, p0, m * {_ONE} // CAST(sum(m) OVER (PARTITION BY rd) AS HUGEINT) AS w FROM w0),
dates AS (SELECT rd, lead(rd) OVER (ORDER BY rd) AS nx FROM q), days AS (SELECT DISTINCT date, rd FROM px JOIN dates ON date >= rd AND date <= coalesce(nx, DATE '9999-12-31')),
rel AS (SELECT rd, date, asset_id, greatest({_ONE * 7 // 10}, least({_ONE * 13 // 10}, p * {_ONE} // p0)) AS r FROM days JOIN px USING (date) JOIN w USING (rd, asset_id)),
grid AS (SELECT d.rd, d.date, w.asset_id, w.w FROM (SELECT DISTINCT rd, date FROM rel) d JOIN w USING (rd)),
filled AS (SELECT rd, date, w, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY rd, asset_id ORDER BY date), {_ONE}) AS r FROM grid LEFT JOIN rel USING (rd, asset_id, date)),
day AS (SELECT rd, date, CAST(sum(w * r) AS HUGEINT) // {_ONE} AS rel FROM filled GROUP BY 1, 2), ends AS (SELECT rd, arg_max(rel, date) AS e, row_number() OVER (ORDER BY rd) AS k FROM day GROUP BY rd),
acc(k, base) AS (SELECT CAST(1 AS BIGINT), CAST({_ONE} AS HUGEINT) UNION ALL SELECT acc.k + 1, base * e // {_ONE} FROM acc JOIN ends ON ends.k = acc.k)
SELECT date, rd AS rebalance_date, round(CAST(1000 * (base * rel // {_ONE}) AS DOUBLE) / {_ONE}, 6) AS level FROM day JOIN ends USING (rd) JOIN acc ON acc.k = ends.k QUALIFY row_number() OVER (PARTITION BY date ORDER BY rd DESC) = 1""")
def index_chain(spark, sf):
    first = p2(spark, sf).groupBy(F.to_date(F.date_trunc("quarter", "date")).alias("q")).agg(F.min("date").alias("rebalance_date"))
    w = p2(spark, sf).join(first, F.col("date") == F.col("rebalance_date")).select("rebalance_date", "asset_id", F.col("marketcap").alias("weight"))
    return backtest.chained_index(p2(spark, sf), w).withColumn("level", rnd(F.col("level").cast("double")))


@query()
def risk_engine(spark, sf):
    params = spark.createDataFrame([(1, 0.05, 0.1, 0.08, 0.01), (2, 0.1, 0.3, 0.15, 0.02)], "set_id long, stop double, take double, trail double, target double")
    d = scored(spark, sf).select("date", (F.col("r") / 50).alias("r"), F.col("s").alias("score"))
    return backtest.risk_engine(d, params).select("set_id", "date", *(rnd(c).alias(c) for c in ("exposure", "r_net", "equity")))


@query(f"""WITH {MKT}, l AS (SELECT asset_id, date, r FROM mret WHERE r IS NOT NULL), k AS (SELECT asset_id, date, rank() OVER (PARTITION BY date ORDER BY r) AS rank FROM l), best AS (SELECT date, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY rank DESC, asset_id) AS k FROM k) WHERE k = 1), g AS (SELECT date, r > 0 AS open FROM mkt), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM l))
SELECT d.date, best.asset_id, round(coalesce(l.r, 0), 6) AS r FROM d JOIN best ON best.date = d.prev JOIN g ON g.date = d.prev AND open LEFT JOIN l ON l.date = d.date AND l.asset_id = best.asset_id""")
def winner_takes_all(spark, sf):
    l = p2(spark, sf).withColumn("r", W.simple_return("close", W.by())).where("r is not null").select("asset_id", "date", "r")
    ranks = l.select("asset_id", "date", F.rank().over(Window.partitionBy("date").orderBy("r")).alias("rank"))
    x = backtest.winner_takes_all(ranks, l, mkt(spark, sf).select("date", (F.col("r") > 0).alias("open")))
    return x.select("date", "asset_id", rnd("r").alias("r"))


@query(f"WITH {MKT} SELECT date, round(r_major - r_alts, 6) AS ls FROM mkt")
def ls_equal_weight(spark, sf):
    return mkt(spark, sf).select("date", rnd(F.col("r_major") - F.col("r_alts")).alias("ls"))


@query(f"""WITH {MKT}, x AS (SELECT date, CAST(CASE WHEN r_major > 0.2 THEN 1.0 WHEN r_major > -0.2 THEN 0.5 ELSE 0 END AS DOUBLE) AS w, lead(r_alts) OVER (ORDER BY date) / 50 AS nxt FROM mkt)
SELECT date, w, round(w * nxt, 8) AS pnl, round(exp(sum(ln(1 + coalesce(w * nxt, 0))) OVER (ORDER BY date)), 6) AS equity FROM x""")
def regime_sized(spark, sf):
    w = W.by("series")
    x = mkt(spark, sf).withColumn("w", F.when(F.col("r_major") > 0.2, 1.0).when(F.col("r_major") > -0.2, 0.5).otherwise(0.0)).withColumn("p", F.col("w") * F.lead("r_alts").over(w) / 50)
    return x.select("date", "w", rnd("p", 8).alias("pnl"), rnd(W.equity("p", w)).alias("equity"))


_WEEKLY = """d AS (SELECT CAST(unnest(generate_series(DATE '1996-01-04', DATE '2000-12-21', INTERVAL 28 DAY)) AS DATE) AS decision_date), a AS (SELECT DISTINCT asset_id FROM p3), g AS (SELECT asset_id, decision_date, CAST(decision_date + INTERVAL 28 DAY AS DATE) AS next_date FROM a, d),
x AS (SELECT g.*, s.close AS c0, s.date AS d0 FROM g ASOF LEFT JOIN p3 s ON s.asset_id = g.asset_id AND s.date <= g.decision_date), y AS (SELECT x.*, e.close AS c1 FROM x ASOF LEFT JOIN p3 e ON e.asset_id = x.asset_id AND e.date <= x.next_date),
r AS (SELECT decision_date, asset_id, c1 / nullif(c0, 0) - 1 AS r FROM y WHERE d0 >= decision_date - 28)"""


@query(f"""WITH {P3}, {_WEEKLY}, w AS (SELECT decision_date, count(r) AS n_valid, avg(r) FILTER (WHERE asset_id % 10 <> 0) AS r_alts, avg(r) FILTER (WHERE asset_id % 10 = 0) AS r_maj FROM r GROUP BY 1)
SELECT decision_date, n_valid, round(r_alts, 6) AS r_alts, round(r_maj, 6) AS r_maj, round(CASE WHEN n_valid < 20 THEN 0 ELSE ln(1 + greatest(r_maj - r_alts, -0.99)) END, 6) AS y FROM w""")
def weekly_panel(spark, sf):
    p = p3(spark, sf)
    days = p.select("asset_id").distinct().withColumn("decision_date", F.explode(F.expr("sequence(date'1996-01-04', date'2000-12-21', interval 28 day)"))).withColumn("next_date", F.date_add("decision_date", 28))
    start = asof.backward(days, p.select("asset_id", "date", F.col("close").alias("c0"), F.col("date").alias("d0")), "decision_date", "date", ["asset_id"], ["d0", "c0"])
    both = asof.backward(start, p.select("asset_id", "date", F.col("close").alias("c1")), "next_date", "date", ["asset_id"], ["c1"])
    r = both.where(F.col("d0") >= F.date_sub("decision_date", 28)).withColumn("r", W.ratio(F.col("c1"), F.col("c0")) - 1)
    major = F.col("asset_id") % 10 == 0
    g = r.groupBy("decision_date").agg(F.count("r").alias("n_valid"), F.avg(F.when(~major, F.col("r"))).alias("r_alts"), F.avg(F.when(major, F.col("r"))).alias("r_maj"))
    y = F.when(F.col("n_valid") < 20, 0.0).otherwise(F.log1p(F.greatest(F.col("r_maj") - F.col("r_alts"), F.lit(-0.99))))
    return g.select("decision_date", "n_valid", rnd("r_alts").alias("r_alts"), rnd("r_maj").alias("r_maj"), rnd(y).alias("y"))


@query("SELECT round(sum(b * v), 2) AS beta_exposure, round(sum(abs(v)), 2) AS gross, round(sum(v), 2) AS net, round(sum(v) FILTER (WHERE v > 0), 2) AS long_total, round(sum(v) FILTER (WHERE v < 0), 2) AS short_total, round(max(abs(v)) / sum(abs(v)), 6) AS concentration, round(-sum(b * v), 2) AS hedge FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN -s_acctbal ELSE s_acctbal END AS v, 0.5 + (s_suppkey % 10) / 10.0 AS b FROM supplier)")
def portfolio_snapshot(spark, sf):
    s = panel.read(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, -F.col("s_acctbal")).otherwise(F.col("s_acctbal")).alias("notional"), (0.5 + (F.col("s_suppkey") % 10) / 10.0).alias("beta"))
    x = portfolio.snapshot(s)
    return x.select(*(rnd(c, 2).alias(c) for c in ("beta_exposure", "gross", "net", "long_total", "short_total")), rnd("concentration").alias("concentration"), rnd("hedge", 2).alias("hedge"))


@query("WITH b AS (SELECT s_nationkey AS k, sum(s_acctbal / 10000) AS alt, avg(0.5 + (s_suppkey % 10) / 10.0) AS beta FROM supplier GROUP BY 1) SELECT k, round(greatest(-1, least(1, -alt)), 6) AS dollar_first, round(greatest(-1, least(1, -alt * beta)), 6) AS beta_first FROM b")
def neutrality(spark, sf):
    s = panel.read(spark, sf, "supplier")
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.sum(F.col("s_acctbal") / 10000).alias("alt"), F.avg(0.5 + (F.col("s_suppkey") % 10) / 10.0).alias("beta"))
    return b.select("k", rnd(portfolio.neutral_weight(F.col("alt"), F.col("beta"), "dollar")).alias("dollar_first"), rnd(portfolio.neutral_weight(F.col("alt"), F.col("beta"), "beta")).alias("beta_first"))
