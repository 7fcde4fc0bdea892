"""Queries of statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import market
from ..operators import statistics as T
from ..operators import windows as W
from .aggregates import R1, r1
from .registry import MKT, P2, mkt, p2, p3, query, rnd

_J = f"{R1}, m AS (SELECT date, avg(r) AS mk, avg(r) FILTER (WHERE asset_id % 2 = 0) AS mk2 FROM r1 GROUP BY date), j AS (SELECT r1.asset_id, r1.date, r, mk, mk2 FROM r1 JOIN m ON m.date = r1.date)"


def joined(spark, sf):
    r = r1(spark, sf).select("asset_id", "date", "r")
    m = r.groupBy("date").agg(F.avg("r").alias("mk"), F.avg(F.when(F.col("asset_id") % 2 == 0, F.col("r"))).alias("mk2"))
    return r.join(m, "date")


@query(f"WITH {_J} SELECT asset_id, round(regr_slope(r, mk), 6) AS beta, CAST(regr_count(r, mk) AS BIGINT) AS n FROM j GROUP BY asset_id HAVING regr_count(r, mk) >= 20")
def beta_ols(spark, sf):
    return T.beta(joined(spark, sf), "asset_id", "r", "mk").select("asset_id", rnd("beta").alias("beta"), F.col("n").cast("long").alias("n"))


@query(f"""WITH {_J}, q AS (SELECT asset_id, quantile_cont(r, 0.05) AS l1, quantile_cont(r, 0.95) AS h1, quantile_cont(mk, 0.05) AS l2, quantile_cont(mk, 0.95) AS h2, quantile_cont(mk2, 0.05) AS l3, quantile_cont(mk2, 0.95) AS h3 FROM j GROUP BY 1),
w AS (SELECT j.asset_id, greatest(l1, least(h1, r)) AS y, greatest(l2, least(h2, mk)) AS a, greatest(l3, least(h3, mk2)) AS b FROM j JOIN q ON q.asset_id = j.asset_id WHERE r IS NOT NULL AND mk IS NOT NULL AND mk2 IS NOT NULL),
s AS (SELECT asset_id, count(*) AS n, covar_pop(a, a) * count(*) + 0.1 AS aa, covar_pop(a, b) * count(*) AS ab, covar_pop(b, b) * count(*) + 0.1 AS bb, covar_pop(a, y) * count(*) AS ay, covar_pop(b, y) * count(*) AS b_y FROM w GROUP BY 1)
SELECT asset_id, n, round(CASE WHEN n < 20 THEN 1 ELSE greatest(0, least(3, (bb * ay - ab * b_y) / (aa * bb - ab * ab))) END, 5) AS beta1, round(CASE WHEN n < 20 THEN 1 ELSE greatest(0, least(3, (aa * b_y - ab * ay) / (aa * bb - ab * ab))) END, 5) AS beta2 FROM s""")
def beta_ridge(spark, sf):
    d = T.winsorized(joined(spark, sf), ["asset_id"], ["r", "mk", "mk2"])
    return T.ridge_betas(d, "asset_id", "r", "mk", "mk2", least=20).select("asset_id", "n", rnd("beta1", 5).alias("beta1"), rnd("beta2", 5).alias("beta2"))


@query(f"""WITH {MKT}, f AS (SELECT regr_intercept(r_alts, r_major) AS a, regr_slope(r_alts, r_major) AS b, regr_count(r_alts, r_major) AS n FROM mkt WHERE date - DATE '1998-06-01' BETWEEN -180 AND -60), x AS (SELECT date, r_alts - (CASE WHEN n < 30 THEN 0 ELSE a END + CASE WHEN n < 30 THEN 1 ELSE b END * r_major) AS ar FROM mkt, f WHERE date - DATE '1998-06-01' > -60)
SELECT date, round(ar, 6) AS ar, round(sum(ar) OVER (ORDER BY date), 6) AS car FROM x""")
def market_model_car(spark, sf):
    return T.market_model(mkt(spark, sf), "series", "date", "r_alts", "r_major", "1998-06-01").select("date", rnd("ar").alias("ar"), rnd("car").alias("car"))


@query(f"WITH {MKT}, g AS (SELECT regr_slope(r_alts, r_major) AS b, regr_intercept(r_alts, r_major) AS a, regr_r2(r_alts, r_major) AS r2, CAST(regr_count(r_alts, r_major) AS BIGINT) AS n, regr_sxx(r_alts, r_major) AS sxx, regr_syy(r_alts, r_major) AS syy FROM mkt) SELECT round(b, 6) AS slope, round(a, 6) AS intercept, round(r2, 6) AS r2, n, round(b / sqrt((1 - r2) * syy / ((n - 2) * sxx)), 5) AS t FROM g")
def linreg(spark, sf):
    x = T.linear_fit(mkt(spark, sf), ["series"], "r_alts", "r_major")
    return x.select(rnd("slope").alias("slope"), rnd("intercept").alias("intercept"), rnd("r2").alias("r2"), F.col("n").cast("long").alias("n"), rnd("t", 5).alias("t"))


@query(f"""WITH {MKT}, g AS (SELECT CASE WHEN r > 0 THEN 'up' ELSE 'down' END AS g, r_alts, r_major FROM mkt WHERE r_alts IS NOT NULL AND r_major IS NOT NULL), k AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY r_alts) + (count(*) OVER (PARTITION BY g, r_alts) - 1) / 2.0 AS x, rank() OVER (PARTITION BY g ORDER BY r_major) + (count(*) OVER (PARTITION BY g, r_major) - 1) / 2.0 AS y FROM g)
SELECT g, round(corr(x, y), 6) AS spearman, round(corr(r_alts, r_major), 6) AS pearson, count(*) AS n FROM k GROUP BY g""")
def spearman(spark, sf):
    d = mkt(spark, sf).withColumn("g", F.when(F.col("r") > 0, "up").otherwise("down"))
    return T.spearman(d, ["g"], "r_alts", "r_major").select("g", rnd("spearman").alias("spearman"), rnd("pearson").alias("pearson"), "n")


_REG = f"{MKT}, g AS (SELECT date, CASE WHEN r_major > 0.3 THEN 'GREEN' WHEN r_major < -0.3 THEN 'RED' ELSE 'YELLOW' END AS g, lead(r_alts) OVER (ORDER BY date) AS f FROM mkt)"


def regimes(spark, sf):
    g = F.when(F.col("r_major") > 0.3, "GREEN").when(F.col("r_major") < -0.3, "RED").otherwise("YELLOW")
    return mkt(spark, sf).select("series", "date", g.alias("g"), F.lead("r_alts").over(W.by("series")).alias("f")).where("f is not null")


@query(f"WITH {_REG}, t AS (SELECT g, count(f) AS n, avg(f) AS m, stddev_samp(f) AS s, avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END) AS hit FROM g WHERE f IS NOT NULL GROUP BY g) SELECT g, n, round(m, 6) AS mean, round(s, 6) AS std, round(hit, 6) AS hit, round(m / (s / sqrt(n)), 5) AS t FROM t")
def regime_stats_t(spark, sf):
    x = T.group_test(regimes(spark, sf), "g", "f")
    return x.select("g", "n", rnd("mean").alias("mean"), rnd("std").alias("std"), rnd("hit").alias("hit"), rnd("t", 5).alias("t"))


@query()
def regime_p_values(spark, sf):
    return T.with_p(T.group_test(regimes(spark, sf), "g", "f")).select("g", "n", rnd("t", 5).alias("t"), rnd("p").alias("p"))


@query(f"WITH {_REG} SELECT round(avg(f) FILTER (WHERE g = 'GREEN') - avg(f), 6) AS edge_best, round(avg(f) FILTER (WHERE g = 'RED') - avg(f), 6) AS edge_worst, round(avg(f) FILTER (WHERE g = 'GREEN') - avg(f) FILTER (WHERE g = 'RED'), 6) AS spread, count(f) AS n FROM g WHERE f IS NOT NULL")
def edges(spark, sf):
    x = T.edges(regimes(spark, sf), "g", "f", "GREEN", "RED")
    return x.select(*(rnd(c).alias(c) for c in ("edge_best", "edge_worst", "spread")), "n")


@query(f"WITH {MKT}, d AS (SELECT abs(r) AS x, sign(r) AS s FROM mkt WHERE r <> 0), k AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS k FROM d) SELECT round(sum(k * s), 2) AS w, round(sum(k * s) / sqrt(sum(k * k)), 5) AS z, count(*) AS n FROM k")
def wilcoxon(spark, sf):
    return T.wilcoxon(mkt(spark, sf), "r").select(rnd("w", 2).alias("w"), rnd("z", 5).alias("z"), "n")


@query()
def bootstrap(spark, sf):
    means = T.block_bootstrap(mkt(spark, sf), "date", "r")
    return T.bootstrap_interval(means, 0.05).select(*(rnd(c).alias(c) for c in ("lo", "hi", "p")))


_TH = f"{MKT}, t AS (SELECT (i - 1) / 50.0 AS q, CAST(i - 1 AS INTEGER) AS i, th FROM (SELECT unnest(range(1, 52)) AS i, unnest(quantile_cont(r_major, {[i / 50 for i in range(51)]})) AS th FROM mkt))"


@query(f"WITH {_TH} SELECT i, round(th, 6) AS threshold, round(exp(sum(ln(1 + r_alts / 100)) FILTER (WHERE r_major >= th)) - 1, 4) AS above, round(exp(sum(ln(1 + r_alts / 100)) FILTER (WHERE r_major < th)) - 1, 4) AS below, count(*) FILTER (WHERE r_major >= th) AS n_above FROM mkt, t GROUP BY i, th")
def sweep(spark, sf):
    d = mkt(spark, sf).withColumn("x", F.col("r_alts") / 100)
    x = T.threshold_sweep(d, "r_major", "x")
    return x.select("i", rnd("threshold").alias("threshold"), rnd("above", 4).alias("above"), rnd("below", 4).alias("below"), "n_above")


@query(f"WITH {MKT} SELECT count(*) AS n, round(avg(abs(r_major - r_alts)), 6) AS mae, round(avg(abs(r_major - r_alts) / nullif(abs(r_alts), 0)), 4) AS mape, round(max(abs(r_major - r_alts)), 6) AS worst, round(corr(r_major, r_alts), 6) AS corr FROM mkt WHERE r_major IS NOT NULL AND r_alts IS NOT NULL")
def series_error(spark, sf):
    m = mkt(spark, sf)
    a, b = m.where("r_major is not null").select("date", "r_major"), m.where("r_alts is not null").select("date", "r_alts")
    x = T.series_error(a, b, "date", "r_major", "r_alts")
    return x.select("n", rnd("mae").alias("mae"), rnd("mape", 4).alias("mape"), rnd("worst").alias("worst"), rnd("corr").alias("corr"))


@query(f"WITH {R1}, b AS (SELECT asset_id % 10 AS bucket, avg(r) AS m FROM r1 GROUP BY 1), n AS (SELECT m, lead(m) OVER (ORDER BY bucket) AS nx FROM b) SELECT count(*) FILTER (WHERE nx < m) AS inversions, count(nx) AS pairs FROM n")
def bucket_inversions(spark, sf):
    b = r1(spark, sf).groupBy((F.col("asset_id") % 10).alias("bucket")).agg(F.avg("r").alias("m"))
    return T.inversions(b, "bucket", "m")


def _basket(spark, sf):
    return r1(spark, sf).where("r is not null").select(F.lit("all").alias("basket"), "asset_id", "date", "r")


def _matrix(method):
    def run(spark, sf):
        return market.matrix(_basket(spark, sf), "basket", "asset_id", "date", "r", method).withColumn("value", rnd("value"))

    return run


@query()
def cov_shrink(spark, sf):
    """The whole matrix, each pair of assets once."""
    return market.covariance(_basket(spark, sf), "basket", "asset_id", "date", "r", lambda v: np.round(v + 1e-8, 6))  # as `rnd`, on blocks


for _name, _method in (("pca1", "pca"), ("minvar_qp", "minvar"), ("clusters", "cluster")):
    query(None, _name)(_matrix(_method))


@query()
def long_short_baskets(spark, sf):
    """One basket a quarter: the quarter's returns are the lookback."""
    d = r1(spark, sf).where("r is not null").select(F.to_date(F.date_trunc("quarter", "date")).alias("rebalance_date"), "asset_id", "date", "r")
    return T.long_short_baskets(d, "rebalance_date", "asset_id", "date", "r", n=5, least=10, cap=0.2).withColumn("weight", rnd("weight"))


@query(f"""WITH {R1}, s AS (SELECT asset_id, stddev_samp(r) AS vol FROM r1 GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY vol NULLS FIRST, asset_id) AS k FROM s WHERE vol IS NOT NULL) SELECT asset_id, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 15""")
def basket_minvar_rank(spark, sf):
    s = r1(spark, sf).groupBy("asset_id").agg(F.stddev_samp("r").alias("vol")).where("vol is not null").withColumn("b", F.lit("all"))
    return T.select_basket(s, "b", "asset_id", "minvar").select("asset_id", "rank")


@query("""WITH p AS (SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem GROUP BY 1, 2), r AS (SELECT asset_id, date, CAST(date_trunc('quarter', date) AS DATE) AS rebalance_date, close / lag(close) OVER (PARTITION BY asset_id ORDER BY date) - 1 AS r FROM p),
d AS (SELECT *, dense_rank() OVER (PARTITION BY rebalance_date ORDER BY date DESC) AS d FROM r WHERE r IS NOT NULL), s AS (SELECT rebalance_date, asset_id, stddev_samp(r) AS vol, avg(r) FILTER (WHERE d <= 30) AS mu, count(r) AS n FROM d GROUP BY 1, 2),
v AS (SELECT rebalance_date, asset_id, 'minvar_rank' AS method, CASE WHEN vol > 0 THEN vol END AS v, CASE WHEN vol > 0 THEN vol END AS o FROM s UNION ALL SELECT rebalance_date, asset_id, 'momentum_rank', mu, CASE WHEN vol > 0 THEN vol END FROM s UNION ALL SELECT rebalance_date, asset_id, 'random', CASE WHEN n >= 20 THEN CAST('0x' || substr(md5(rebalance_date || ':' || asset_id), 1, 12) AS BIGINT)::DOUBLE END, CASE WHEN vol > 0 THEN vol END FROM s),
x AS (SELECT *, CASE WHEN count(v) OVER (PARTITION BY rebalance_date, method) >= 30 THEN v ELSE o END AS x FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date, method ORDER BY x, asset_id) AS k, count(*) OVER (PARTITION BY rebalance_date, method) AS c FROM x WHERE x IS NOT NULL)
SELECT rebalance_date, method, asset_id, CASE WHEN k <= 15 THEN round(0.5 / 15, 6) ELSE round(-0.5 / 15, 6) END AS weight FROM k WHERE c >= 30 AND (k <= 15 OR k > c - 15)""")
def rank_baskets(spark, sf):
    """15 and 15 of each quarter by three rules; the quarter's returns are the lookback."""
    r = p3(spark, sf).withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("asset_id").orderBy("date")) - 1).where("r is not null")
    d = r.select(F.to_date(F.date_trunc("quarter", "date")).alias("rebalance_date"), "asset_id", "date", "r")
    return T.rank_sides(d, "rebalance_date", "asset_id", "date", "r").withColumn("weight", rnd("weight"))


@query(f"WITH {P2} SELECT asset_id, round(median(marketcap), 4) AS mcap, round(median(volume), 4) AS volume FROM p2 GROUP BY 1 HAVING median(volume) >= 1")
def universe_qc(spark, sf):
    g = p2(spark, sf).groupBy("asset_id").agg(F.percentile("marketcap", 0.5).alias("mcap"), F.percentile("volume", 0.5).alias("volume")).where("volume >= 1")
    return g.select("asset_id", rnd("mcap", 4).alias("mcap"), rnd("volume", 4).alias("volume"))
