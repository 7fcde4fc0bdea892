"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as S
from ..operators import windows as W
from ..sources import panel
from .registry import MKT, P1, P2, P3, P4, SNAP, mkt, p1, p2, p3, p4, query, rnd, snap

R1 = f"{P1}, r1 AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1 AS r FROM p1)"
_BUCKET = "CAST(floor(close / 50) AS BIGINT)"


def r1(spark, sf):
    return p1(spark, sf).withColumn("r", W.simple_return("close", W.by()))


@query(f"WITH {P1} SELECT {_BUCKET} AS bucket, count(*) AS n, round(avg(volume), 4) AS mean, round(median(volume), 4) AS median, round(stddev_samp(volume), 4) AS std, round(min(volume), 4) AS lo, round(max(volume), 4) AS hi, round(sum(volume), 4) AS total FROM p1 GROUP BY 1")
def bucket_stats(spark, sf):
    g = p1(spark, sf).groupBy(F.floor(F.col("close") / 50).alias("bucket"))
    fs = {"mean": F.avg, "median": W.median, "std": F.stddev_samp, "lo": F.min, "hi": F.max, "total": F.sum}
    return g.agg(F.count(F.lit(1)).alias("n"), *(rnd(f(F.col("volume")), 4).alias(k) for k, f in fs.items()))


@query(f"WITH {P4}, d AS (SELECT asset_id, date, avg(rate) AS d FROM p4 WHERE date BETWEEN DATE '1998-03-01' AND DATE '1998-03-07' GROUP BY 1, 2), a AS (SELECT asset_id, avg(d) AS a FROM d GROUP BY 1), u AS (SELECT count(DISTINCT asset_id) AS u FROM p4) SELECT count(a) AS n, CASE WHEN count(a) * 100.0 / max(u) >= 10 THEN round(avg(a), 8) END AS mean FROM a, u")
def two_level_mean(spark, sf):
    d = p4(spark, sf)
    u = d.select("asset_id").distinct().count()
    x = S.two_level_mean(d.where("date between date'1998-03-01' and date'1998-03-07'"), "asset_id", "date", "rate", u, 10.0)
    return x.select("n", rnd("mean", 8).alias("mean"))


@query(f"WITH {P4} SELECT asset_id, date, round(avg(rate), 8) AS rate FROM p4 GROUP BY 1, 2")
def collapse_daily(spark, sf):
    return p4(spark, sf).groupBy("asset_id", "date").agg(rnd(F.avg("rate"), 8).alias("rate"))


@query(f"WITH {P4} SELECT date, round(coalesce(sum(rate * weight) / nullif(sum(weight), 0), avg(rate)), 8) AS f FROM p4 GROUP BY date")
def weighted_mean(spark, sf):
    return p4(spark, sf).groupBy("date").agg(rnd(S.weighted_mean("rate", "weight"), 8).alias("f"))


@query(f"WITH {R1} SELECT date, round(sum(r * marketcap) / nullif(sum(marketcap), 0), 6) AS r FROM r1 GROUP BY date")
def cap_weighted_ret(spark, sf):
    return r1(spark, sf).groupBy("date").agg(rnd(S.cap_weighted("r", "marketcap")).alias("r"))


@query(f"WITH {R1} SELECT date, round(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / count(*) * 100, 6) AS breadth, round(median(r), 6) AS median FROM r1 GROUP BY date")
def breadth(spark, sf):
    return r1(spark, sf).groupBy("date").agg(rnd(S.breadth("r")).alias("breadth"), rnd(F.percentile("r", 0.5)).alias("median"))


_K = "k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY {0}) AS k, count(*) OVER (PARTITION BY date) AS n FROM {1} WHERE {0} IS NOT NULL)"


@query(f"WITH {R1}, {_K.format('r', 'r1')} SELECT date, round(max(r) FILTER (WHERE k - 1 = floor((n - 1) * 0.75 + 0.5)) - max(r) FILTER (WHERE k - 1 = floor((n - 1) * 0.25 + 0.5)), 6) AS iqr FROM k GROUP BY date")
def iqr_nearest(spark, sf):
    return S.iqr_nearest(r1(spark, sf), ["date"], "r").withColumn("iqr", rnd("iqr"))


@query(f"WITH {P4}, {_K.format('rate', 'p4')} SELECT date, round(avg(rate), 8) AS mean FROM k WHERE k > floor(n / 4) AND k <= n - floor(n / 4) GROUP BY date")
def iqm(spark, sf):
    return S.interquartile_mean(p4(spark, sf), ["date"], "rate").withColumn("mean", rnd("mean", 8))


@query(f"WITH {P4}, {_K.format('rate', 'p4')} SELECT date, CASE WHEN max(n) >= 4 THEN round(max(rate) FILTER (WHERE k - 1 = floor(n * 0.75)) - max(rate) FILTER (WHERE k - 1 = floor(n * 0.25)), 8) END AS spread FROM k GROUP BY date")
def floor_spread(spark, sf):
    return S.floor_spread(p4(spark, sf), ["date"], "rate").withColumn("spread", rnd("spread", 8))


ENV = f"""{P4}, ad AS (SELECT asset_id, date, avg(rate) AS rate FROM p4 GROUP BY 1, 2), {_K.format('rate', 'ad')},
e AS (SELECT date, avg(rate) FILTER (WHERE k > floor(n / 4) AND k <= n - floor(n / 4)) AS env, CASE WHEN max(n) >= 4 THEN max(rate) FILTER (WHERE k - 1 = floor(n * 0.75)) - max(rate) FILTER (WHERE k - 1 = floor(n * 0.25)) END AS spread FROM k GROUP BY date),
env AS (SELECT 'all' AS series, date, env, env * 1095 * 100 AS apr, spread, CASE WHEN count(env) OVER f >= 30 THEN (env - avg(env) OVER f) / nullif(stddev_samp(env) OVER f, 0) END AS z90 FROM e WINDOW f AS (ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW))"""


def environment(spark, sf):
    """Daily environment: interquartile mean of the assets' rates, its yearly percentage, spread, and 90-row z-score."""
    d = p4(spark, sf).groupBy("asset_id", "date").agg(F.avg("rate").alias("rate"))
    e = S.interquartile_mean(d, ["date"], "rate", "env").join(S.floor_spread(d, ["date"], "rate"), "date").withColumn("series", F.lit("all"))
    return e.withColumns({"apr": F.col("env") * 1095 * 100, "z90": W.zscore("env", W.by("series"), 90, 30)})


@query(f"WITH {ENV} SELECT date, round(env, 8) AS env, round(apr, 4) AS apr, round(spread, 8) AS spread, round(z90, 6) AS z90 FROM env")
def env_table(spark, sf):
    return environment(spark, sf).select("date", rnd("env", 8).alias("env"), rnd("apr", 4).alias("apr"), rnd("spread", 8).alias("spread"), rnd("z90").alias("z90"))


@query(f"""WITH {R1}, b AS (SELECT date, r, ntile(8) OVER (PARTITION BY date ORDER BY close DESC, asset_id) AS bucket FROM r1 WHERE r IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY date, bucket ORDER BY r) AS k, count(*) OVER (PARTITION BY date, bucket) AS n FROM b),
t AS (SELECT *, CASE WHEN n >= 15 THEN 2 WHEN n >= 9 THEN 1 ELSE 0 END AS cut FROM k) SELECT date, bucket, round(avg(r), 6) AS mean FROM t WHERE k > cut AND k <= n - cut GROUP BY 1, 2""")
def trimmed_bucket(spark, sf):
    b = r1(spark, sf).where("r is not null").withColumn("bucket", F.ntile(8).over(Window.partitionBy("date").orderBy(F.desc("close"), "asset_id")))
    return S.trimmed_mean(b, ["date", "bucket"], "r", S.bucket_trim(F.col("_n"))).withColumn("mean", rnd("mean"))


@query(f"""WITH {P1}, s AS (SELECT CAST('2024-01-10' AS DATE) AS d), b AS (SELECT asset_id, close AS p0 FROM p1, s WHERE date = d AND close <> 0),
x AS (SELECT date, asset_id % 3 AS bucket, close / p0 - 1 AS r FROM p1 JOIN b USING (asset_id), s WHERE date BETWEEN d AND d + 20), k AS (SELECT *, row_number() OVER (PARTITION BY date, bucket ORDER BY r) AS k, count(*) OVER (PARTITION BY date, bucket) AS n FROM x WHERE r IS NOT NULL),
t AS (SELECT *, CASE WHEN n >= 15 THEN 2 WHEN n >= 9 THEN 1 ELSE 0 END AS cut FROM k) SELECT date, bucket, round(avg(r) FILTER (WHERE k > cut AND k <= n - cut), 6) AS mean, count(*) AS n FROM t GROUP BY 1, 2""")
def forward_bucket_curves(spark, sf):
    p = p1(spark, sf)
    members = p.select("asset_id", (F.col("asset_id") % 3).alias("bucket")).distinct()
    return S.bucket_curves(p.select("asset_id", "date", "close"), members, F.lit("2024-01-10").cast("date"), 20).withColumn("mean", rnd("mean"))


@query(f"WITH {R1}, {_K.format('r', 'r1')} SELECT a.date, round(avg(r), 6) AS mean, round(median(r), 6) AS median, round(avg(r) FILTER (WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n)), 6) AS trimmed FROM k a GROUP BY a.date")
def trim_mean_10(spark, sf):
    r = r1(spark, sf)
    t = S.trimmed_mean(r, ["date"], "r", F.floor(F.col("_n") * F.lit(0.1)), "trimmed")
    return r.where("r is not null").groupBy("date").agg(rnd(F.avg("r")).alias("mean"), rnd(F.percentile("r", 0.5)).alias("median")).join(t.withColumn("trimmed", rnd("trimmed")), "date")


@query(f"WITH {SNAP}, k AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY weight DESC, asset_id) AS k FROM snap) SELECT rebalance_date, round(sum(weight) FILTER (WHERE k <= 5), 6) AS top5, round(sum(weight) FILTER (WHERE k <= 10), 6) AS top10, round(sum(weight * weight), 6) AS herfindahl FROM k GROUP BY 1")
def concentration(spark, sf):
    c = S.concentration(snap(spark, sf), "rebalance_date", "weight", "asset_id")
    return c.select("rebalance_date", *(rnd(x).alias(x) for x in ("top5", "top10", "herfindahl")))


@query(f"""WITH {P4}, d AS (SELECT asset_id, date, round(avg(rate), 10) AS rate FROM p4 GROUP BY 1, 2), s AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY rate DESC, date) AS k, sum(rate) OVER (PARTITION BY asset_id ORDER BY date) AS s FROM d), m AS (SELECT *, max(s) OVER (PARTITION BY asset_id ORDER BY date) - s AS dd FROM s)
SELECT asset_id, round(sum(rate), 6) AS total, round(avg(rate) * 1095, 6) AS apr, round(count(*) FILTER (WHERE rate > 0) / count(*), 6) AS pos, round(count(*) FILTER (WHERE rate < 0) / count(*), 6) AS neg, round(stddev_pop(rate), 6) AS std, round(sum(rate) FILTER (WHERE k <= 10 AND rate > 0) / nullif(sum(rate) FILTER (WHERE rate > 0), 0), 6) AS top10_share, round(max(dd), 6) AS max_drawdown FROM m GROUP BY asset_id""")
def carry_metrics(spark, sf):
    d = p4(spark, sf).groupBy("asset_id", "date").agg(rnd(F.avg("rate"), 10).alias("rate"))
    c = S.carry(d, "asset_id", "date", "rate")
    return c.select("asset_id", *(rnd(x).alias(x) for x in ("total", "apr", "pos", "neg", "std", "top10_share", "max_drawdown")))


_X = "x AS (SELECT 'all' AS series, date, r_alts / 50 AS r FROM mkt WHERE r_alts IS NOT NULL)"


def _daily(spark, sf):
    return mkt(spark, sf).where("r_alts is not null").select("series", "date", (F.col("r_alts") / 50).alias("r"))


@query(f"""WITH {MKT}, {_X}, e AS (SELECT *, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS e FROM x), d AS (SELECT *, e / max(e) OVER (ORDER BY date) - 1 AS dd FROM e),
a AS (SELECT count(r) AS n, pow(exp(sum(ln(1 + r))), 252.0 / count(r)) - 1 AS cagr, avg(r) AS m, stddev_samp(r) AS s, stddev_samp(r) FILTER (WHERE r < 0) AS ds, least(min(dd), 0) AS mdd, count(*) FILTER (WHERE r > 0) / count(r) AS hit FROM d)
SELECT n, round(cagr, 5) AS cagr, round(m / s * sqrt(252), 6) AS sharpe, round(m / ds * sqrt(252), 6) AS sortino, round(cagr / abs(mdd), 4) AS calmar, round(mdd, 6) AS max_drawdown, round(hit, 6) AS hit_rate FROM a""")
def perf_kpis(spark, sf):
    k = S.performance(_daily(spark, sf), "series", "date", "r")
    return k.select("n", rnd("cagr", 5).alias("cagr"), rnd("sharpe").alias("sharpe"), rnd("sortino").alias("sortino"), rnd("calmar", 4).alias("calmar"), rnd("max_drawdown").alias("max_drawdown"), rnd("hit_rate").alias("hit_rate"))


@query(f"""WITH {MKT}, {_X}, q AS (SELECT quantile_cont(r, 0.05) AS v95, quantile_cont(r, 0.01) AS v99, count(r)::DOUBLE AS n, avg(r) AS m, var_pop(r) AS v FROM x),
c AS (SELECT any_value(v95) AS v95, any_value(v99) AS v99, avg(r) FILTER (WHERE r <= v95) AS c95, avg(r) FILTER (WHERE r <= v99) AS c99, avg(pow(r - m, 3)) / pow(any_value(v), 1.5) AS g1, avg(pow(r - m, 4)) / pow(any_value(v), 2) - 3 AS g2, any_value(n) AS n FROM x, q)
SELECT round(v95, 6) AS var95, round(v99, 6) AS var99, round(c95, 6) AS cvar95, round(c99, 6) AS cvar99, round(g1 * sqrt(n * (n - 1)) / (n - 2), 5) AS skew, round(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)), 5) AS kurtosis FROM c""")
def tail_risk(spark, sf):
    t = S.tail_risk(_daily(spark, sf), "series", "r")
    return t.select(*(rnd(x).alias(x) for x in ("var95", "var99", "cvar95", "cvar99")), rnd("skew", 5).alias("skew"), rnd("kurtosis", 5).alias("kurtosis"))


@query(f"WITH {MKT} SELECT date, round(r, 6) AS r FROM mkt ORDER BY mkt.r, date LIMIT 5")
def worst_days(spark, sf):
    return mkt(spark, sf).orderBy("r", "date").limit(5).select("date", rnd("r").alias("r"))


@query(f"""WITH {P3}, b AS (SELECT min(date) AS a, max(date) AS b FROM p3), g AS (SELECT asset_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT asset_id FROM p3), b)
SELECT asset_id, 2 * count(*) AS cells, CAST(2 * count(*) - count(close) - count(volume) AS BIGINT) AS empty, round((2 * count(*) - count(close) - count(volume)) / (2 * count(*)), 6) AS share FROM g LEFT JOIN p3 USING (asset_id, date) GROUP BY asset_id""")
def missingness(spark, sf):
    return S.missingness(panel.align(p3(spark, sf)), "asset_id", ["close", "volume"]).withColumn("share", rnd("share"))


@query(f"WITH {P3} SELECT asset_id, min(date) AS first, max(date) AS last, count(DISTINCT date) AS n, CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS missing FROM p3 GROUP BY asset_id")
def sparsity(spark, sf):
    return S.sparsity(p3(spark, sf), "asset_id", "date")


@query("SELECT event_type, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 6) AS pct FROM events GROUP BY 1")
def value_shares(spark, sf):
    return S.value_shares(panel.read(spark, sf, "events"), "event_type").withColumn("pct", rnd("pct"))


@query("SELECT user_id, CAST(ts AS DATE) AS date, round(avg(value), 6) AS rate FROM events GROUP BY 1, 2")
def daily_mean_utc(spark, sf):
    return panel.read(spark, sf, "events").groupBy("user_id", F.to_date("ts").alias("date")).agg(rnd(F.avg("value")).alias("rate"))


@query(f"WITH {P2}, f AS (SELECT asset_id, CASE WHEN marketcap > 300000 THEN 'high' ELSE 'low' END AS regime, lead(close, 5) OVER (PARTITION BY asset_id ORDER BY date) / nullif(close, 0) - 1 AS f FROM p2) SELECT asset_id, regime, round(median(f), 6) AS median, round(avg(CASE WHEN f > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, count(f) AS n FROM f WHERE f IS NOT NULL GROUP BY 1, 2")
def win_rate_by_regime(spark, sf):
    d = p2(spark, sf).withColumn("regime", F.when(F.col("marketcap") > 300000, "high").otherwise("low")).withColumn("f", W.ratio(F.lead("close", 5).over(W.by()), F.col("close")) - 1).where("f is not null")
    return d.groupBy("asset_id", "regime").agg(rnd(F.percentile("f", 0.5)).alias("median"), rnd(F.avg((F.col("f") > 0).cast("double"))).alias("win_rate"), F.count("f").alias("n"))


@query(f"""WITH {MKT}, e AS (SELECT quantile_cont(r, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) AS q FROM mkt), b AS (SELECT r, r_alts, 1 + len(list_filter(q[2:10], lambda x: x < r)) AS bucket FROM mkt, e)
SELECT CAST(bucket AS INTEGER) AS bucket, round(avg(r), 6) AS f, round(avg(r_alts), 6) AS y, count(*) AS n FROM b GROUP BY 1""")
def decile_table(spark, sf):
    b = W.quantile_buckets(mkt(spark, sf), "r", 10)
    return b.groupBy("bucket").agg(rnd(F.avg("r")).alias("f"), rnd(F.avg("r_alts")).alias("y"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {P1} SELECT asset_id, min_by(date, abs(close - 50)) AS nearest, max_by(date, close) AS highest FROM (SELECT * FROM p1 ORDER BY asset_id, date) GROUP BY asset_id")
def nearest_level(spark, sf):
    first = -F.datediff("date", F.lit("1970-01-01"))  # of equal days the first
    return p1(spark, sf).groupBy("asset_id").agg(F.max_by("date", F.struct(-F.abs(F.col("close") - 50), first)).alias("nearest"), F.max_by("date", F.struct("close", first)).alias("highest"))


@query("SELECT s_nationkey, round(sum(s_acctbal) FILTER (WHERE s_acctbal > 0), 2) AS gross_long, count(*) FILTER (WHERE s_acctbal > 0) AS n_open, round(sum(abs(s_acctbal)), 2) AS gross, max(s_suppkey) FILTER (WHERE s_acctbal > 0) AS last_open FROM supplier GROUP BY 1")
def ledger_aggregates(spark, sf):
    s = panel.read(spark, sf, "supplier")
    up = F.col("s_acctbal") > 0
    return s.groupBy("s_nationkey").agg(rnd(F.sum(F.when(up, F.col("s_acctbal"))), 2).alias("gross_long"), F.count_if(up).alias("n_open"), rnd(F.sum(F.abs("s_acctbal")), 2).alias("gross"), F.max(F.when(up, F.col("s_suppkey"))).alias("last_open"))


@query(f"""WITH {P2}, t AS (SELECT date, variant, r * k AS r FROM (SELECT date, avg(close / nullif(p, 0) - 1) / 50 AS r FROM (SELECT date, close, lag(close) OVER (PARTITION BY asset_id ORDER BY date) AS p FROM p2) GROUP BY date) x, (VALUES ('half', 0.5), ('full', 1.0)) v(variant, k) WHERE r IS NOT NULL), e AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY variant ORDER BY date)) AS e FROM t), d AS (SELECT *, e / max(e) OVER (PARTITION BY variant ORDER BY date) - 1 AS dd FROM e)
SELECT variant, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe, round(least(min(dd), 0), 6) AS max_drawdown FROM d GROUP BY variant""")
def variant_comparison(spark, sf):
    m = mkt(spark, sf)
    v = spark.createDataFrame([("half", 0.5), ("full", 1.0)], "variant string, k double")
    x = m.crossJoin(F.broadcast(v)).select("variant", "date", (F.col("r") / 50 * F.col("k")).alias("r"))
    return S.performance(x, "variant", "date", "r").select("variant", "n", rnd("sharpe").alias("sharpe"), rnd("max_drawdown").alias("max_drawdown"))
