"""Queries of evaluation and history upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import regimes as G
from ..operators import universe as U
from .registry import MKT, P3, SNAP, mkt, p3, query, rnd, snap
from .universes import _MONTH, _RULES, month


@query(f"WITH {MKT} SELECT d.date FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM mkt), DATE '2001-08-05', INTERVAL 1 DAY)) AS DATE) AS date) d WHERE d.date NOT IN (SELECT date FROM mkt)")
def missing_dates(spark, sf):
    return E.missing_dates(mkt(spark, sf), F.lit("2001-08-05").cast("date")).select("date")


@query(f"WITH {MKT}, w AS (SELECT date, r, avg(r) OVER f AS m, stddev_pop(r) OVER f AS s, count(r) OVER f AS n FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT date, CASE WHEN n >= 30 THEN round((r - m) / nullif(s, 0), 6) END AS z FROM w")
def z_history(spark, sf):
    return E.z_against_history(mkt(spark, sf), "r").select("date", rnd("z").alias("z"))


@query(f"WITH {MKT} SELECT date, round(r, 6) AS r FROM mkt ORDER BY date DESC LIMIT 90")
def latest_90(spark, sf):
    return E.latest_rows(mkt(spark, sf), "date", 90).select("date", rnd("r").alias("r"))


@query(f"""WITH {MKT}, c AS (SELECT date, r_alts / 50 AS r, exp(sum(ln(1 + coalesce(r_alts / 50, 0))) OVER (ORDER BY date)) - 1 AS c FROM mkt WHERE date BETWEEN DATE '1998-05-01' AND DATE '1998-07-31'), d AS (SELECT *, c - max(c) OVER (ORDER BY date) AS dd FROM c)
SELECT round(exp(sum(ln(1 + r))) - 1, 6) AS total, round(min(dd), 6) AS drawdown, round(stddev_samp(r), 6) AS vol, round(avg(r) / stddev_samp(r) * sqrt(365), 5) AS sharpe, round(max(c), 6) AS peak FROM d""")
def event_window(spark, sf):
    x = E.window_metrics(mkt(spark, sf).withColumn("x", F.col("r_alts") / 50), "series", "date", "x", "1998-05-01", "1998-07-31")
    return x.select(rnd("total").alias("total"), rnd("drawdown").alias("drawdown"), rnd("vol").alias("vol"), rnd("sharpe", 5).alias("sharpe"), rnd("peak").alias("peak"))


@query(f"WITH {P3}, {SNAP}, m AS (SELECT DISTINCT asset_id FROM snap WHERE rebalance_date = DATE '1998-03-01') SELECT CAST(m.asset_id AS VARCHAR) AS asset_id, round(b.close / nullif(a.close, 0) - 1, 6) AS ret FROM m LEFT JOIN p3 a ON a.asset_id = m.asset_id AND a.date = DATE '1998-03-05' LEFT JOIN p3 b ON b.asset_id = m.asset_id AND b.date = DATE '1998-03-12'")
def two_date_return(spark, sf):
    members = U.membership_hash(snap(spark, sf).where("rebalance_date = date'1998-03-01'"), "rebalance_date", "asset_id")
    return E.two_date_return(p3(spark, sf), members, "1998-03-05", "1998-03-12").select("asset_id", rnd("ret").alias("ret"))


@query(f"WITH {_MONTH}, {SNAP}, e AS (SELECT rebalance_date, count(*) FILTER (WHERE {' AND '.join(f'({c})' for _, c in _RULES)}) AS e FROM m GROUP BY 1), s AS (SELECT rebalance_date, count(*) AS s FROM snap GROUP BY 1) SELECT count(*) AS dates, min(e) AS min_eligible, list_sort(list(e))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS median_eligible, round(100.0 * count(*) FILTER (WHERE s >= 20) / count(*), 4) AS pct_full FROM e LEFT JOIN s ON s.rebalance_date = e.rebalance_date")
def manager_summary(spark, sf):
    e = U.eligibility(month(spark, sf), [(n, F.expr(c)) for n, c in _RULES])
    return E.manager_summary(e, snap(spark, sf), 20).withColumn("pct_full", rnd("pct_full", 4))


@query(f"WITH {SNAP} SELECT asset_id, round(marketcap, 2) AS marketcap FROM snap WHERE rebalance_date = DATE '1998-03-01' ORDER BY snap.marketcap DESC LIMIT 8")
def candidate_fallback(spark, sf):
    s = snap(spark, sf).where("rebalance_date = date'1998-03-01'")
    return E.candidates_or_all(s, F.col("marketcap") > 1e15, F.desc("marketcap"), 8).select("asset_id", rnd("marketcap", 2).alias("marketcap"))


_SETS = [(1, 1.0, 0.0, 0.0), (2, 0.5, 0.5, 0.1), (3, -1.0, 0.5, 0.0), (4, 0.2, -0.7, -0.1)]


@query(f"""WITH {MKT}, k AS (SELECT date, r / 50 AS r, r_major AS x1, r_alts AS x2, row_number() OVER (ORDER BY date) - 1 AS k FROM mkt WHERE r_major IS NOT NULL AND r_alts IS NOT NULL), w AS (SELECT *, CAST(floor((k - 252) / 126) AS BIGINT) AS win FROM k WHERE k >= 252), n AS (SELECT *, lead(r) OVER (PARTITION BY win ORDER BY date) AS nx FROM w),
s(set_id, w1, w2, th) AS (VALUES {', '.join(str(x) for x in _SETS)}), p AS (SELECT set_id, win, CASE WHEN w1 * x1 + w2 * x2 > th THEN nx ELSE 0 END AS p FROM n, s WHERE nx IS NOT NULL) SELECT set_id, win, round(avg(p) / nullif(stddev_samp(p), 0) * sqrt(252), 5) AS sharpe, count(*) AS n FROM p GROUP BY 1, 2""")
def walk_forward_grid(spark, sf):
    d = mkt(spark, sf).where("r_major is not null and r_alts is not null").select("series", "date", (F.col("r") / 50).alias("r"), F.col("r_major").alias("x1"), F.col("r_alts").alias("x2"))
    d = G.walk_forward(d, 252, 126).where("window is not null").withColumnRenamed("window", "win")
    params = spark.createDataFrame(_SETS, "set_id int, w1 double, w2 double, threshold double")
    return E.grid_search(d, params, "win").select("set_id", "win", rnd("sharpe", 5).alias("sharpe"), "n")


@query()
def smoothed_peak(spark, sf):
    return E.smoothed_peak(mkt(spark, sf).select("series", "r_major", "r_alts"), "series", "r_major", "r_alts").select(rnd("at").alias("at"), rnd("peak").alias("peak"))


@query(f"WITH {P3}, {SNAP}, j AS (SELECT s.rebalance_date, s.marketcap AS m, p.close FROM snap s LEFT JOIN p3 p ON p.asset_id = s.asset_id AND p.date = s.rebalance_date + 1) SELECT rebalance_date, round(sum(m * close) / nullif(sum(CASE WHEN close IS NOT NULL THEN m END), 0), 3) AS level, count(close) AS valid FROM j GROUP BY 1")
def cap_weighted_rebuild(spark, sf):
    p = p3(spark, sf).select("asset_id", F.date_sub("date", 1).alias("rebalance_date"), "close")
    x = snap(spark, sf).join(p, ["asset_id", "rebalance_date"], "left")
    from ..operators.windows import ratio

    m = F.col("marketcap")
    return x.groupBy("rebalance_date").agg(rnd(ratio(F.sum(m * F.col("close")), F.sum(F.when(F.col("close").isNotNull(), m))), 3).alias("level"), F.count("close").alias("valid"))
