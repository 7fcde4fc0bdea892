"""Queries of the window operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection
from ..operators import windows as W
from ..sources import panel
from .registry import MKT, P1, P2, P3, SNAP, mkt, p1, p2, p3, query, rnd, snap

A = "PARTITION BY asset_id ORDER BY date"


@query(f"WITH {P1} SELECT asset_id, date, round(close / nullif(lag(close) OVER ({A}), 0) - 1, 6) AS ret FROM p1")
def ret_1d(spark, sf):
    return p1(spark, sf).select("asset_id", "date", rnd(W.simple_return("close", W.by())).alias("ret"))


@query(f"WITH {P1} SELECT asset_id, date, CASE WHEN date - lag(date) OVER ({A}) = 1 THEN round(close / nullif(lag(close) OVER ({A}), 0) - 1, 6) END AS ret FROM p1")
def ret_1d_break(spark, sf):
    return p1(spark, sf).select("asset_id", "date", rnd(W.simple_return("close", W.by(), gap="break")).alias("ret"))


@query(f"""WITH {P3}, g AS (SELECT asset_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p3 GROUP BY asset_id),
d AS (SELECT g.asset_id, g.date, close FROM g LEFT JOIN p3 USING (asset_id, date)),
f AS (SELECT *, last_value(close IGNORE NULLS) OVER ({A} ROWS UNBOUNDED PRECEDING) AS c FROM d)
SELECT asset_id, date, round(c / nullif(lag(c) OVER ({A}), 0) - 1, 6) AS ret FROM f""")
def ret_1d_pad(spark, sf):
    d = opened(spark, sf)
    return d.select("asset_id", "date", rnd(W.ratio(F.col("close"), F.when(own(), F.col("before")).otherwise(F.col("close"))) - 1).alias("ret"))


@query(f"WITH {P1} SELECT asset_id, date, " + ", ".join(f"round(close / nullif(lag(close, {k}) OVER ({A}), 0) - 1, 6) AS ret_{k}" for k in (3, 7, 14)) + " FROM p1")
def ret_kd(spark, sf):
    return p1(spark, sf).select("asset_id", "date", *(rnd(W.simple_return("close", W.by(), k)).alias(f"ret_{k}") for k in (3, 7, 14)))


@query(f"WITH {P1} SELECT asset_id, date, round(ln(CASE WHEN close > 0 THEN close END / CASE WHEN lag(close) OVER ({A}) > 0 THEN lag(close) OVER ({A}) END), 6) AS ret FROM p1")
def log_ret(spark, sf):
    return p1(spark, sf).select("asset_id", "date", rnd(W.log_return("close", W.by())).alias("ret"))


@query(f"WITH {P2} SELECT asset_id, date, " + ", ".join(f"round(close - lag(close, {k}) OVER ({A}), 4) AS delta_{k}" for k in (1, 5, 20)) + " FROM p2")
def delta_k(spark, sf):
    return p2(spark, sf).select("asset_id", "date", *(rnd(W.delta("close", W.by(), k), 4).alias(f"delta_{k}") for k in (1, 5, 20)))


def _roll(fn: str, n: int, least: int | None = None, value: str = "close") -> str:
    frame = f"({A} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({value}) OVER {frame} >= {least or n} THEN {fn.format(value)} OVER {frame} END"


@query(f"WITH {P2}, w AS (SELECT asset_id, date, close, {_roll('avg({})', 60)} AS m, {_roll('stddev_samp({})', 60)} AS s FROM p2) SELECT asset_id, date, round(m, 4) AS mean_60, round(s, 4) AS std_60, round((close - m) / nullif(s, 0), 4) AS z_60 FROM w")
def roll_mean_std_z(spark, sf):
    w = W.by()
    return p2(spark, sf).select("asset_id", "date", rnd(W.rolling("close", w, 60, F.avg), 4).alias("mean_60"), rnd(W.rolling("close", w, 60, F.stddev_samp), 4).alias("std_60"), rnd(W.zscore("close", w, 60), 4).alias("z_60"))


@query(f"WITH {P2}, w AS (SELECT asset_id, date, close, {_roll('avg({})', 90, 30)} AS m, {_roll('stddev_samp({})', 90, 30)} AS s FROM p2) SELECT asset_id, date, round((close - m) / nullif(s, 0), 4) AS z_90 FROM w")
def roll_z90_min30(spark, sf):
    return p2(spark, sf).select("asset_id", "date", rnd(W.zscore("close", W.by(), 90, 30), 4).alias("z_90"))


@query(f"WITH {P2} SELECT asset_id, date, round({_roll('avg({})', 30)}, 4) AS sma30, round({_roll('avg({})', 200, 1)}, 4) AS ma200, round({_roll('avg({})', 21, 1, 'volume')}, 4) AS adv21, round({_roll('stddev_samp({})', 14, 7)}, 4) AS vol14 FROM p2")
def sma_minp(spark, sf):
    w = W.by()
    return p2(spark, sf).select("asset_id", "date", rnd(W.rolling("close", w, 30, F.avg), 4).alias("sma30"), rnd(W.rolling("close", w, 200, F.avg, 1), 4).alias("ma200"), rnd(W.rolling("volume", w, 21, F.avg, 1), 4).alias("adv21"), rnd(W.rolling("close", w, 14, F.stddev_samp, 7), 4).alias("vol14"))


@query(f"WITH {P1} SELECT asset_id, date, round({_roll('median({})', 7)}, 6) AS med7, round({_roll('median({})', 7, 4)}, 6) AS med7_min4, round({_roll('median({})', 30, 1)}, 6) AS med30_min1, round({_roll('median({})', 30, 15)}, 6) AS med30_min15 FROM p1")
def roll_median(spark, sf):
    w = W.by()
    m = lambda n, k: rnd(W.rolling("close", w, n, W.median, k))
    return p1(spark, sf).select("asset_id", "date", m(7, 7).alias("med7"), m(7, 4).alias("med7_min4"), m(30, 1).alias("med30_min1"), m(30, 15).alias("med30_min15"))


@query(f"WITH {P1} SELECT asset_id, date, volume = {_roll('max({})', 10, None, 'volume')} AS at_high FROM p1")
def at_30d_high(spark, sf):
    return p1(spark, sf).select("asset_id", "date", W.at_rolling_max("volume", W.by(), 10).alias("at_high"))


@query(f"WITH {P1}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM p1 WHERE date <= DATE '2024-01-20') SELECT asset_id, round(median(volume), 6) AS med FROM n WHERE k <= 7 GROUP BY asset_id")
def median_last7(spark, sf):
    d = p1(spark, sf).where("date <= date'2024-01-20'").withColumn("k", F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("date"))))
    return d.where("k <= 7").groupBy("asset_id").agg(rnd(F.percentile("volume", 0.5)).alias("med"))


@query(f"""WITH {P2}, w AS (SELECT asset_id, date, close, list(close) OVER ({A} ROWS BETWEEN 51 PRECEDING AND CURRENT ROW) AS a FROM p2)
SELECT asset_id, date, CASE WHEN len(a) >= 26 THEN round((len(list_filter(a, lambda x: x < close)) + (len(list_filter(a, lambda x: x = close)) + 1) / 2.0) / len(a), 6) END AS pct FROM w""")
def roll_pct_rank(spark, sf):
    return p2(spark, sf).select("asset_id", "date", rnd(W.rolling_pct_rank("close", W.by(), 52, 26)).alias("pct"))


@query(f"""WITH {P1}, w AS (SELECT *, count(*) OVER (PARTITION BY date) AS n, rank() OVER (PARTITION BY date ORDER BY close) + (count(*) OVER (PARTITION BY date, close) - 1) / 2.0 AS k FROM p1)
SELECT asset_id, date, CASE WHEN n > 1 THEN round((k - 1) / (n - 1), 6) END AS xs FROM w""")
def xs_rank(spark, sf):
    return p1(spark, sf).select("asset_id", "date", rnd(W.cross_rank("close", "date")).alias("xs"))


@query(f"WITH {P1} SELECT asset_id, date, CAST(rank() OVER (PARTITION BY date ORDER BY volume DESC) AS INTEGER) AS rk FROM p1")
def rank_min_desc(spark, sf):
    return p1(spark, sf).select("asset_id", "date", W.rank_desc("volume", "date").alias("rk"))


@query(f"WITH {P3}, v AS (SELECT asset_id, date, CASE WHEN asset_id % 7 <> 0 THEN marketcap END AS m FROM p3) SELECT asset_id, date, CASE WHEN m IS NOT NULL THEN CAST(rank() OVER (PARTITION BY date ORDER BY m DESC NULLS LAST) AS INTEGER) END AS rk FROM v")
def xs_rank_min_nulls(spark, sf):
    return p3(spark, sf).withColumn("m", F.when(F.col("asset_id") % 7 != 0, F.col("marketcap"))).select("asset_id", "date", W.rank_desc("m", "date").alias("rk"))


@query(f"""WITH {P2}, e AS (SELECT quantile_cont(close, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM p2)
SELECT asset_id, date, CAST(CASE WHEN close <= q[2] THEN 1 WHEN close <= q[3] THEN 2 WHEN close <= q[4] THEN 3 ELSE 4 END AS INTEGER) AS bucket FROM p2, e""")
def qcut4(spark, sf):
    return W.quantile_buckets(p2(spark, sf), "close", 4).select("asset_id", "date", "bucket")


@query(f"""WITH {MKT}, w AS (SELECT date, percent_rank() OVER (ORDER BY r) AS p FROM mkt)
SELECT date, CAST(CASE WHEN p <= 0.25 THEN 0 WHEN p <= 0.5 THEN 1 WHEN p <= 0.75 THEN 2 ELSE 3 END AS INTEGER) AS bin FROM w""")
def cut_fixed(spark, sf):
    m = mkt(spark, sf).withColumn("p", F.percent_rank().over(Window.partitionBy("series").orderBy("r")))
    return m.select("date", W.cut(F.col("p"), [0.0, 0.25, 0.5, 0.75, 1.0]).alias("bin"))


@query(f"WITH {P2} SELECT asset_id, round(quantile_cont(close, 0.0), 4) AS q0, round(quantile_cont(close, 0.2), 4) AS q1, round(quantile_cont(close, 0.4), 4) AS q2, round(quantile_cont(close, 0.6), 4) AS q3, round(quantile_cont(close, 0.8), 4) AS q4, round(quantile_cont(close, 1.0), 4) AS q5 FROM p2 GROUP BY asset_id")
def pct_bins_full(spark, sf):
    q = p2(spark, sf).groupBy("asset_id").agg(F.percentile("close", F.array(*(F.lit(i / 5) for i in range(6)))).alias("q"))
    return q.select("asset_id", *(rnd(F.get("q", i), 4).alias(f"q{i}") for i in range(6)))


LABELS = ("Red", "Orange", "Yellow", "YellowGreen", "Green")


@query(f"""WITH {P2}, w AS (SELECT asset_id, date, close, list(close) OVER ({A} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS a FROM p2),
q AS (SELECT *, list_sort(a) AS s FROM w WHERE len(a) >= 52),
e AS (SELECT *, {", ".join(f"s[CAST(floor(51 * {k / 5}) AS INTEGER) + 1] + (51 * {k / 5} - floor(51 * {k / 5})) * (s[least(CAST(floor(51 * {k / 5}) AS INTEGER) + 2, 52)] - s[CAST(floor(51 * {k / 5}) AS INTEGER) + 1]) AS q{k}" for k in (1, 2, 3, 4))} FROM q)
SELECT w.asset_id, w.date, CASE WHEN q1 IS NULL THEN NULL WHEN w.close < q1 THEN 'Red' WHEN w.close < q2 THEN 'Orange' WHEN w.close < q3 THEN 'Yellow' WHEN w.close < q4 THEN 'YellowGreen' ELSE 'Green' END AS label
FROM w LEFT JOIN e ON e.asset_id = w.asset_id AND e.date = w.date""")
def pct_labels_prior52(spark, sf):
    return p2(spark, sf).select("asset_id", "date", W.prior_labels("close", W.by(), 52, LABELS).alias("label"))


@query(f"""WITH {P2}, w AS (SELECT asset_id, date, close, list(close) OVER ({A} ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING) AS a FROM p2)
SELECT asset_id, date, CASE WHEN len(a) > 0 THEN round(len(list_filter(a, lambda x: x <= close)) / len(a) * 100, 4) END AS p FROM w""")
def pct_rank_prior52(spark, sf):
    return p2(spark, sf).select("asset_id", "date", rnd(W.pct_rank_le("close", W.by(), 52), 4).alias("p"))


@query(f"""WITH {MKT}, e AS (SELECT date, exp(sum(ln(1 + r / 200)) OVER (ORDER BY date)) AS eq, sum(r / 200) OVER (ORDER BY date) AS additive FROM mkt)
SELECT date, round(eq, 6) AS equity, round(additive, 6) AS additive, round(eq / max(eq) OVER (ORDER BY date) - 1, 6) AS dd FROM e""")
def drawdown(spark, sf):
    w = W.by("series")
    m = mkt(spark, sf).withColumn("x", F.col("r") / 200)
    m = m.withColumn("eq", W.equity("x", w)).withColumn("add", F.sum("x").over(W.upto(w)))
    return m.select("date", rnd("eq").alias("equity"), rnd("add").alias("additive"), rnd(W.drawdown("eq", w)).alias("dd"))


@query(f"""WITH {MKT}, e AS (SELECT date, r, exp(sum(ln(1 + r / 200)) OVER (ORDER BY date)) AS eq FROM mkt), d AS (SELECT date, r, eq / max(eq) OVER (ORDER BY date) - 1 AS dd FROM e)
SELECT round(min(dd) FILTER (WHERE r > 0), 6) AS max_dd_active, round(min(dd), 6) AS max_dd FROM d""")
def drawdown_active(spark, sf):
    w = W.by("series")
    m = mkt(spark, sf).withColumn("eq", W.equity(F.col("r") / 200, w)).withColumn("dd", W.drawdown("eq", w))
    return m.agg(rnd(F.min(F.when(F.col("r") > 0, F.col("dd")))).alias("max_dd_active"), rnd(F.min("dd")).alias("max_dd"))


@query(f"""WITH {MKT} SELECT date, CASE WHEN count(r) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 THEN round(exp(sum(ln(1 + r / 200)) OVER (ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) - 1, 6) END AS fwd5,
round(lead(r, 5) OVER (ORDER BY date), 6) AS shift5 FROM mkt""")
def fwd_compound(spark, sf):
    w = W.by("series")
    m = mkt(spark, sf).withColumn("x", F.col("r") / 200)
    return m.select("date", rnd(W.forward_compound("x", w, 5)).alias("fwd5"), rnd(F.lead("r", 5).over(w)).alias("shift5"))


@query(f"WITH {MKT} SELECT date, round(lead(r, 10) OVER (ORDER BY date), 6) AS r_10 FROM mkt")
def fwd_shift(spark, sf):
    return mkt(spark, sf).select("date", rnd(F.lead("r", 10).over(W.by("series"))).alias("r_10"))


@query(f"WITH {P1} SELECT asset_id, date, round(lead(close, 7) OVER ({A}) / nullif(close, 0) - 1, 6) AS fwd7 FROM p1")
def fwd_kd(spark, sf):
    return p1(spark, sf).select("asset_id", "date", rnd(W.ratio(F.lead("close", 7).over(W.by()), F.col("close")) - 1).alias("fwd7"))


def _marks(up: float, down: float, through: bool, exclusive: bool) -> str:
    hit = [f"coalesce(r > {up} AND lead(r, {k}) OVER ({A}) < {down}, false)" for k in (1, 2, 3)]
    cols, taken = [], "false"
    for k, h in enumerate(hit, 1):
        cols.append(f"({h}) AND NOT ({taken}) AS s{k}" if exclusive else f"{h} AS s{k}")
        taken = f"{taken} OR {h}"
    spread = " OR ".join(f"bool_or(s{k}) OVER ({A} ROWS BETWEEN {k if through else k - 1} PRECEDING AND CURRENT ROW)" for k in (1, 2, 3))
    return f"m AS (SELECT *, {', '.join(cols)} FROM r) SELECT asset_id, date, {spread} AS anomaly FROM m"


@query(f"WITH {P1}, r AS (SELECT asset_id, date, close / nullif(lag(close) OVER ({A}), 0) - 1 AS r FROM p1), {_marks(1.0, -0.5, False, False)}")
def slingshot(spark, sf):
    d = p1(spark, sf).withColumn("r", W.simple_return("close", W.by()))
    return W.mark_slingshots(d, "r").select("asset_id", "date", "anomaly")


@query(f"WITH {P1}, c AS (SELECT asset_id, date, marketcap / nullif(close, 0) AS s FROM p1), r AS (SELECT asset_id, date, s / nullif(lag(s) OVER ({A}), 0) - 1 AS r FROM c), {_marks(0.5, -0.33, True, True)}")
def supply_slingshot(spark, sf):
    d = p1(spark, sf).withColumn("s", W.ratio(F.col("marketcap"), F.col("close")))
    d = d.withColumn("r", W.simple_return("s", W.by()))
    return W.mark_slingshots(d, "r", up=0.5, down=-0.33, through_fall=True, exclusive=True).select("asset_id", "date", "anomaly")


DENSE = f"""{P3}, g AS (SELECT asset_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p3 GROUP BY asset_id),
dense AS (SELECT g.asset_id, g.date, close FROM g LEFT JOIN p3 ON p3.asset_id = g.asset_id AND p3.date = g.date)"""


def spans(spark, sf):
    return panel.spans(p3(spark, sf), "close")


def opened(spark, sf):
    return panel.opened(spans(spark, sf))


def own():
    """The day of a span that has its value."""
    return F.col("date") == F.col("first")


def added():
    """The span's days after it."""
    return F.datediff("last", "first")


@query(f"WITH {DENSE} SELECT asset_id, date, round(last_value(close IGNORE NULLS) OVER ({A} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS v, close IS NULL AND last_value(close IGNORE NULLS) OVER ({A} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) IS NOT NULL AS is_ffilled FROM dense")
def ffill3(spark, sf):
    v = F.when(F.datediff("date", "first") <= 3, F.col("close"))
    return opened(spark, sf).select("asset_id", "date", rnd(v, 4).alias("v"), (~own() & v.isNotNull()).alias("is_ffilled"))


@query(f"""WITH {DENSE}, a AS (SELECT *, count(close) OVER ({A}) AS gap FROM dense),
b AS (SELECT *, sum(CASE WHEN close IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY asset_id, gap) AS n, last_value(close IGNORE NULLS) OVER ({A}) AS prev FROM a)
SELECT asset_id, date, round(CASE WHEN close IS NOT NULL THEN close WHEN n <= 2 AND gap > 0 THEN prev END, 4) AS v FROM b""")
def gap_fill_whole(spark, sf):
    return opened(spark, sf).select("asset_id", "date", rnd(F.when(own() | (added() <= 2), F.col("close")), 4).alias("v"))


@query(f"WITH {DENSE} SELECT asset_id, date, round(CASE WHEN close IS NULL AND lag(close) OVER ({A}) IS NOT NULL AND lead(close) OVER ({A}) IS NOT NULL THEN lag(close) OVER ({A}) ELSE close END, 4) AS v FROM dense")
def gap_fill_1d(spark, sf):
    return opened(spark, sf).select("asset_id", "date", rnd(F.when(own() | ((added() == 1) & F.col("after").isNotNull()), F.col("close")), 4).alias("v"))


@query(f"WITH {DENSE}, f AS (SELECT asset_id, date, last_value(close IGNORE NULLS) OVER ({A}) AS v FROM dense) SELECT asset_id, date, round(coalesce(v, first_value(v IGNORE NULLS) OVER ({A} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS v FROM f")
def fill_both(spark, sf):
    return opened(spark, sf).select("asset_id", "date", rnd(F.coalesce("close", "after"), 4).alias("v"))


@query(f"""WITH {DENSE}, a AS (SELECT asset_id, close IS NULL AS f, row_number() OVER ({A}) - row_number() OVER (PARTITION BY asset_id, close IS NULL ORDER BY date) AS k FROM dense),
b AS (SELECT asset_id, sum(f::INT) AS n FROM a GROUP BY asset_id, f, k) SELECT asset_id, CAST(max(n) AS BIGINT) AS longest FROM b GROUP BY asset_id""")
def longest_null_run(spark, sf):
    n = added() + F.col("close").isNull().cast("int")
    return spans(spark, sf).groupBy("asset_id").agg(F.max(n).cast("long").alias("longest"))


@query(f"""WITH {P1}, c AS (SELECT asset_id, date, coalesce(floor(close / 20) = lag(floor(close / 20)) OVER ({A}), false) AS f FROM p1),
a AS (SELECT asset_id, f, row_number() OVER ({A}) - row_number() OVER (PARTITION BY asset_id, f ORDER BY date) AS k FROM c), b AS (SELECT asset_id, sum(f::INT) AS n FROM a GROUP BY asset_id, f, k)
SELECT asset_id, CAST(max(n) AS BIGINT) AS longest FROM b GROUP BY asset_id""")
def stale_streak(spark, sf):
    d = p1(spark, sf).withColumn("x", F.floor(F.col("close") / 20)).withColumn("same", F.col("x") == F.lag("x").over(W.by()))
    return W.longest_run(d, F.col("same"))


@query(f"""WITH {P1}, s AS (SELECT asset_id, date, CAST(floor(close / 100) AS BIGINT) AS st FROM p1), c AS (SELECT *, CASE WHEN st = lag(st) OVER ({A}) THEN 0 ELSE 1 END AS ch FROM s),
a AS (SELECT asset_id, count(*) AS n, sum(ch) AS k FROM c GROUP BY asset_id)
SELECT asset_id, n, CAST(k - 1 AS BIGINT) AS switches, round((k - 1) / (n / 365.25), 4) AS per_year, round(n / k, 4) AS mean_run FROM a""")
def regime_runs(spark, sf):
    r = W.run_stats(p1(spark, sf).withColumn("st", F.floor(F.col("close") / 100)), "st", "asset_id")
    return r.select("asset_id", "n", "switches", rnd("per_year", 4).alias("per_year"), rnd("mean_run", 4).alias("mean_run"))


@query(f"""WITH {P1}, s AS (SELECT asset_id, date, CAST(floor(close / 100) AS BIGINT) AS st FROM p1), c AS (SELECT *, sum(ch) OVER ({A}) AS run FROM (SELECT *, CASE WHEN st = lag(st) OVER ({A}) THEN 0 ELSE 1 END AS ch FROM s))
SELECT asset_id, date, st, CAST(row_number() OVER (PARTITION BY asset_id, run ORDER BY date) AS INTEGER) AS duration FROM c""")
def run_duration(spark, sf):
    d = W.runs(p1(spark, sf).withColumn("st", F.floor(F.col("close") / 100)), F.col("st"))
    return d.select("asset_id", "date", "st", F.row_number().over(Window.partitionBy("asset_id", "run").orderBy("date")).alias("duration"))


@query(f"""WITH {MKT}, w AS (SELECT date, count(*) FILTER (WHERE r_major IS NOT NULL AND r_alts IS NOT NULL) OVER f AS n, corr(r_major, r_alts) OVER f AS c, stddev_samp(r) OVER f AS s, count(r) OVER f AS k FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT date, CASE WHEN n >= 30 THEN round(c, 6) END AS corr30, CASE WHEN k >= 30 THEN round(s * sqrt(252), 6) END AS vol30 FROM w""")
def roll_corr(spark, sf):
    w = W.by("series")
    return mkt(spark, sf).select("date", rnd(W.rolling_corr("r_major", "r_alts", w, 30)).alias("corr30"), rnd(W.rolling("r", w, 30, F.stddev_samp) * F.sqrt(F.lit(252.0))).alias("vol30"))


@query(f"""WITH {MKT}, w AS (SELECT date, regr_count(r_alts, r_major) OVER f AS n, regr_slope(r_alts, r_major) OVER f AS b FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT date, CASE WHEN n >= 30 THEN round(b, 6) END AS beta FROM w""")
def roll_beta(spark, sf):
    return mkt(spark, sf).select("date", rnd(W.rolling_beta("r_alts", "r_major", W.by("series"))).alias("beta"))


@query(f"""WITH {P2}, w AS (SELECT asset_id, date, close, list(close) OVER ({A} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS a FROM p2), m AS (SELECT *, list_median(a) AS m FROM w)
SELECT asset_id, date, CASE WHEN len(a) >= 15 THEN round((close - m) / (1.4826 * greatest(list_median(list_transform(a, lambda x: abs(x - m))), 1e-12)), 4) END AS z FROM m""")
def mad_z(spark, sf):
    return W.mad_zscore(p2(spark, sf), "close", 30, 15).select("asset_id", "date", rnd("mad_z", 4).alias("z"))


@query(f"WITH {P1}, e AS (SELECT asset_id, date, abs(close - lag(close) OVER ({A})) AS e FROM p1) SELECT asset_id, date, round(avg(e) OVER ({A} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), 6) AS mae FROM e")
def roll_mae(spark, sf):
    d = p1(spark, sf).withColumn("e", F.abs(W.delta("close", W.by())))
    return d.select("asset_id", "date", rnd(W.rolling("e", W.by(), 24, F.avg, 1)).alias("mae"))


@query(f"""WITH {SNAP}, i AS (SELECT *, dense_rank() OVER (ORDER BY rebalance_date) AS i FROM snap), p AS (SELECT i + 1 AS i, asset_id, weight AS w0 FROM i),
b AS (SELECT coalesce(i.i, p.i) AS i, weight, w0 FROM i FULL JOIN p ON p.i = i.i AND p.asset_id = i.asset_id),
t AS (SELECT i, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) AS t, count(*) FILTER (WHERE w0 IS NULL) AS entered, count(*) FILTER (WHERE weight IS NULL) AS exited, count(weight) AS n FROM b GROUP BY i)
SELECT d.rebalance_date, round(CASE WHEN t.i = 1 THEN 1.0 ELSE t / 2 END, 6) AS turnover, entered, exited, n FROM t JOIN (SELECT DISTINCT i, rebalance_date FROM i) d ON d.i = t.i""")
def turnover(spark, sf):
    return W.turnover(snap(spark, sf)).withColumn("turnover", rnd("turnover"))


@query(f"WITH {P3}, f AS (SELECT asset_id, min(date) AS first_seen FROM p3 WHERE close IS NOT NULL GROUP BY asset_id) SELECT asset_id, first_seen, CAST(DATE '1998-01-01' - first_seen AS INTEGER) AS age FROM f")
def first_seen_age(spark, sf):
    f = p3(spark, sf).where("close is not null").groupBy("asset_id").agg(F.min("date").alias("first_seen"))
    return f.withColumn("age", F.datediff(F.lit("1998-01-01").cast("date"), "first_seen"))


@query(f"WITH {P1} SELECT asset_id, round(avg(volume), 6) AS vol_14d, count(*) AS n FROM p1 WHERE date BETWEEN DATE '2024-01-06' AND DATE '2024-01-20' GROUP BY asset_id")
def vol_14d(spark, sf):
    return p1(spark, sf).where("date between date'2024-01-06' and date'2024-01-20'").groupBy("asset_id").agg(rnd(F.avg("volume")).alias("vol_14d"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {P1}, r AS (SELECT asset_id, date, close / nullif(lag(close) OVER ({A}), 0) - 1 AS r FROM p1), q AS (SELECT quantile_cont(r, 0.01) AS lo, quantile_cont(r, 0.99) AS hi FROM r)
SELECT asset_id, date, round(r, 6) AS r, r < lo OR r > hi AS extreme FROM r, q WHERE r IS NOT NULL""")
def extreme_flags(spark, sf):
    r = selection.kept(p1(spark, sf).withColumn("r", W.simple_return("close", W.by())).where("r is not null"))
    lo, hi = (F.lit(x).cast("double") for x in selection.quantiles(r, "r", [0.01, 0.99]))
    return r.select("asset_id", "date", rnd("r").alias("r"), ((F.col("r") < lo) | (F.col("r") > hi)).alias("extreme"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) AS rk FROM orders")
def rank_all(spark, sf):
    """Rank of each order among all of them."""
    return selection.ranked(panel.read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "rk", descending=True).drop("o_totalprice")


@query("SELECT l_linenumber, round(l_extendedprice, 4) AS price FROM lineitem WHERE l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.999) FROM lineitem)")
def top_permille(spark, sf):
    """Rows beyond an exact quantile of the whole table."""
    li = panel.read(spark, sf, "lineitem").select("l_linenumber", "l_extendedprice")
    return li.where(F.col("l_extendedprice") > selection.quantiles(li, "l_extendedprice", [0.999])[0]).select("l_linenumber", rnd("l_extendedprice", 4).alias("price"))


@query(f"""WITH {P3}, b AS (SELECT min(date) AS a, max(date) AS b FROM p3), g AS (SELECT asset_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT asset_id FROM p3), b),
o AS (SELECT asset_id, min(date) AS onboard FROM p3 WHERE volume > 60000 GROUP BY asset_id)
SELECT g.asset_id, g.date, CASE WHEN g.date >= onboard THEN round(close, 4) END AS close, round(CASE WHEN g.date >= onboard THEN coalesce(close, marketcap) END, 4) AS filled, coalesce(g.date >= onboard AND close IS NOT NULL, false) AS active
FROM g LEFT JOIN p3 ON p3.asset_id = g.asset_id AND p3.date = g.date LEFT JOIN o ON o.asset_id = g.asset_id""")
def panel_activity(spark, sf):
    p = p3(spark, sf)
    bounds = p.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    grid = p.select("asset_id").distinct().crossJoin(F.broadcast(bounds)).select("asset_id", F.explode(F.sequence("a", "b")).alias("date"))
    onboard = p.where("volume > 60000").groupBy("asset_id").agg(F.min("date").alias("onboard"))
    x = grid.join(p, ["asset_id", "date"], "left").join(onboard, "asset_id", "left")
    live = F.col("date") >= F.col("onboard")
    return x.select("asset_id", "date", rnd(F.when(live, F.col("close")), 4).alias("close"), rnd(F.when(live, F.coalesce("close", "marketcap")), 4).alias("filled"), F.coalesce(live & F.col("close").isNotNull(), F.lit(False)).alias("active"))


@query(f"WITH {P3}, g AS (SELECT asset_id, lead(date) OVER ({A}) - date AS gap FROM p3) SELECT asset_id, CAST(max(gap) AS INTEGER) AS max_gap, count(*) FILTER (WHERE gap > 1) AS n_gaps FROM g GROUP BY asset_id")
def date_gaps(spark, sf):
    g = p3(spark, sf).select("asset_id", F.datediff(F.lead("date").over(W.by()), "date").alias("gap"))
    return g.groupBy("asset_id").agg(F.max("gap").alias("max_gap"), F.count_if(F.col("gap") > 1).alias("n_gaps"))


@query(f"""WITH {P2}, r AS (SELECT asset_id, date, marketcap / nullif(close, 0) AS x, {_roll('avg({})', 7, 7, '(marketcap / nullif(close, 0))')} AS m, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM p2)
SELECT asset_id, round(max(m) FILTER (WHERE k = 1), 6) AS mean7, round(regr_slope(m, -k) FILTER (WHERE k <= 14), 6) AS slope14, round(stddev_samp(x) FILTER (WHERE k <= 21) / nullif(avg(x) FILTER (WHERE k <= 21), 0), 6) AS cv21 FROM r WHERE n >= 21 GROUP BY asset_id""")
def tail_trend(spark, sf):
    w = Window.partitionBy("asset_id")
    d = p2(spark, sf).withColumn("x", W.ratio(F.col("marketcap"), F.col("close")))
    d = d.withColumns({"m": W.rolling("x", W.by(), 7, F.avg), "k": F.row_number().over(w.orderBy(F.desc("date"))), "n": F.count(F.lit(1)).over(w)}).where("n >= 21")
    x = F.when(F.col("k") <= 21, F.col("x"))
    return d.groupBy("asset_id").agg(rnd(F.max(F.when(F.col("k") == 1, F.col("m")))).alias("mean7"), rnd(F.regr_slope(F.when(F.col("k") <= 14, F.col("m")), F.when(F.col("k") <= 14, -F.col("k").cast("double")))).alias("slope14"), rnd(W.ratio(F.stddev_samp(x), F.avg(x))).alias("cv21"))


@query(f"""WITH {MKT}, a AS (SELECT date, avg(r) OVER f AS m, median(r) OVER f AS md, count(r) OVER f AS n FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)), b AS (SELECT date, m, md FROM a WHERE n >= 6)
SELECT date, CASE WHEN count(m) OVER g >= 6 THEN round(corr(m, md) OVER g, 6) END AS c FROM b WINDOW g AS (ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def corr_of_rollings(spark, sf):
    w = W.by("series")
    d = mkt(spark, sf).select("series", "date", W.rolling("r", w, 12, F.avg, 6).alias("m"), W.rolling("r", w, 12, W.median, 6).alias("md")).where("m is not null")
    frame = w.rowsBetween(-11, 0)
    return d.select("date", rnd(F.when(F.count("m").over(frame) >= 6, F.corr("m", "md").over(frame))).alias("c"))


@query(f"WITH {DENSE}, l AS (SELECT asset_id, date, close, last_value(close IGNORE NULLS) OVER ({A} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM dense) SELECT asset_id, date, CASE WHEN close <> 0 AND p <> 0 THEN round((close / p - 1) * 100, 4) END AS ret FROM l")
def ret_vs_last_nonnull(spark, sf):
    r = F.when(own() & (F.col("close") != 0) & (F.col("before") != 0), (F.col("close") / F.col("before") - 1) * 100)
    return opened(spark, sf).select("asset_id", "date", rnd(r, 4).alias("ret"))


@query(f"""WITH {MKT}, z AS (SELECT date, r, r_alts AS z FROM mkt), d AS (SELECT DISTINCT CAST(date_trunc('week', date) AS DATE) AS decision_date FROM mkt),
j AS (SELECT decision_date, round(avg(r), 6) AS mean_7 FROM d JOIN z ON z.date >= decision_date - 7 AND z.date < decision_date GROUP BY decision_date),
s AS (SELECT decision_date, round(arg_max(z, z.date), 6) AS z_asof FROM d JOIN z ON z.date <= decision_date WHERE z IS NOT NULL GROUP BY decision_date)
SELECT d.decision_date, mean_7, z_asof FROM d LEFT JOIN j ON j.decision_date = d.decision_date LEFT JOIN s ON s.decision_date = d.decision_date""")
def lookback_mean_asof(spark, sf):
    from ..operators import asof

    m = mkt(spark, sf)
    d = m.select(F.to_date(F.date_trunc("week", "date")).alias("decision_date")).distinct()
    means = asof.lookback_mean(d, m, "decision_date", "date", "r", 7)
    z = asof.backward(d.withColumn("series", F.lit("all")), m.where("r_alts is not null").select("series", "date", "r_alts"), "decision_date", "date", ["series"], ["r_alts"])
    return means.join(z.select("decision_date", "r_alts"), "decision_date").select("decision_date", rnd("mean").alias("mean_7"), rnd("r_alts").alias("z_asof"))
