"""Queries of cross-sectional features, scores and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as C
from ..operators import regimes as G
from ..operators import selection
from ..operators import stats as S
from ..operators import windows as W
from .aggregates import ENV, R1, environment, r1
from .registry import MKT, P2, P4, mkt, p2, p4, query, rnd


def _series(df):
    return df.withColumn("series", F.lit("all"))


@query(f"""WITH {R1}, b AS (SELECT date, sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) / count(*) * 100 AS breadth, median(r) AS med FROM r1 GROUP BY date)
SELECT date, round(breadth, 6) AS breadth, round(med, 6) AS med, round(breadth - lag(breadth) OVER (ORDER BY date), 6) AS d_breadth FROM b""")
def feat_breadth(spark, sf):
    b = _series(r1(spark, sf).groupBy("date").agg(S.breadth("r").alias("breadth"), F.percentile("r", 0.5).alias("med")))
    return b.select("date", rnd("breadth").alias("breadth"), rnd("med").alias("med"), rnd(W.delta("breadth", W.by("series"))).alias("d_breadth"))


@query(f"""WITH {P2}, d AS (SELECT date, sum(marketcap) FILTER (WHERE asset_id = '1-URGENT') / sum(marketcap) AS dom FROM p2 GROUP BY date)
SELECT date, round(dom, 6) AS dom, round(dom - lag(dom, 5) OVER (ORDER BY date), 6) AS d5, round(dom - lag(dom, 20) OVER (ORDER BY date), 6) AS d20 FROM d""")
def feat_dominance(spark, sf):
    d = _series(p2(spark, sf).groupBy("date").agg((F.sum(F.when(F.col("asset_id") == "1-URGENT", F.col("marketcap"))) / F.sum("marketcap")).alias("dom")))
    w = W.by("series")
    return d.select("date", rnd("dom").alias("dom"), rnd(W.delta("dom", w, 5)).alias("d5"), rnd(W.delta("dom", w, 20)).alias("d20"))


@query(f"""WITH {P4}, f AS (SELECT date, sum(rate * weight) FILTER (WHERE asset_id % 10 = 0) / nullif(sum(weight) FILTER (WHERE asset_id % 10 = 0), 0) AS major, sum(rate * weight) FILTER (WHERE asset_id % 10 <> 0) / nullif(sum(weight) FILTER (WHERE asset_id % 10 <> 0), 0) AS alts FROM p4 GROUP BY date),
w AS (SELECT date, alts - major AS skew, avg(alts - major) OVER f AS m, count(alts - major) OVER f AS n FROM f WINDOW f AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) SELECT date, round(skew, 8) AS skew, CASE WHEN n >= 3 THEN round(m, 8) END AS skew_3d FROM w""")
def feat_skew(spark, sf):
    big = F.col("asset_id") % 10 == 0
    d = p4(spark, sf).withColumns({"rm": F.when(big, F.col("rate")), "ra": F.when(~big, F.col("rate"))})
    wm = lambda c, k: W.ratio(F.sum(F.when(k, F.col(c) * F.col("weight"))), F.sum(F.when(k, F.col("weight"))))
    f = _series(d.groupBy("date").agg((wm("ra", ~big) - wm("rm", big)).alias("skew")))
    return f.select("date", rnd("skew", 8).alias("skew"), rnd(W.rolling("skew", W.by("series"), 3, F.avg), 8).alias("skew_3d"))


@query(f"""WITH {P4}, f AS (SELECT date, sum(rate * weight) / sum(weight) AS f FROM p4 GROUP BY date), w AS (SELECT date, avg(f) OVER s AS s, count(f) OVER s AS ns, avg(f) OVER l AS l, count(f) OVER l AS nl FROM f WINDOW s AS (ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), l AS (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT date, CASE WHEN ns >= 10 AND nl >= 20 THEN round(greatest(0, least(1, (s - l) / 0.02)), 6) END AS heating FROM w""")
def feat_heating(spark, sf):
    f = _series(p4(spark, sf).groupBy("date").agg(S.weighted_mean("rate", "weight").alias("f")))
    w = W.by("series")
    return f.select("date", rnd(C.heating_risk(W.rolling("f", w, 10, F.avg), W.rolling("f", w, 20, F.avg), 0.0, 0.02)).alias("heating"))


@query(f"""WITH {P4}, o AS (SELECT date, sum(weight) AS oi FROM p4 GROUP BY date), c AS (SELECT o.date, oi / nullif(lag(oi, 3) OVER (ORDER BY o.date), 0) - 1 AS c, r FROM o LEFT JOIN (SELECT date, r FROM ({f"WITH {MKT} SELECT * FROM mkt"})) m ON m.date = o.date)
SELECT date, round(c, 6) AS change, round(CASE WHEN c > 0 THEN least(c / 50, 1) * CASE WHEN r < 0 THEN 1.0 ELSE 0.5 END WHEN c IS NOT NULL THEN 0 END, 8) AS risk FROM c""")
def feat_oi_risk(spark, sf):
    o = _series(p4(spark, sf).groupBy("date").agg(F.sum("weight").alias("oi"))).withColumn("c", W.simple_return("oi", W.by("series"), 3))
    x = o.join(mkt(spark, sf).select("date", "r"), "date", "left")
    return x.select("date", rnd("c").alias("change"), rnd(C.oi_risk(F.col("c"), F.when(F.col("r") < 0, 1.0).otherwise(0.5)), 8).alias("risk"))


@query("""WITH p AS (SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, sum(value) AS volume FROM events GROUP BY 1, 2), w AS (SELECT *, median(volume) OVER m AS med, count(*) OVER m AS n7, max(volume) OVER h AS hi, count(*) OVER h AS n10 FROM p WINDOW m AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), h AS (PARTITION BY asset_id ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT date, round(median(CASE WHEN n7 >= 7 THEN med END), 6) AS liquidity, count(*) FILTER (WHERE n10 >= 10 AND volume = hi) AS at_high FROM w GROUP BY date""")
def feat_liquidity(spark, sf):
    from .registry import p1

    def full(n, fn):  # a day without values counts as one of the n
        frame = W.by().rowsBetween(1 - n, 0)
        return F.when(F.count(F.lit(1)).over(frame) >= n, fn(F.col("volume")).over(frame))

    d = p1(spark, sf).select("date", full(7, W.median).alias("med"), (F.col("volume") == full(10, F.max)).alias("hi"))
    return d.groupBy("date").agg(rnd(F.percentile("med", 0.5)).alias("liquidity"), F.count_if(F.col("hi")).alias("at_high"))


@query(f"""WITH {MKT}, w AS (SELECT date, stddev_samp(r_alts) OVER f AS a, stddev_samp(r_major) OVER f AS m, count(r_alts) OVER f AS na, count(r_major) OVER f AS nm FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))
SELECT date, CASE WHEN na >= 7 AND nm >= 7 THEN round(a - m, 6) END AS spread FROM w""")
def feat_volspread(spark, sf):
    w = W.by("series")
    return mkt(spark, sf).select("date", rnd(W.rolling("r_alts", w, 7, F.stddev_samp) - W.rolling("r_major", w, 7, F.stddev_samp)).alias("spread"))


@query(f"""WITH {R1}, k AS (SELECT asset_id, date, close / nullif(lag(close, 7) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1 AS r7 FROM p1), m AS (SELECT date, median(r7) AS m, count(r7) AS n FROM k GROUP BY date) SELECT date, round(m, 6) AS momentum, n, round(m - lag(m) OVER (ORDER BY date), 6) AS change FROM m""")
def feat_momentum(spark, sf):
    m = r1(spark, sf).withColumn("r7", W.simple_return("close", W.by(), 7)).groupBy("date").agg(F.percentile("r7", 0.5).alias("m"), F.count("r7").alias("n"))
    return _series(m).select("date", rnd("m").alias("momentum"), "n", rnd(W.delta("m", W.by("series"))).alias("change"))


_SCORE = f"""{MKT}, zz AS (SELECT date, r, {', '.join(f"CASE WHEN count({c}) OVER f >= 30 THEN ({c} - avg({c}) OVER f) / nullif(stddev_samp({c}) OVER f, 0) END AS z_{c}" for c in ('r', 'r_major', 'r_alts'))} FROM mkt WINDOW f AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
score AS (SELECT 'all' AS series, date, r, 0.5 * coalesce(z_r, 0) - 0.3 * coalesce(z_r_major, 0) + 0.2 * coalesce(z_r_alts, 0) AS s FROM zz)"""


def scored(spark, sf):
    w = W.by("series")
    m = mkt(spark, sf)
    for c in ("r", "r_major", "r_alts"):
        m = m.withColumn(f"z_{c}", W.zscore(c, w, 30))
    return m.withColumn("s", C.composite({"z_r": 0.5, "z_r_major": -0.3, "alts": 0.2}, ["z_r", "z_r_major", "z_r_alts"]))


@query(f"WITH {_SCORE} SELECT date, round(s, 6) AS score, row_number() OVER (ORDER BY date) > 60 AS valid FROM score")
def composite_score(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("series").orderBy("date"))
    return scored(spark, sf).select("date", rnd("s").alias("score"), (k > 60).alias("valid"))


def _machine_sql(source: str, enter: list[float], names: list[str], band: float = 0.05, persist: int = 3) -> str:
    """The regime machine of one daily score in SQL: above a threshold plus band counts up, below one less band counts down."""
    up, down = (" + ".join(f"CAST(s {sign} {e + by!r} AS INTEGER)" for e in enter) for sign, by in ((">", band), (">=", -band)))
    label = "CASE state " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + " END"
    return f"""WITH RECURSIVE {source}, x AS (SELECT date, s, row_number() OVER (ORDER BY date) AS k, {up} AS u, {down} AS d FROM score),
m AS (SELECT CAST(0 AS BIGINT) AS k, {len(enter) // 2} AS state, -1 AS waiting, 0 AS waited, 0 AS dir UNION ALL
SELECT k, CASE WHEN go THEN z ELSE state END, CASE WHEN go OR z = state THEN -1 ELSE z END, CASE WHEN go OR z = state THEN 0 ELSE wt END, CASE WHEN go THEN step ELSE dir END FROM (
SELECT *, z <> state AND wt >= CASE WHEN dir = 0 OR dir = step THEN {persist} ELSE {-(-persist * 3 // 2)} END AS go FROM (
SELECT k, state, dir, z, CASE WHEN z = waiting THEN waited + 1 ELSE 1 END AS wt, CAST(sign(z - state) AS INTEGER) AS step FROM (SELECT x.k, state, waiting, waited, dir, greatest(u, least(state, d)) AS z FROM m JOIN x ON x.k = m.k + 1))))
SELECT date, {label} AS regime, round(s, 6) AS score FROM m JOIN x USING (k)"""


@query(_machine_sql(_SCORE, [-0.3, 0.3], ["RISK_OFF", "NEUTRAL", "RISK_ON"]))
def regime3(spark, sf):
    return G.classify(scored(spark, sf), "s", [-0.3, 0.3], ["RISK_OFF", "NEUTRAL", "RISK_ON"]).select("date", "regime", rnd("s").alias("score"))


@query(_machine_sql(_SCORE, [-0.8, -0.3, 0.3, 0.8], ["STRONG_OFF", "WEAK_OFF", "NEUTRAL", "WEAK_ON", "STRONG_ON"]))
def regime5(spark, sf):
    return G.classify(scored(spark, sf), "s", [-0.8, -0.3, 0.3, 0.8], ["STRONG_OFF", "WEAK_OFF", "NEUTRAL", "WEAK_ON", "STRONG_ON"]).select("date", "regime", rnd("s").alias("score"))


@query(f"WITH {ENV}, s AS (SELECT date, CASE WHEN apr BETWEEN 2 AND 12 THEN 1 WHEN apr < 0 OR apr > 14 THEN 0 END AS s, apr FROM env) SELECT date, round(apr, 4) AS apr, coalesce(last_value(s IGNORE NULLS) OVER (ORDER BY date), 0) = 1 AS active FROM s")
def sticky_gate(spark, sf):
    a = F.col("apr")
    return G.sticky_gate(environment(spark, sf), a.between(2, 12), (a < 0) | (a > 14)).select("date", rnd("apr", 4).alias("apr"), "active")


_RW = "CASE WHEN a <= 2 THEN 0.0 WHEN a < 5 THEN (a - 2) / 3 WHEN a <= 15 THEN 1.0 WHEN a < 35 THEN (35 - a) / 20 WHEN a IS NOT NULL THEN 0.0 END"


@query(f"WITH {ENV}, a AS (SELECT date, apr + 10 AS a FROM env), w AS (SELECT date, a, {_RW} AS w, CASE WHEN a IS NULL THEN NULL WHEN a < 2 THEN 'FROZEN' WHEN a < 5 THEN 'THAW' WHEN a < 15 THEN 'NORMAL' ELSE 'HOT' END AS z FROM a) SELECT date, round(w, 6) AS weight, z AS zone, CASE WHEN w IS NULL THEN NULL WHEN w <= 0 THEN 'CLOSED' WHEN w >= 1 THEN 'OPEN' ELSE 'PARTIAL' END AS gate FROM w")
def risk_weight(spark, sf):
    e = environment(spark, sf).withColumn("a", F.col("apr") + 10)
    w = C.risk_weight(F.col("a"))
    return e.select("date", rnd(w).alias("weight"), C.zone(F.col("a")).alias("zone"), C.gate_state(w).alias("gate"))


@query(f"WITH {ENV}, d AS (SELECT date, apr, apr - lag(apr) OVER (ORDER BY date) AS d FROM env) SELECT date, round(d, 4) AS delta, round(sign(apr) * ln(1 + abs(apr)), 6) AS log_apr, round(d * sign(apr) * ln(1 + abs(apr)), 4) AS conditioned FROM d")
def log_modulus(spark, sf):
    e = environment(spark, sf).withColumn("d", W.delta("apr", W.by("series")))
    lm = C.log_modulus(F.col("apr"))
    return e.select("date", rnd("d", 4).alias("delta"), rnd(lm).alias("log_apr"), rnd(F.col("d") * lm, 4).alias("conditioned"))


@query(f"WITH {_SCORE}, b AS (SELECT date, 50 + 20 * s AS b FROM score) SELECT date, CAST(CASE WHEN b < 30 THEN 1 WHEN b < 45 THEN 2 WHEN b < 55 THEN 3 WHEN b < 70 THEN 4 ELSE 5 END AS INTEGER) AS bucket, round(greatest(0.5, least(1.5, 0.5 + b / 100)), 6) AS size FROM b")
def bucket_1_5(spark, sf):
    b = 50 + 20 * F.col("s")
    return scored(spark, sf).select("date", C.score_to_1_5(b).alias("bucket"), rnd(C.size_multiplier(b)).alias("size"))


@query("SELECT event_id, CAST(CASE upper(event_type) WHEN 'CLICK' THEN 3 ELSE 3 END AS INTEGER) AS b, round(greatest(0, least(100, 50 + value / 10 - 20 * coalesce(CASE WHEN event_id % 3 = 0 THEN 1.0 END, 0) - 15 * 0.5)), 4) AS score FROM events")
def legacy_score(spark, sf):
    from ..sources import panel

    e = panel.read(spark, sf, "events")
    s = C.legacy_score(F.col("value") / 10, F.when(F.col("event_id") % 3 == 0, 1.0), F.lit(0.5), F.lit(False))
    return e.select("event_id", C.bucket_to_1_5(F.col("event_type")).alias("b"), rnd(s, 4).alias("score"))


@query(f"""WITH {P4}, c AS (SELECT asset_id, avg(rate) * 1095 AS apr, stddev_pop(rate) AS sd, count(*) FILTER (WHERE rate < 0) / count(*) AS neg FROM p4 GROUP BY asset_id), q AS (SELECT quantile_cont(apr, 0.9) AS a, quantile_cont(sd, 0.9) AS s FROM c)
SELECT asset_id, round(greatest(0, least(1, apr / a)) - greatest(0, least(1, sd / s)) / 3 - neg / 3, 6) AS quality FROM c, q""")
def quality_score(spark, sf):
    c = p4(spark, sf).groupBy("asset_id").agg((F.avg("rate") * 1095).alias("apr"), F.stddev_pop("rate").alias("sd"), (F.count_if(F.col("rate") < 0) / F.count(F.lit(1))).alias("neg"))
    x = c.withColumns({"a": F.lit(selection.quantiles(c, "apr", [0.9])[0]).cast("double"), "s": F.lit(selection.quantiles(c, "sd", [0.9])[0]).cast("double")})
    scaled = lambda v, by: C.clamp(F.col(v) / F.col(by), 0.0, 1.0)
    return x.select("asset_id", rnd(scaled("apr", "a") - scaled("sd", "s") / 3 - F.col("neg") / 3).alias("quality"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 450000 THEN 'STOP_HIT' WHEN (o_totalprice - 100000) / 350000 >= 0.9 THEN 'CRITICAL' WHEN (o_totalprice - 100000) / 350000 >= 0.7 THEN 'WARNING' ELSE 'NONE' END AS tier, round(o_totalprice / 100000 - 1, 6) AS adverse, round(-3 * 0.0001 * o_totalprice * -1, 6) AS funding_pnl FROM orders")
def short_tiers(spark, sf):
    from ..sources import panel

    o = panel.read(spark, sf, "orders")
    entry, stop, price = F.lit(100000.0), F.lit(450000.0), F.col("o_totalprice")
    return o.select("o_orderkey", C.short_tier(entry, price, stop).alias("tier"), rnd(C.short_adverse_move(entry, price)).alias("adverse"), rnd(C.daily_funding_pnl(F.lit("SHORT"), price, F.lit(0.0001))).alias("funding_pnl"))
