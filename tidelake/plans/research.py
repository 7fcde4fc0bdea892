"""Queries of searches, filter chains, long-term regimes and table functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import tables
from ..operators import regimes, search, universe
from .registry import MKT, P2, P3, mkt, p2, p3, query, rnd

_RANGES = {"w1": (-1.0, 1.0), "w2": (-1.0, 1.0), "low": (-2.0, 0.0), "high": (0.0, 2.0)}
_PLACES = [f"(0.5 + i * {a!r}) - floor(0.5 + i * {a!r})" for a in search.steps(4)]


@query(f"""WITH {MKT}, k AS (SELECT date, r / 50 AS r, r_major / 20 AS x1, r_alts / 20 AS x2, row_number() OVER (ORDER BY date) - 1 AS k FROM mkt WHERE r_major IS NOT NULL AND r_alts IS NOT NULL),
d AS (SELECT date, CAST(floor((k - 252) / 126) AS BIGINT) AS win, x1, x2, lead(r) OVER w AS nx, count(*) OVER (PARTITION BY floor((k - 252) / 126)) - row_number() OVER w AS rest FROM k WHERE k >= 252 WINDOW w AS (PARTITION BY floor((k - 252) / 126) ORDER BY date)),
raw AS (SELECT i AS set_id, {', '.join(f'{lo} + ({p}) * {hi - lo} AS {n}' for (n, (lo, hi)), p in zip(_RANGES.items(), _PLACES, strict=True))} FROM range(1000) t(i)),
sets AS (SELECT set_id, coalesce(w1 / nullif(abs(w1) + abs(w2), 0), w1) AS w1, coalesce(w2 / nullif(abs(w1) + abs(w2), 0), w2) AS w2, low, high FROM raw),
p AS (SELECT set_id, win, rest <= 5 AS late, CASE WHEN w1 * x1 + w2 * x2 > high THEN nx WHEN w1 * x1 + w2 * x2 < low THEN -nx ELSE 0 END AS p FROM d, sets WHERE nx IS NOT NULL),
a AS (SELECT set_id, win, count(*) AS n, sum(p) AS s, sum(p * p) AS q, count(*) FILTER (WHERE late) AS ln, coalesce(sum(p) FILTER (WHERE late), 0) AS ls, coalesce(sum(p * p) FILTER (WHERE late), 0) AS lq FROM p GROUP BY 1, 2),
t AS (SELECT *, sum(n) OVER b - lag(ln) OVER o AS tn, sum(s) OVER b - lag(ls) OVER o AS ts, sum(q) OVER b - lag(lq) OVER o AS tq FROM a WINDOW o AS (PARTITION BY set_id ORDER BY win), b AS (PARTITION BY set_id ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT win, set_id, n, (tq - ts * ts / tn) / (tn - 1) AS tv, ts / tn AS tm, (q - s * s / n) / (n - 1) AS v, s / n AS m FROM t WHERE tn > 1),
h AS (SELECT win, set_id, n, round(tm / sqrt(tv) * sqrt(252), 6) AS train, CASE WHEN n > 1 AND v > 1e-18 THEN m / sqrt(v) * sqrt(252) END AS test FROM v WHERE tv > 1e-18)
SELECT win, set_id, round(train, 4) AS train, round(test, 4) AS test, n FROM h QUALIFY row_number() OVER (PARTITION BY win ORDER BY train DESC, set_id) = 1""")
def random_search(spark, sf):
    """1000 drawn sets in every walk-forward window, chosen on purged earlier rows."""
    d = mkt(spark, sf).where("r_major is not null and r_alts is not null").select("series", "date", (F.col("r") / 50).alias("r"), (F.col("r_major") / 20).alias("x1"), (F.col("r_alts") / 20).alias("x2"))
    d = regimes.walk_forward(d, 252, 126).where("window is not null").withColumnRenamed("window", "win")
    sets = search.drawn_sets(spark, 1000, _RANGES, ["w1", "w2"])
    x = search.purged_search(d, sets, ["x1", "x2"], ["w1", "w2"], "win")
    return x.select("win", "set_id", rnd("train", 4).alias("train"), rnd("test", 4).alias("test"), "n")


@query(f"""WITH {P3}, p AS (SELECT asset_id, date, close, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k, count(*) OVER (PARTITION BY asset_id) AS n FROM p3 WHERE date <= DATE '1998-06-30' AND close IS NOT NULL),
b AS (SELECT *, close / lag(close) OVER (PARTITION BY asset_id ORDER BY k) - 1 AS b FROM p), o AS (SELECT asset_id, max(n) AS n, stddev_samp(b) FILTER (WHERE k <= 20) * sqrt(252) AS vol, max(close) FILTER (WHERE k = 1) / arg_max(close, k) FILTER (WHERE k <= 8) - 1 AS momentum FROM b GROUP BY 1),
j AS (SELECT p.asset_id, p.close / lag(p.close) OVER w - 1 AS a, x.close / lag(x.close) OVER w - 1 AS b, y.close / lag(y.close) OVER w - 1 AS c FROM p JOIN p x ON x.date = p.date AND x.asset_id = 1 AND x.k <= 60 JOIN p y ON y.date = p.date AND y.asset_id = 2 AND y.k <= 60 WHERE p.k <= 60 WINDOW w AS (PARTITION BY p.asset_id ORDER BY p.date)),
c AS (SELECT asset_id, CASE WHEN count(*) >= 30 AND count(a) > 10 THEN greatest(coalesce(abs(corr(a, b)), 0), coalesce(abs(corr(a, c)), 0)) END AS corr FROM j GROUP BY 1)
SELECT asset_id, n, round(vol, 5) AS vol, round(corr, 5) AS corr, round(momentum, 5) AS momentum, CASE WHEN n < 60 THEN 'too_few_rows' WHEN vol > 13 THEN 'volatility' WHEN corr < 0.05 THEN 'correlation' WHEN momentum > 0.5 OR momentum < -0.4 THEN 'momentum' END AS reason FROM o LEFT JOIN c USING (asset_id)""")
def basket_filters(spark, sf):
    x = universe.filter_chain(p3(spark, sf), "1998-06-30", (1, 2), max_vol=13.0, min_corr=0.05, max_momentum=0.5, min_momentum=-0.4)
    return x.select("asset_id", "n", *(rnd(c, 5).alias(c) for c in ("vol", "corr", "momentum")), "reason")


@query(f"""WITH {MKT}, v AS (SELECT date, r_alts AS f, row_number() OVER (ORDER BY date) AS k FROM mkt WHERE r_alts IS NOT NULL),
w AS (SELECT date, f, k, list(f) OVER l AS l, list(f) OVER (ORDER BY date ROWS BETWEEN 179 PRECEDING AND CURRENT ROW) AS t, quantile_cont(f, 0.25) OVER l AS q1, quantile_cont(f, 0.75) OVER l AS q3 FROM v WINDOW l AS (ORDER BY date ROWS BETWEEN 359 PRECEDING AND CURRENT ROW)),
m AS (SELECT date, (len(list_filter(l, lambda x: x <= f)) - 1) / (len(l) - 1) AS p, len(list_filter(t, lambda x: x >= q3)) / len(t) AS h, len(list_filter(t, lambda x: x <= q1)) / len(t) AS c FROM w WHERE k >= 60),
s AS (SELECT *, printf('%.9f', 1 - greatest(0, least(1, (0.6 * (0.5 * p + 0.5 * h) - 0.3 * c - 0.3 * greatest(0, p - h) + 0.6) / 1.2)))::DOUBLE AS z FROM m), e AS (SELECT quantile_cont(z, 0.3333) AS a, quantile_cont(z, 0.6667) AS b FROM s)
SELECT date, round(p, 6) AS p_level, round(h, 6) AS frac_hot, round(c, 6) AS frac_cold, round(z, 6) AS score, CASE WHEN z < a THEN 'GREEN' WHEN z < b THEN 'AMBER' ELSE 'RED' END AS bucket FROM s, e""")
def longterm_regime(spark, sf):
    x = regimes.longterm_regime(mkt(spark, sf).select("series", "date", "r_alts"), "r_alts")
    return x.select("date", *(rnd(c).alias(c) for c in ("p_level", "frac_hot", "frac_cold", "score")), "bucket")


@query(f"""WITH {P2}, s AS (SELECT asset_id, date, CASE WHEN close > 250000 THEN 'HIGH' WHEN close > 150000 THEN 'MID' ELSE 'LOW' END AS state FROM p2),
g AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date) - row_number() OVER (PARTITION BY asset_id, state ORDER BY date) AS g FROM s)
SELECT asset_id AS key, state, min(date) AS first, max(date) AS last, count(*) AS n FROM g GROUP BY asset_id, state, g""")
def sql_run_lengths(spark, sf):
    """Runs of a state by a table function called from SQL."""
    tables.register(spark)
    view = f"states_{uuid.uuid4().hex}"
    state = F.when(F.col("close") > 250000, "HIGH").when(F.col("close") > 150000, "MID").otherwise("LOW")
    p2(spark, sf).select("asset_id", "date", state.alias("state")).createOrReplaceTempView(view)
    return spark.sql(f"SELECT * FROM run_lengths(TABLE(SELECT asset_id, date, state FROM {view}) PARTITION BY asset_id ORDER BY date)")
