"""Queries of universes and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import universe as U
from ..sources import panel
from .aggregates import R1, r1
from .registry import P1, SNAP, query, rnd, snap

_MONTH = """m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS rebalance_date, l_suppkey AS asset_id, sum(l_extendedprice) AS mcap, sum(l_quantity) AS volume, min(CAST(l_shipdate AS DATE)) AS listed FROM lineitem GROUP BY 1, 2)"""


def month(spark, sf):
    g = panel.read(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("rebalance_date"), F.col("l_suppkey").alias("asset_id"))
    return g.agg(F.sum("l_extendedprice").alias("mcap"), F.sum("l_quantity").alias("volume"), F.min(F.to_date("l_shipdate")).alias("listed"))


_RULES = [("not_listed", "day(listed) <= 20"), ("blacklisted", "asset_id % 13 <> 0"), ("stablecoin", "asset_id % 11 <> 0"), ("below_min_mcap", "mcap >= 40000"), ("below_min_volume", "volume >= 60")]


def _case(rules):
    return "CASE " + " ".join(f"WHEN NOT ({c}) THEN '{n}'" for n, c in rules) + " END"


@query(f"WITH {_MONTH} SELECT rebalance_date, asset_id, {' AND '.join(f'({c})' for _, c in _RULES)} AS eligible, {_case(_RULES)} AS exclusion_reason FROM m")
def eligibility(spark, sf):
    return U.eligibility(month(spark, sf), [(n, F.expr(c)) for n, c in _RULES]).select("rebalance_date", "asset_id", "eligible", "exclusion_reason")


@query(f"WITH {_MONTH} SELECT rebalance_date, asset_id, {' AND '.join(f'({c})' for _, c in _RULES)} AS eligible, {_case(_RULES[:4])} AS exclusion_reason FROM m")
def eligibility_legacy(spark, sf):
    return U.eligibility(month(spark, sf), [(n, F.expr(c)) for n, c in _RULES], ["below_min_mcap"]).select("rebalance_date", "asset_id", "eligible", "exclusion_reason")


_CAP, _N = 0.12, 12


def _capped(rounds: int) -> str:
    parts = [f"t AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY mcap DESC, asset_id) AS rank FROM m WHERE volume >= 30), w0 AS (SELECT rebalance_date, asset_id, rank, mcap / sum(mcap) OVER (PARTITION BY rebalance_date) AS w, mcap / sum(mcap) OVER (PARTITION BY rebalance_date) AS w0 FROM t WHERE rank <= {_N})"]
    for i in range(rounds):
        parts.append(f"""x{i} AS (SELECT *, sum(CASE WHEN w >= {_CAP} THEN w - {_CAP} ELSE 0 END) OVER p AS e, sum(CASE WHEN w < {_CAP} THEN w ELSE 0 END) OVER p AS r FROM w{i} WINDOW p AS (PARTITION BY rebalance_date)),
w{i + 1} AS (SELECT rebalance_date, asset_id, rank, CASE WHEN e <= 1e-12 THEN w WHEN w >= {_CAP} THEN {_CAP} WHEN r > 0 THEN w * (1 + e / r) ELSE w END AS w, w0 FROM x{i})""")
    return ",\n".join(parts)


@query(f"WITH {_MONTH}, {_capped(12)} SELECT rebalance_date, asset_id, CAST(rank AS INTEGER) AS rank, round(CASE WHEN abs(sum(w) OVER (PARTITION BY rebalance_date) - 1) < 1e-9 THEN w ELSE w0 END, 6) AS weight FROM w12")
def topn_weights(spark, sf):
    t = U.top_n(month(spark, sf).where("volume >= 30"), "rebalance_date", [F.desc("mcap"), F.col("asset_id")], _N)
    return U.weights(t, "rebalance_date", "mcap", "cap", _CAP).select("rebalance_date", "asset_id", "rank", rnd("weight").alias("weight"))


@query(f"WITH {_MONTH}, t AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY mcap DESC, asset_id) AS rank FROM m) SELECT rebalance_date, asset_id, round(sqrt(mcap) / sum(sqrt(mcap)) OVER (PARTITION BY rebalance_date), 6) AS sqrt_weight, round(1.0 / count(*) OVER (PARTITION BY rebalance_date), 6) AS equal_weight FROM t WHERE rank <= {_N}")
def weight_schemes(spark, sf):
    t = U.top_n(month(spark, sf), "rebalance_date", [F.desc("mcap"), F.col("asset_id")], _N)
    s = U.weights(t, "rebalance_date", "mcap", "sqrt").withColumnRenamed("weight", "sqrt_weight")
    return U.weights(s, "rebalance_date", "mcap", "equal").select("rebalance_date", "asset_id", rnd("sqrt_weight").alias("sqrt_weight"), rnd("weight").alias("equal_weight"))


_SPAN = "b AS (SELECT CAST(min({0}) AS DATE) AS a, CAST(max({0}) AS DATE) AS b FROM {1})"


def _with_rows(calendar, facts, day, date):
    """A calendar with how many rows the table has on each day."""
    n = facts.groupBy(F.to_date(date).alias("_d")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(n, F.col(day) == F.col("_d"), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("_d")


@query(f"WITH {_SPAN.format('o_orderdate', 'orders')}, c AS (SELECT CAST(d + INTERVAL 14 DAY AS DATE) AS d FROM (SELECT unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS d FROM b)) SELECT c.d AS rebalance_date, count(o_orderkey) AS n FROM c JOIN b ON c.d BETWEEN a AND b.b LEFT JOIN orders ON CAST(o_orderdate AS DATE) = c.d GROUP BY 1")
def rebalance_dates(spark, sf):
    """The 15th of each month that the orders cover, with its orders."""
    o = panel.read(spark, sf, "orders")
    return _with_rows(U.rebalance_calendar(U.span(o, "o_orderdate"), 15), o, "rebalance_date", "o_orderdate")


@query(f"WITH {_SPAN.format('l_shipdate', 'lineitem')}, c AS (SELECT CAST(d AS DATE) AS d FROM (SELECT unnest(generate_series(date_trunc('quarter', a), b, INTERVAL 3 MONTH)) AS d FROM b)) SELECT c.d AS rebalance_date, count(l_orderkey) AS n FROM c JOIN b ON c.d BETWEEN a AND b.b LEFT JOIN lineitem ON CAST(l_shipdate AS DATE) = c.d GROUP BY 1")
def rebalance_quarters(spark, sf):
    li = panel.read(spark, sf, "lineitem")
    return _with_rows(U.rebalance_calendar(U.span(li, "l_shipdate"), 1, 3), li, "rebalance_date", "l_shipdate")


@query(f"WITH {_SPAN.format('o_orderdate', 'orders')}, c AS (SELECT CAST(unnest(generate_series(a + CAST((11 - isodow(a)) % 7 AS INTEGER), b, INTERVAL 7 DAY)) AS DATE) AS d FROM b) SELECT c.d AS decision_date, CAST(c.d + INTERVAL 7 DAY AS DATE) AS next_date, count(o_orderkey) AS n FROM c LEFT JOIN orders ON CAST(o_orderdate AS DATE) = c.d GROUP BY 1")
def weekly_dates(spark, sf):
    """The Thursdays that the orders cover."""
    o = panel.read(spark, sf, "orders")
    return _with_rows(U.weekly_calendar(U.span(o, "o_orderdate")), o, "decision_date", "o_orderdate")


@query(f"""WITH {R1}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY r DESC, asset_id) AS h, row_number() OVER (PARTITION BY date ORDER BY r, asset_id DESC) AS c, least(15, floor(count(*) OVER (PARTITION BY date) / 2)) AS k FROM r1 WHERE r IS NOT NULL)
SELECT date, asset_id, CASE WHEN h <= k THEN 'hot' ELSE 'cold' END AS side FROM k WHERE h <= k OR c <= k""")
def hot_cold(spark, sf):
    return U.hot_cold(r1(spark, sf), "date", "r", "asset_id").select("date", "asset_id", "side")


@query(f"WITH {R1}, s AS (SELECT asset_id, stddev_samp(r) AS vol FROM r1 GROUP BY asset_id HAVING count(r) >= 5 AND stddev_samp(r) > 0) SELECT asset_id, round(vol, 6) AS vol, round(1 / vol / sum(1 / vol) OVER (), 8) AS weight FROM s")
def inv_vol(spark, sf):
    return U.inverse_volatility(r1(spark, sf), "asset_id", "r").select("asset_id", rnd("vol").alias("vol"), rnd("weight", 8).alias("weight"))


@query(f"WITH {SNAP} SELECT rebalance_date, string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY CAST(asset_id AS VARCHAR)) AS members, substr(sha256(string_agg(CAST(asset_id AS VARCHAR), ',' ORDER BY CAST(asset_id AS VARCHAR))), 1, 16) AS hash FROM snap GROUP BY 1")
def basket_hash(spark, sf):
    return U.membership_hash(snap(spark, sf), "rebalance_date", "asset_id")


@query(f"WITH {P1} SELECT asset_id, round(median(volume), 6) AS med, count(*) AS n FROM p1 WHERE date <= DATE '2024-01-25' GROUP BY asset_id QUALIFY row_number() OVER (ORDER BY median(volume) DESC, asset_id) <= 30")
def top_by_liquidity(spark, sf):
    from .registry import p1

    m = p1(spark, sf).where("date <= date'2024-01-25'").groupBy("asset_id").agg(F.percentile("volume", 0.5).alias("med"), F.count(F.lit(1)).alias("n"))
    return m.orderBy(F.desc("med"), "asset_id").limit(30).select("asset_id", rnd("med").alias("med"), "n")
