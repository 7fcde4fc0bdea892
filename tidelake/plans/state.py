"""Queries of state files and of stored sketches."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..sources import panel, shared, state_files
from .registry import query, rnd

_DAILY = "d AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS decision_date, count(*) AS n, round(avg(o_totalprice), 4) AS apr, round(stddev_pop(o_totalprice), 4) AS spread FROM orders GROUP BY 1)"


def _file(spark, sf):
    """A state file of daily features of the orders, in the shared folder."""
    daily = panel.read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("decision_date"))
    daily = daily.agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("o_totalprice"), 4).alias("apr"), rnd(F.stddev_pop("o_totalprice"), 4).alias("spread"))
    folder = shared.folder(spark, "state").removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"a state file needs a shared folder that is mounted, not {folder}")
    path = f"{folder}/macro_state.db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    state_files.save(daily, path, "macro_features", "decision_date")
    return spark, path, "macro_features"


@query(f"WITH {_DAILY} SELECT * FROM d ORDER BY decision_date DESC LIMIT 1")
def state_latest(spark, sf):
    return state_files.latest(*_file(spark, sf), "decision_date", rows=500)


@query(f"WITH {_DAILY} SELECT * FROM d ORDER BY decision_date DESC LIMIT 90")
def state_last_90(spark, sf):
    return state_files.last_rows(*_file(spark, sf), "decision_date", 90, rows=500)


@query(f"WITH {_DAILY} SELECT decision_date, apr FROM d WHERE decision_date >= '1998-01-01' AND apr IS NOT NULL")
def state_series(spark, sf):
    return state_files.series(*_file(spark, sf), "decision_date", "apr", "1998-01-01", rows=500)


@query(f"WITH {_DAILY} SELECT decision_date, CASE WHEN apr >= 280000 THEN 'HIGH' WHEN apr >= 250000 THEN 'MID' ELSE 'LOW' END AS regime FROM d WHERE n > 2 AND spread IS NOT NULL")
def state_regimes(spark, sf):
    """Regime labels of the days with enough rows; both conditions are decided in the file."""
    x = state_files.read(*_file(spark, sf), rows=500, where=[("n", ">", 2), ("spread", "not null")])
    return x.select("decision_date", F.when(F.col("apr") >= 280000, "HIGH").when(F.col("apr") >= 250000, "MID").otherwise("LOW").alias("regime"))


# Sketches


@query("SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1")
def sketch_quarters(spark, sf):
    """Distinct customers a quarter, united from daily sketches. Theta sketches are exact up to their nominal entries (2^16 here); as many shards keep each below that."""
    o = panel.read(spark, sf, "orders").withColumn("date", F.to_date("o_orderdate"))
    daily = K.daily_sketches(o, [], "date", "o_custkey", "o_totalprice", K.shards_for(o, "o_custkey"))
    return K.united(daily, [F.date_trunc("quarter", "date").cast("date").alias("quarter")]).select("quarter", "customers", "n")


@query("SELECT count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS a, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS b, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase')) AS both_, (SELECT count(*) FROM (SELECT user_id FROM events WHERE event_type = 'click' EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase')) AS only_a FROM events")
def sketch_sets(spark, sf):
    """Overlap of two sets of users from their daily sketches alone."""
    e = panel.read(spark, sf, "events").withColumn("date", F.to_date("ts"))
    daily = K.daily_sketches(e, ["event_type"], "date", "user_id", "value", K.shards_for(e, "user_id"))
    return K.overlap(daily, F.col("event_type") == "click", F.col("event_type") == "purchase")


@query()
def sketch_range(spark, sf):
    """A year's distinct orders and price quantiles from daily sketches (HLL, KLL), beside the exact values; `within` says that all keep their bounds."""
    li = panel.read(spark, sf, "lineitem").withColumn("date", F.to_date("l_shipdate"))
    daily = K.daily_sketches(li, [], "date", "l_orderkey", "l_extendedprice")
    est = K.united(daily, [F.year("date").alias("year")]).select("year", F.col("hll").alias("orders_estimate"), "median", "p90")
    exact = li.groupBy(F.year("date").alias("year")).agg(F.count_distinct("l_orderkey").alias("orders"), F.count(F.lit(1)).alias("n"))
    ranks = li.select(F.year("date").alias("year"), "l_extendedprice").join(est, "year").groupBy("year").agg(*(F.avg((F.col("l_extendedprice") <= F.col(q)).cast("double")).alias(f"rank_{q}") for q in ("median", "p90")))
    x = est.join(exact, "year").join(ranks, "year")
    near = lambda q, p: F.abs(F.col(f"rank_{q}") - p) <= K.KLL_BOUND + 1 / F.col("n")
    return x.withColumn("within", (F.abs(F.col("orders_estimate") - F.col("orders")) <= K.HLL_BOUND * F.col("orders") + 1) & near("median", 0.5) & near("p90", 0.9))
