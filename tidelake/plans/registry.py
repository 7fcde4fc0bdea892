"""All registered queries and their SQL.

A query takes (spark, sf_dir) and returns a DataFrame over whole tables. `SQL` pieces such as P1 are the panels as common
table expressions, so that both sides start from the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import panel

FLAGSHIP = "ret_1d"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

P1 = """p1 AS (SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, avg(value) AS close, sum(value) AS volume, avg(value) * count(*) AS marketcap FROM events GROUP BY 1, 2)"""
P2 = """p2 AS (SELECT o_orderpriority AS asset_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS marketcap FROM orders GROUP BY 1, 2)"""
P3 = """p3 AS (SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close, sum(l_extendedprice) AS volume, sum(l_quantity) AS marketcap FROM lineitem GROUP BY 1, 2)"""
P4 = """p4 AS (SELECT l_suppkey AS asset_id, l_linenumber AS instrument_id, l_returnflag AS exchange, CAST(l_shipdate AS DATE) AS date, l_discount - l_tax AS rate, l_extendedprice AS weight FROM lineitem)"""
SNAP = """snap0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS rebalance_date, l_suppkey AS asset_id, sum(l_extendedprice) AS marketcap FROM lineitem GROUP BY 1, 2),
snap1 AS (SELECT *, row_number() OVER (PARTITION BY rebalance_date ORDER BY marketcap DESC, asset_id) AS rank FROM snap0),
snap AS (SELECT rebalance_date, asset_id, marketcap, rank, marketcap / sum(marketcap) OVER (PARTITION BY rebalance_date) AS weight FROM snap1 WHERE rank <= 20)"""
#: One row a day: equal-weighted market return, from P2's assets.
MKT = (
    P2
    + """,
mret AS (SELECT asset_id, date, close / nullif(lag(close) OVER (PARTITION BY asset_id ORDER BY date), 0) - 1 AS r FROM p2),
mkt AS (SELECT 'all' AS series, date, avg(r) AS r, avg(CASE WHEN asset_id = '1-URGENT' THEN r END) AS r_major, avg(CASE WHEN asset_id <> '1-URGENT' THEN r END) AS r_alts FROM mret GROUP BY date HAVING avg(r) IS NOT NULL)"""
)


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = steady(sql)
        return f

    return add


def rnd(value: Column | str, digits: int = 6) -> Column:
    """Rounded for output. Means of few decimals often lie exactly between two results, where engines differ by the last bit of
    a sum; a hundredth of the last digit is added, which moves such values off the tie."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(10.0 ** -(digits + 2)), digits)


def steady(sql: str) -> str:
    """The SQL with the same addition in each round(x, digits)."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            continue
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        value, _, digits = sql[m.end() : end - 1].rpartition(",")
        out += f"{sql[at : m.start()]}round(({steady(value)}) + 1e-{int(digits) + 2}, {int(digits)})"
        at = end
    return out + sql[at:]


p1, p2, p3, p4 = panel.events_panel, panel.orders_panel, panel.lineitem_panel, panel.rates


def snap(spark: SparkSession, sf: str) -> DataFrame:
    return panel.snapshots(spark, sf)


def mkt(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import windows as W

    r = p2(spark, sf).withColumn("r", W.simple_return("close", W.by()))
    major = F.col("asset_id") == "1-URGENT"
    day = r.groupBy("date").agg(F.avg("r").alias("r"), F.avg(F.when(major, F.col("r"))).alias("r_major"), F.avg(F.when(~major, F.col("r"))).alias("r_alts"))
    return day.where("r is not null").withColumn("series", F.lit("all"))


def load() -> None:
    from . import aggregates, backtests, evaluations, features, ingest, lake, operations, quality_gates, research, rolling, scans, sql_book, state, statistics, streams, universes  # noqa: F401

load()
