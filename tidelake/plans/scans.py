"""Queries of scans, sinks, listings, validators, reminders and monitors."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from ..operators import evaluation, mapping, monitors, portfolio, quality
from ..sources import catalog, panel, shared
from .registry import MKT, P2, mkt, p2, query, rnd


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def scan_date_range(spark, sf):
    """A declared schema and a date range that reach the scan."""
    x = catalog.scan(spark, f"{sf}/orders.parquet", "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz", ("1996-01-01", "1996-12-31"), "o_orderdate")
    return x.select("o_orderkey", "o_totalprice")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority, o_totalprice FROM orders")
def csv_declared(spark, sf):
    """Written as CSV and read with a declared schema."""
    path = shared.folder(spark, "csv")
    catalog.write_csv(panel.read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), path)
    return catalog.scan_csv(spark, path, "o_orderkey string, o_orderpriority string, o_totalprice double")


@query("SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS lines, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1")
def csv_inferred(spark, sf):
    """The same with types inferred: a number column is one."""
    path = shared.folder(spark, "csv")
    catalog.write_csv(panel.read(spark, sf, "lineitem").select("l_returnflag", "l_linenumber", "l_extendedprice"), path)
    return catalog.scan_csv(spark, path).groupBy("l_returnflag").agg(F.sum("l_linenumber").alias("lines"), rnd(F.sum("l_extendedprice"), 2).alias("total"))


@query(f"WITH {P2} SELECT date, upper(asset_id) AS ticker, round(close, 6) AS close FROM p2")
def load_long(spark, sf):
    """A long file of any spelling as date, ticker, close."""
    path = f"{shared.folder(spark, 'long')}/prices.parquet"
    p2(spark, sf).select(F.col("date").alias("Date"), F.lower("asset_id").alias("Symbol"), F.col("close").alias("CLOSE")).write.parquet(path)
    return catalog.load_prices(spark, path).withColumn("close", rnd("close"))


@query(f"WITH {P2} SELECT date, upper(asset_id) AS ticker, round(close, 4) AS close FROM p2 WHERE asset_id IN ('1-URGENT', '5-LOW')")
def load_wide(spark, sf):
    """A wide file (a column an asset) by the same reader; the first of two paths doesn't exist."""
    top = shared.folder(spark, "wide")
    panel.to_wide(p2(spark, sf), "date", "asset_id", "close").write.parquet(f"{top}/wide.parquet")
    return catalog.load_with_fallback(spark, [f"{top}/absent.parquet", f"{top}/wide.parquet"], ["1-urgent", "5-low"]).withColumn("close", rnd("close", 4))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def materialized_database(spark, sf):
    """Tables of the folder as managed tables of a database, queried there."""
    name = f"lake_{uuid.uuid4().hex}"
    catalog.materialize(spark, sf, name, ["nation", "customer"], shared.folder(spark, "database"))
    return spark.sql(f"SELECT n_name, count(*) AS n FROM {name}.customer JOIN {name}.nation ON c_nationkey = n_nationkey GROUP BY 1")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def sql_script(spark, sf):
    """The last of several statements, written in another dialect's form of scanning a file."""
    return catalog.run_sql(spark, f"SHOW TABLES; SELECT o_orderstatus, count(*) AS n FROM read_parquet('{sf}/orders.parquet') GROUP BY 1;")[-1]


@query("SELECT s_name || 'USDT' AS symbol, s_name AS base, CAST(make_timestamp((1600000000 + s_suppkey * 86400) * 1000000) AS DATE) AS onboard_date FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0")
def perp_listing_rows(spark, sf):
    """Perpetual listings out of exchange JSON, one document a nation; other quotes and delivery contracts go."""
    s = panel.read(spark, sf, "supplier")
    one = F.struct(
        F.concat("s_name", F.when(F.col("s_suppkey") % 5 == 0, "BUSD").otherwise("USDT")).alias("symbol"), F.col("s_name").alias("baseAsset"), F.when(F.col("s_suppkey") % 5 == 0, "BUSD").otherwise("USDT").alias("quoteAsset"),
        F.when(F.col("s_suppkey") % 3 == 0, "CURRENT_QUARTER").otherwise("PERPETUAL").alias("contractType"), ((F.lit(1600000000) + F.col("s_suppkey") * 86400) * 1000).cast("bigint").alias("onboardDate"),
    )
    return mapping.perp_listings(s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(one).alias("symbols"))).alias("payload")).select("payload"))


@query("SELECT s_name AS ticker, CAST(s_suppkey % 50 AS INTEGER) AS max_leverage FROM supplier WHERE s_suppkey % 7 <> 0")
def venue_universe_rows(spark, sf):
    s = panel.read(spark, sf, "supplier")
    one = F.struct(F.col("s_name").alias("name"), (F.col("s_suppkey") % 50).cast("int").alias("maxLeverage"), F.when(F.col("s_suppkey") % 7 == 0, True).alias("isDelisted"))
    return mapping.venue_universe(s.groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(one).alias("universe"))).alias("payload")).select("payload"))


@query("SELECT 'k' || c_custkey || '-usdt' AS ticker, 'K' || c_custkey AS symbol FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'k' || c_custkey || '-usdt', NULL FROM customer WHERE c_custkey % 3 <> 0")
def venue_map(spark, sf):
    """A venue's tickers with the panel's symbols, and those without one."""
    c = panel.read(spark, sf, "customer")
    hit, miss = mapping.map_tickers(c.select(F.concat(F.lit("k"), "c_custkey", F.lit("-usdt")).alias("ticker")), c.where("c_custkey % 3 = 0").select(F.concat(F.lit("K"), "c_custkey").alias("symbol")))
    return hit.unionByName(miss.withColumn("symbol", F.lit(None).cast("string")))


@query("SELECT DISTINCT o_orderdate::DATE::VARCHAR AS decision_date, max(o_orderkey) OVER (PARTITION BY o_orderdate) AS v FROM orders")
def normalized_history(spark, sf):
    """Dates of mixed spelling; bad ones go, and of a date its last row stays."""
    o = panel.read(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("decision_date"), F.col("o_orderkey").alias("v"))
    bad = o.limit(5).select(F.lit(None).cast("string").alias("decision_date"), F.lit(10**9).cast("long").alias("v"))
    return evaluation.normalize_history(o.unionByName(bad), order="v")


@query("WITH t AS (SELECT o_orderpriority AS cohort, CAST(min(o_orderdate) AS DATE) AS started FROM orders GROUP BY 1), d AS (SELECT min(started) + 43 AS today FROM t) SELECT cohort, started, CAST(today - started AS INTEGER) AS age FROM t, d WHERE today - started IN (40, 43, 45)")
def cohort_reminders(spark, sf):
    """Cohorts that are due for a reminder 43 days after the first of them began."""
    ledger = panel.read(spark, sf, "orders").select(F.col("o_orderpriority").alias("cohort"), F.to_date("o_orderdate").alias("entry_date_utc"))
    today = ledger.agg(F.date_add(F.min("entry_date_utc"), 43).alias("d")).first()["d"]
    return portfolio.cohort_age(ledger, F.lit(today))


@query("SELECT * FROM (VALUES ('extra o_extra'), ('missing o_absent'), ('type of o_orderkey')) t(problem) WHERE (SELECT count(*) FROM orders) >= 0")
def schema_report(spark, sf):
    """What a table's columns have against a declared schema."""
    o = panel.read(spark, sf, "orders").select("o_orderkey", "o_totalprice").withColumn("o_extra", F.lit(1))
    found = quality.schema_problems(o, "o_orderkey string, o_totalprice double, o_absent date")
    return o.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*map(F.lit, found))).alias("problem"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE o_totalprice < 0) AS neg, count(*) FILTER (WHERE o_orderdate IS NULL) AS nodate, count(*) - count(DISTINCT o_orderkey) AS twice, count(*) FILTER (WHERE o_totalprice > 400000) AS large FROM orders),
s AS (SELECT CASE WHEN neg > 0 THEN 'fail' ELSE 'ok' END AS a, CASE WHEN nodate > 0 OR twice > 0 THEN 'fail' ELSE 'ok' END AS b, CASE WHEN large > 0 THEN 'warn' ELSE 'ok' END AS c FROM c)
SELECT mode, CASE WHEN a = 'fail' OR b = 'fail' OR c = 'fail' THEN 'fail' WHEN mode <> 'smoke' AND (a = 'warn' OR b = 'warn' OR c = 'warn') THEN 'warn' ELSE 'ok' END AS status FROM s, (VALUES ('research'), ('smoke')) m(mode)""")
def pipeline_status(spark, sf):
    """Status of a run by mode, from the steps' own checks of the orders."""
    o = panel.read(spark, sf, "orders")
    n = o.agg(F.count_if(F.col("o_totalprice") < 0).alias("neg"), F.count_if(F.col("o_orderdate").isNull()).alias("nodate"), (F.count(F.lit(1)) - F.count_distinct("o_orderkey")).alias("twice"), F.count_if(F.col("o_totalprice") > 400000).alias("large")).first()
    steps = {"values": "fail" if n["neg"] else "ok", "keys": "fail" if n["nodate"] or n["twice"] else "ok", "outliers": "warn" if n["large"] else "ok"}
    return spark.createDataFrame([(m, quality.overall_status(steps, m)) for m in ("research", "smoke")], "mode string, status string")


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def json_sink(spark, sf):
    """A result written as JSON lines and read back."""
    path = shared.folder(spark, "json")
    catalog.write_json(panel.read(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("c_acctbal"), 4).alias("mean")), path)
    return catalog.scan_json(spark, path, "segment string, n bigint, mean double")


@query("SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM customer) AS customers, 'ok' AS status")
def run_receipt(spark, sf):
    """A run's receipt, written beside its results and read back as VARIANT."""
    path = f"{shared.folder(spark, 'receipt')}/receipt.json"
    tables = {"orders": panel.read(spark, sf, "orders"), "customers": panel.read(spark, sf, "customer")}
    catalog.write_text(spark, json.dumps(json.loads(catalog.receipt(tables, {"mode": "research"}, {"load": "ok"}))), path)
    v = spark.read.text(path).select(F.parse_json("value").alias("v"))
    return v.select(F.variant_get("v", "$.rows.orders", "bigint").alias("orders"), F.variant_get("v", "$.rows.customers", "bigint").alias("customers"), F.variant_get("v", "$.steps.load", "string").alias("status"))


@query("SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS top FROM orders GROUP BY 1, 2")
def replaced_partitions(spark, sf):
    """A partitioned table of which one partition is replaced twice by the same rows and the others stay; then the same dates are appended, which adds nothing."""
    top = shared.folder(spark, "parts")
    rows = panel.read(spark, sf, "orders").groupBy("o_orderpriority", F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("top"))
    rows.write.partitionBy("o_orderpriority").parquet(f"{top}/a")
    for _ in range(2):
        catalog.replace_partitions(rows.where("o_orderpriority = '5-LOW'"), f"{top}/a", "o_orderpriority")
    catalog.overwrite(spark.read.parquet(f"{top}/a"), f"{top}/b")
    catalog.append_new_dates(rows, f"{top}/b")
    return spark.read.parquet(f"{top}/b").select("o_orderpriority", "date", "top")


@query(f"""WITH {MKT}, p AS (SELECT date, CASE WHEN count(r_alts) OVER w >= 10 THEN avg(CASE WHEN r_alts > 0 THEN 1.0 WHEN r_alts IS NOT NULL THEN 0.0 END) OVER w END AS s FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
v AS (SELECT date, CASE WHEN count(*) OVER w = 30 AND sum(abs(r_alts)) OVER w <> 0 THEN sum(abs(r_major)) OVER w / sum(abs(r_alts)) OVER w END AS v FROM mkt WINDOW w AS (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
q AS (SELECT date, CASE WHEN max(v) OVER w > min(v) OVER w THEN (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) END AS s FROM v WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT monitor, date, round(s, 6) AS score_raw, CASE WHEN s IS NOT NULL THEN CAST(least(5, floor(s * 5) + 1) AS INTEGER) END AS regime_1_5 FROM (SELECT 'persistence' AS monitor, * FROM p UNION ALL SELECT 'relative_value', * FROM q)""")
def monitor_scores(spark, sf):
    """Two monitors of the market by the common interface."""
    mine = (monitors.Persistence("persistence", "r_alts"), monitors.RelativeValue("relative_value", "a_major", "a_alts"))
    for m in mine:
        if m.name not in monitors.MONITORS:
            monitors.register(m)
    d = mkt(spark, sf).withColumns({"a_major": F.abs("r_major"), "a_alts": F.abs("r_alts")})
    return monitors.run(d, [m.name for m in mine]).select("monitor", "date", rnd("score_raw").alias("score_raw"), "regime_1_5")

