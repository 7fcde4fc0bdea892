"""Queries of scans, reshaping, joins and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof, mapping
from ..sources import catalog, panel
from .registry import P1, P2, P3, P4, SNAP, p1, p2, p3, p4, query, rnd, snap

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query(f"WITH {P2} SELECT date, asset_id AS symbol, round(close, 4) AS close FROM p2")
def unpivot_long(spark, sf):
    wide = panel.to_wide(p2(spark, sf), "date", "asset_id", "close", PRIORITIES)
    return panel.to_long(wide, ["date"], "symbol", "close").select("date", "symbol", rnd("close", 4).alias("close"))


@query(f"WITH {P2} SELECT date, " + ", ".join(f"round(min(CASE WHEN asset_id = '{p}' THEN close END), 4) AS p{p[0]}" for p in PRIORITIES) + " FROM p2 GROUP BY date")
def pivot_wide(spark, sf):
    wide = panel.to_wide(p2(spark, sf), "date", "asset_id", "close", PRIORITIES)
    return wide.select("date", *(rnd(F.col(f"`{p}`"), 4).alias(f"p{p[0]}") for p in PRIORITIES))


@query(f"""WITH {P3}, g AS (SELECT asset_id, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM p3 GROUP BY asset_id)
SELECT asset_id, count(*) AS days, count(close) AS priced FROM g LEFT JOIN p3 USING (asset_id, date) GROUP BY asset_id""")
def densify_asset(spark, sf):
    return panel.densify(p3(spark, sf)).groupBy("asset_id").agg(F.count(F.lit(1)).alias("days"), F.count("close").alias("priced"))


@query(f"""WITH {P3}, b AS (SELECT min(date) AS a, max(date) AS b FROM p3), g AS (SELECT asset_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT DISTINCT asset_id FROM p3), b)
SELECT date, count(*) AS cells, count(close) AS priced FROM g LEFT JOIN p3 USING (asset_id, date) GROUP BY date""")
def align_global(spark, sf):
    return panel.align(p3(spark, sf)).groupBy("date").agg(F.count(F.lit(1)).alias("cells"), F.count("close").alias("priced"))


@query("SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark, sf):
    e = panel.read(spark, sf, "events").select(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"), "event_id", "value", "ts")
    return panel.dedup(e, ["asset_id", "date"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT user_id AS asset_id, CAST(ts AS DATE) AS date, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1")
def dedup_first(spark, sf):
    e = panel.read(spark, sf, "events").select(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"), "event_id", "value", "ts")
    return panel.dedup(e, ["asset_id", "date"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_guard(spark, sf):
    e = panel.read(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"))
    return panel.duplicates(e, ["user_id", "date"])


@query(f"""WITH {P1}, z AS (SELECT asset_id, date, CASE WHEN day(date) <= asset_id % 9 THEN 0.0 ELSE close END AS a, CASE WHEN day(date) <= asset_id % 5 THEN 0.0 ELSE volume END AS b FROM p1), f AS (SELECT asset_id, min(date) FILTER (WHERE a > 0 OR b > 0) AS f FROM z GROUP BY asset_id)
SELECT z.asset_id, date, round(a, 6) AS a, round(b, 6) AS b FROM z JOIN f ON f.asset_id = z.asset_id WHERE date >= f""")
def trim_leading_zero(spark, sf):
    d = p1(spark, sf)
    d = d.select("asset_id", "date", F.when(F.dayofmonth("date") <= F.col("asset_id") % 9, 0.0).otherwise(F.col("close")).alias("a"), F.when(F.dayofmonth("date") <= F.col("asset_id") % 5, 0.0).otherwise(F.col("volume")).alias("b"))
    return panel.trim_leading_zeros(d, ["a", "b"]).select("asset_id", "date", rnd("a").alias("a"), rnd("b").alias("b"))


@query(f"WITH {P4} SELECT asset_id, date, count(*) AS n, round(sum(CASE WHEN date >= DATE '1998-01-01' THEN rate / 100 ELSE rate END), 8) AS rate FROM p4 GROUP BY asset_id, date")
def unit_cutover(spark, sf):
    return panel.unit_cutover(p4(spark, sf), "rate", "1998-01-01").groupBy("asset_id", "date").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("rate"), 8).alias("rate"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(regexp_replace(p_brand, '\\s+', '', 'g')), '^BRAND', ''), '[-/:]', '', 'g') AS symbol FROM part".replace("\\\\", "\\"))
def normalize_symbol(spark, sf):
    return panel.read(spark, sf, "part").select("p_partkey", mapping.normalize_symbol(F.col("p_brand"), prefixes=("BRAND",)).alias("symbol"))


@query("""WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '1000' ELSE '' END || upper(substr(p_name, 1, 4)) || CASE p_size % 2 WHEN 0 THEN 'USDT' ELSE 'USD' END AS s FROM part)
SELECT p_partkey, coalesce(TRY_CAST(nullif(regexp_extract(s, '^(\\d*)(.*?)(USDT|USD)?$', 1), '') AS DOUBLE), 1.0) AS multiplier, nullif(regexp_extract(s, '^(\\d*)(.*?)(USDT|USD)?$', 2), '') AS base, nullif(regexp_extract(s, '^(\\d*)(.*?)(USDT|USD)?$', 3), '') AS quote FROM s""")
def parse_instrument(spark, sf):
    s = F.concat(F.when(F.col("p_size") % 3 == 0, "1000").otherwise(""), F.upper(F.substring("p_name", 1, 4)), F.when(F.col("p_size") % 2 == 0, "USDT").otherwise("USD"))
    return panel.read(spark, sf, "part").select("p_partkey", mapping.parse_instrument(s).alias("i")).select("p_partkey", "i.*")


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN 'ETH_' || lower('AB' || s_suppkey) ELSE upper(trim(s_name)) END AS asset_id FROM supplier")
def canonical_id(spark, sf):
    s = panel.read(spark, sf, "supplier")
    even = F.col("s_nationkey") % 2 == 0
    return s.select("s_suppkey", mapping.asset_id(F.col("s_name"), F.when(even, F.lit("eth")), F.when(even, F.concat(F.lit("0xAB"), F.col("s_suppkey").cast("string")))).alias("asset_id"))


@query("SELECT n_nationkey, n_name, (regexp_matches(upper(n_name), 'USD|EUR|GBP|DAI|BULL|BEAR|UP|DOWN') OR regexp_matches(upper(n_name), '^W(BTC|ETH|SOL|AVAX|MATIC|BNB)$') OR upper(n_name) IN ('FRANCE', 'CHINA')) AS excluded FROM nation")
def name_rules(spark, sf):
    return panel.read(spark, sf, "nation").select("n_nationkey", "n_name", mapping.excluded_by_name(F.col("n_name"), ["France", "China"]).alias("excluded"))


@query("SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0 AND s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def exclusion_antijoin(spark, sf):
    s, n = panel.read(spark, sf, "supplier"), panel.read(spark, sf, "nation").where("n_regionkey = 1")
    return s.where("s_acctbal >= 0").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("s_suppkey")


@query("SELECT lower(n_name) AS asset_id, upper(n_name) AS symbol, n_name IN (SELECT n_name FROM nation WHERE n_regionkey = 2) AS is_stable FROM nation")
def build_dim(spark, sf):
    n = panel.read(spark, sf, "nation").withColumnRenamed("n_name", "symbol")
    return mapping.dim_from_symbols(n, n.where("n_regionkey = 2")).select("asset_id", "symbol", "is_stable")


_MATCH = "lower(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'))"


@query(f"""WITH n AS (SELECT DISTINCT p_type AS name FROM part), c AS (SELECT r_regionkey AS category_id, r_name AS c FROM region UNION ALL SELECT 100 + n_nationkey, n_name FROM nation), x AS (SELECT DISTINCT substr(name, 1, 5) AS name FROM n UNION SELECT n_name || ' coins' FROM nation UNION SELECT lower(r_name) FROM region),
j AS (SELECT x.name, category_id, CASE WHEN lower(name) = lower(c) THEN 0 WHEN {_MATCH.format('name')} = {_MATCH.format('c')} THEN 1 ELSE 2 END AS s FROM x LEFT JOIN c ON lower(name) = lower(c) OR contains({_MATCH.format('name')}, {_MATCH.format('c')}) OR contains({_MATCH.format('c')}, {_MATCH.format('name')}))
SELECT name, CAST(category_id AS INTEGER) AS category_id FROM j QUALIFY row_number() OVER (PARTITION BY name ORDER BY s, category_id) = 1""")
def fuzzy_category(spark, sf):
    n, r = panel.read(spark, sf, "nation"), panel.read(spark, sf, "region")
    c = r.select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("category_name")).unionByName(n.select((F.col("n_nationkey") + 100).alias("category_id"), F.col("n_name").alias("category_name")))
    names = panel.read(spark, sf, "part").select(F.substring("p_type", 1, 5).alias("name")).union(n.select(F.concat("n_name", F.lit(" coins")))).union(r.select(F.lower("r_name"))).distinct()
    return mapping.match_category(names, c)


@query(f"""WITH {P2}, a AS (SELECT asset_id, avg(close) AS close_mean, stddev_samp(close) AS close_std, count(close) AS close_count, avg(volume) AS volume_mean, stddev_samp(volume) AS volume_std, count(volume) AS volume_count FROM p2 GROUP BY asset_id)
SELECT asset_id, round(close_mean, 3) AS close_mean, round(close_std, 3) AS close_std, close_count, round(volume_mean, 6) AS volume_mean, round(volume_std, 6) AS volume_std, volume_count FROM a""")
def measure_pivot(spark, sf):
    x = panel.melt_two_and_pivot(p2(spark, sf), "asset_id", ["close", "volume"])
    return x.select("asset_id", rnd("close_mean", 3).alias("close_mean"), rnd("close_std", 3).alias("close_std"), "close_count", rnd("volume_mean").alias("volume_mean"), rnd("volume_std").alias("volume_std"), "volume_count")


_OLD = "old AS (SELECT asset_id, date, CASE WHEN asset_id % 4 <> 0 THEN close END AS close, volume FROM p1 WHERE date <= DATE '2024-01-20'), new AS (SELECT asset_id, date, close * 2 AS close, volume * 2 AS volume FROM p1 WHERE date >= DATE '2024-01-15')"


def _old_new(spark, sf):
    d = p1(spark, sf)
    old = d.where("date <= date'2024-01-20'").select("asset_id", "date", F.when(F.col("asset_id") % 4 != 0, F.col("close")).alias("close"), "volume")
    new = d.where("date >= date'2024-01-15'").select("asset_id", "date", (F.col("close") * 2).alias("close"), (F.col("volume") * 2).alias("volume"))
    return old, new


def _cv(df):
    return df.select("asset_id", "date", rnd("close").alias("close"), rnd("volume").alias("volume"))


_FULL = "SELECT coalesce(o.asset_id, n.asset_id) AS asset_id, coalesce(o.date, n.date) AS date, round(coalesce({0}.close, {1}.close), 6) AS close, round(coalesce({0}.volume, {1}.volume), 6) AS volume FROM old o FULL JOIN new n ON n.asset_id = o.asset_id AND n.date = o.date"


@query(f"WITH {P1}, {_OLD} {_FULL.format('o', 'n')}")
def combine_first(spark, sf):
    old, new = _old_new(spark, sf)
    return _cv(catalog.combine_first(old, new, ["asset_id", "date"]))


@query(f"WITH {P1}, {_OLD} {_FULL.format('n', 'o')}")
def combine_new_wins(spark, sf):
    old, new = _old_new(spark, sf)
    return _cv(catalog.combine_first(new, old, ["asset_id", "date"]))


@query(f"""WITH {P1}, {_OLD}, s AS (SELECT DISTINCT asset_id FROM old WHERE asset_id % 3 = 0) SELECT asset_id, date, round(close, 6) AS close, round(volume, 6) AS volume FROM old WHERE NOT (asset_id IN (SELECT asset_id FROM s) AND date BETWEEN DATE '2024-01-10' AND DATE '2024-01-18')
UNION ALL SELECT asset_id, date, round(close, 6), round(volume, 6) FROM new WHERE asset_id % 3 = 0 AND date <= DATE '2024-01-18'""")
def slice_replace(spark, sf):
    old, new = _old_new(spark, sf)
    symbols = old.where("asset_id % 3 = 0").select("asset_id")
    return _cv(catalog.replace_slice(old, new.where("asset_id % 3 = 0 and date <= date'2024-01-18'"), symbols, "asset_id", "date", "2024-01-10", "2024-01-18"))


@query(f"WITH {P1}, {_OLD} SELECT asset_id, date, round(close, 6) AS close, round(volume, 6) AS volume FROM new UNION ALL SELECT asset_id, date, round(close, 6), round(volume, 6) FROM old o WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.asset_id = o.asset_id AND n.date = o.date)")
def upsert_latest(spark, sf):
    return _cv(catalog.upsert(*_old_new(spark, sf), ["asset_id", "date"]))


@query(f"WITH {P1}, {_OLD} SELECT asset_id, date, round(close, 6) AS close, round(volume, 6) AS volume FROM old UNION ALL SELECT asset_id, date, round(close, 6), round(volume, 6) FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.asset_id = o.asset_id AND n.date = o.date)")
def append_missing(spark, sf):
    return _cv(catalog.append_missing(*_old_new(spark, sf), ["asset_id", "date"]))


@query(f"WITH {P1} SELECT asset_id, max(date) AS last_date FROM p1 GROUP BY asset_id")
def high_watermarks(spark, sf):
    return catalog.watermarks(p1(spark, sf), ["asset_id"])


@query(f"WITH {P1} SELECT asset_id, date, round(close, 6) AS close FROM p1 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) <= 5")
def cache_refill(spark, sf):
    d = p1(spark, sf).select("asset_id", "date", "close")
    out = catalog.refill_missing(d.where("asset_id % 2 = 0"), d.select("asset_id").distinct(), d, ["asset_id"], "date", 5)
    return out.select("asset_id", "date", rnd("close").alias("close"))


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 9000")
def first_source(spark, sf):
    none = panel.read(spark, sf, "supplier").where("s_acctbal > 1e12").select(F.col("s_suppkey").alias("id"))
    some = panel.read(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("id"))
    return catalog.first_source_wins([none, some, panel.read(spark, sf, "part").select(F.col("p_partkey").alias("id"))])


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_column(spark, sf):
    return panel.read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# As-of and point-in-time


@query("""SELECT e.event_id, round(b.value, 6) AS buy_value FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON b.user_id = e.user_id AND b.ts <= e.ts""")
def asof_backward(spark, sf):
    e = panel.read(spark, sf, "events")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("buy_value"))
    x = asof.backward(e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), buys, "ts", "at", ["user_id"], ["buy_value"])
    return x.select("event_id", rnd("buy_value").alias("buy_value"))


_WEEKS = "w AS (SELECT asset_id, CAST(unnest(generate_series(DATE '1996-01-04', DATE '2000-12-28', INTERVAL 28 DAY)) AS DATE) AS day FROM (SELECT DISTINCT asset_id FROM p3))"


@query(f"WITH {P3}, {_WEEKS} SELECT w.asset_id, day, round(close, 4) AS close FROM w ASOF LEFT JOIN p3 ON p3.asset_id = w.asset_id AND p3.date <= w.day")
def asof_close_per_date(spark, sf):
    p = p3(spark, sf)
    days = p.select("asset_id").distinct().withColumn("day", F.explode(F.expr("sequence(date'1996-01-04', date'2000-12-28', interval 28 day)")))
    return asof.backward(days, p, "day", "date", ["asset_id"], ["close"]).select("asset_id", "day", rnd("close", 4).alias("close"))


@query(f"WITH {P3} SELECT asset_id, max(date) AS date, round(arg_max(close, date), 4) AS close FROM p3 WHERE date <= DATE '1998-06-30' GROUP BY asset_id")
def latest_per_key(spark, sf):
    return asof.latest_per_key(p3(spark, sf).select("asset_id", "date", "close"), ["asset_id"], "date", F.lit("1998-06-30").cast("date")).select("asset_id", "date", rnd("close", 4).alias("close"))


@query(f"WITH {SNAP} SELECT asset_id, rank, round(weight, 6) AS weight FROM snap WHERE rebalance_date = (SELECT max(rebalance_date) FROM snap WHERE rebalance_date <= DATE '1999-05-17')")
def pit_snapshot(spark, sf):
    return asof.snapshot_at(snap(spark, sf), F.lit("1999-05-17").cast("date")).select("asset_id", "rank", rnd("weight").alias("weight"))


_VALID = "m AS (SELECT s_suppkey AS k, 'A' || s_nationkey AS mapped, DATE '1995-01-01' AS valid_from, DATE '1997-12-31' AS valid_to FROM supplier UNION ALL SELECT s_suppkey, 'B' || s_nationkey, DATE '1998-01-01', NULL FROM supplier WHERE s_suppkey % 3 <> 0)"


@query(f"WITH {P3}, {_VALID} SELECT asset_id, date, mapped FROM p3 LEFT JOIN m ON k = asset_id AND date >= valid_from AND date <= coalesce(valid_to, DATE '9999-12-31')")
def interval_mapping(spark, sf):
    s = panel.read(spark, sf, "supplier")
    day = lambda d: F.lit(d).cast("date")
    m = s.select(F.col("s_suppkey").alias("asset_id"), F.concat(F.lit("A"), "s_nationkey").alias("mapped"), day("1995-01-01").alias("valid_from"), day("1997-12-31").alias("valid_to"))
    m = m.unionByName(s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("asset_id"), F.concat(F.lit("B"), "s_nationkey").alias("mapped"), day("1998-01-01").alias("valid_from"), day(None).alias("valid_to")))
    return asof.in_validity(p3(spark, sf).select("asset_id", "date"), m, "asset_id", "date").select("asset_id", "date", "mapped")


@query("SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS left_only, count(*) FILTER (WHERE b AND NOT a) AS right_only, round(100.0 * count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a), 4) AS pct FROM (SELECT x.k IS NOT NULL AS a, y.k IS NOT NULL AS b FROM (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 8000) x FULL JOIN (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500) y ON x.k = y.k)")
def set_coverage(spark, sf):
    s = panel.read(spark, sf, "supplier").where("s_acctbal > 8000").select(F.col("s_nationkey").alias("k"))
    c = panel.read(spark, sf, "customer").where("c_acctbal > 9500").select(F.col("c_nationkey").alias("k"))
    return mapping.coverage(s, c, "k").withColumn("pct", rnd("pct", 4))


@query("SELECT s_nationkey, count(DISTINCT s_suppkey) AS n, string_agg(DISTINCT CAST(s_suppkey AS VARCHAR), ',' ORDER BY CAST(s_suppkey AS VARCHAR)) AS \"values\" FROM supplier GROUP BY s_nationkey HAVING count(DISTINCT s_suppkey) > 1")
def mapping_uniqueness(spark, sf):
    return mapping.not_unique(panel.read(spark, sf, "supplier"), "s_nationkey", "s_suppkey")


@query("SELECT n_nationkey, n_name, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000) AS suppliers, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) AS customers FROM nation")
def venue_presence(spark, sf):
    n = panel.read(spark, sf, "nation").select("n_nationkey", "n_name")
    s = panel.read(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    c = panel.read(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("n_nationkey"))
    return mapping.presence(n, {"suppliers": s, "customers": c}, "n_nationkey")


@query(f"""WITH {P3}, k AS (SELECT DISTINCT s_suppkey AS asset_id FROM supplier ORDER BY md5('42:' || s_suppkey), s_suppkey LIMIT 20) SELECT asset_id, asset_id IN (SELECT asset_id FROM p3) AS prices FROM k""")
def join_sanity(spark, sf):
    s = panel.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("asset_id"))
    return mapping.join_sanity(s, {"prices": p3(spark, sf)}, "asset_id")


@query("SELECT s_suppkey, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-15 00:00:00') ORDER BY s_acctbal DESC, s_suppkey LIMIT 20")
def missing_price_top(spark, sf):
    s = panel.read(spark, sf, "supplier")
    prices = panel.read(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1995-01-15 00:00:00'").select(F.col("l_suppkey").alias("s_suppkey"))
    return mapping.conflicts(s, prices, "s_acctbal", "s_suppkey", "s_name")[0].select("s_suppkey", rnd("s_acctbal", 2).alias("s_acctbal"))
