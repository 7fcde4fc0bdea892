"""The SQL book: basket, coverage and mapping questions in plain SQL over the catalog's views."""

from __future__ import annotations

from ..sources import catalog
from .registry import P1, P3, SNAP, query, steady


def _sql(text: str):
    """A query whose Spark side is SQL too, over views of the tables."""

    def run(spark, sf):
        catalog.create_views(spark, sf)
        return spark.sql(text)

    return run


def _both(name: str, spark_sql: str, duck_sql: str | None = None) -> None:
    query(duck_sql or spark_sql, name)(_sql(steady(spark_sql)))


_ELIG = "elig AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS rebalance_date, l_suppkey AS asset_id, sum(l_extendedprice) AS mcap, count(*) AS n_rows, CASE WHEN sum(l_extendedprice) < 30000 THEN 'below_min_mcap' WHEN count(*) < 2 THEN 'below_min_volume' END AS exclusion_reason FROM lineitem GROUP BY 1, 2)"

_both("sql_topn_on_date", f"WITH {SNAP} SELECT asset_id, rank, round(weight, 6) AS weight FROM snap WHERE rebalance_date = DATE '1998-03-01' ORDER BY rank LIMIT 10")
_both("sql_basket_change", f"""WITH {SNAP}, a AS (SELECT asset_id FROM snap WHERE rebalance_date = DATE '1998-03-01'), b AS (SELECT asset_id FROM snap WHERE rebalance_date = DATE '1998-04-01')
SELECT coalesce(a.asset_id, b.asset_id) AS asset_id, CASE WHEN a.asset_id IS NULL THEN 'ENTERED' WHEN b.asset_id IS NULL THEN 'EXITED' ELSE 'MAINTAINED' END AS status FROM a FULL OUTER JOIN b ON a.asset_id = b.asset_id""")
_both("sql_turnover_counts", f"""WITH {SNAP}, dates AS (SELECT rebalance_date, lag(rebalance_date) OVER (ORDER BY rebalance_date) AS prev FROM (SELECT DISTINCT rebalance_date FROM snap)), pairs AS (SELECT * FROM dates WHERE prev IS NOT NULL)
SELECT p.rebalance_date, count(DISTINCT CASE WHEN o.asset_id IS NULL THEN n.asset_id END) AS entered, count(DISTINCT CASE WHEN o.asset_id IS NOT NULL THEN n.asset_id END) AS kept
FROM pairs p JOIN snap n ON n.rebalance_date = p.rebalance_date LEFT JOIN snap o ON o.rebalance_date = p.prev AND o.asset_id = n.asset_id GROUP BY p.rebalance_date""")
_both("sql_edits_last_30d", "SELECT event_type, count(*) AS edits, count(DISTINCT user_id) AS assets, CAST(min(ts) AS DATE) AS first_day FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-30' - INTERVAL '20 days' GROUP BY event_type")
_both("sql_coverage_pct", f"WITH {P1} SELECT asset_id, count(*) AS days, count(*) FILTER (WHERE close > 50) AS high_days, round(100.0 * count(*) FILTER (WHERE close > 50) / count(*), 4) AS pct FROM p1 GROUP BY asset_id")
_both("sql_first_last_appearance", f"WITH {SNAP} SELECT asset_id, min(rebalance_date) AS first_seen, max(rebalance_date) AS last_seen, count(DISTINCT rebalance_date) AS n_dates FROM snap GROUP BY asset_id")
_both("sql_count_and_weight", f"WITH {SNAP} SELECT rebalance_date, count(*) AS n, round(sum(weight), 6) AS total_weight, round(max(weight), 6) AS max_weight FROM snap GROUP BY rebalance_date")
_both("sql_rule_breakdown", "SELECT event_type, get_json_object(props, '$.k') AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2", "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2")
_both("sql_lag_returns", f"WITH {P1}, x AS (SELECT asset_id, date, close, lag(close) OVER (PARTITION BY asset_id ORDER BY date) AS prev FROM p1) SELECT asset_id, date, round(close / prev - 1, 6) AS ret FROM x WHERE prev > 0 AND abs(close / prev - 1) > 0.5")
_both("sql_qualify_latest", f"WITH {P1}, x AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS k FROM p1) SELECT asset_id, date, round(close, 6) AS close FROM x WHERE k = 1", f"WITH {P1} SELECT asset_id, date, round(close, 6) AS close FROM p1 QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) = 1")
_both("sql_exclusion_share", f"WITH {_ELIG} SELECT exclusion_reason, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM elig WHERE exclusion_reason IS NOT NULL), 4) AS exclusion_pct FROM elig WHERE exclusion_reason IS NOT NULL GROUP BY exclusion_reason")
_both("sql_coverage_corr_subquery", f"WITH {_ELIG}, {SNAP} SELECT rebalance_date, eligible, large, (SELECT count(*) FROM snap s WHERE s.rebalance_date = e.rebalance_date) AS snapshot_count FROM (SELECT rebalance_date, count(*) AS eligible, count(*) FILTER (WHERE mcap > 100000) AS large FROM elig GROUP BY rebalance_date) e")
_both("sql_perp_counts", f"WITH {_ELIG} SELECT rebalance_date, count(*) FILTER (WHERE exclusion_reason IS NULL) AS ok, count(*) FILTER (WHERE exclusion_reason = 'below_min_mcap') AS small, count(*) FILTER (WHERE exclusion_reason = 'below_min_volume') AS thin FROM elig GROUP BY rebalance_date")
_both("sql_top_offenders", f"WITH {SNAP}, {P3} SELECT s.asset_id, count(*) AS months, round(sum(p.volume), 2) AS volume FROM snap s JOIN p3 p ON p.asset_id = s.asset_id AND p.date = s.rebalance_date GROUP BY s.asset_id ORDER BY volume DESC, s.asset_id LIMIT 15")
_both("sql_pct_with_price", f"WITH {SNAP}, {P3} SELECT s.rebalance_date, count(DISTINCT s.asset_id) AS n, count(DISTINCT CASE WHEN p.close IS NOT NULL THEN s.asset_id END) AS with_price, round(100.0 * count(DISTINCT CASE WHEN p.close IS NOT NULL THEN s.asset_id END) / count(DISTINCT s.asset_id), 4) AS pct FROM snap s LEFT JOIN p3 p ON p.asset_id = s.asset_id AND p.date = s.rebalance_date GROUP BY s.rebalance_date")
_both("sql_having_dupes", "SELECT p_name, count(DISTINCT p_partkey) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) > 1")
_both("sql_missing_antijoin", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderdate >= TIMESTAMP '1999-01-01 00:00:00' WHERE o.o_orderkey IS NULL")
_both("sql_string_agg", "SELECT r_name, listagg(DISTINCT n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, string_agg(DISTINCT n_name, ', ' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_both("sql_fanout_spotcheck", """WITH o AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT CAST(o_orderdate AS DATE)) AS n_days FROM orders GROUP BY o_custkey), l AS (SELECT o_custkey, count(*) AS n_lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(n_days, 0) AS n_days, coalesce(n_lines, 0) AS n_lines FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN l ON l.o_custkey = c_custkey""")
_both("sql_nullif_positional", "SELECT s_nationkey, count(*) AS n, round(sum(s_acctbal) / nullif(count(*) FILTER (WHERE s_acctbal > 0), 0), 4) AS per_positive FROM supplier GROUP BY 1 ORDER BY 3 DESC NULLS LAST, 1")
