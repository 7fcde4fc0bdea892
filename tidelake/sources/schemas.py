"""Declared tables. A reader passes the DDL, so nothing is inferred and the columns are checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Names, columns and types of the tables.
TABLES = {
    "dim_asset": "asset_id string, symbol string, name string, chain string, contract_address string, coingecko_id string, is_stable boolean, is_wrapped_stable boolean, metadata_json string",
    "dim_instrument": "instrument_id string, venue string, instrument_symbol string, instrument_type string, quote string, base_asset_symbol string, asset_id string, multiplier double, metadata_json string",
    "map_provider_asset": "provider string, provider_asset_id string, asset_id string, valid_from date, valid_to date, mapping_method string, confidence double",
    "map_provider_instrument": "provider string, provider_instrument_id string, instrument_id string, valid_from date, valid_to date, mapping_method string, confidence double",
    "map_category_asset": "asset_id string, category_id string, category_name string, source string",
    "fact_price": "asset_id string, date date, close double, source string",
    "fact_marketcap": "asset_id string, date date, marketcap double, source string",
    "fact_volume": "asset_id string, date date, volume double, source string",
    "fact_funding": "asset_id string, instrument_id string, date date, funding_rate double, exchange string, source string",
    "fact_ohlc": "asset_id string, date date, open double, high double, low double, close double, source string",
    "fact_open_interest": "asset_id string, date date, open_interest_usd double, source string",
    "fact_liquidations": "asset_id string, date date, long_liquidation_usd double, short_liquidation_usd double, source string",
    "fact_exchange_volume": "exchange_id string, date date, volume_btc double, volume_usd double, source string",
    "fact_global_market_history": "date date, market_cap_btc double, market_cap_usd double, source string",
    "fact_trending_searches": "date date, item_type string, item_id string, item_name string, item_symbol string, rank int, source string",
    "dim_new_listings": "asset_id string, symbol string, name string, listing_date date, coingecko_id string, source string",
    "dim_categories": "category_id string, category_name string, source string",
    "universe_eligibility": "rebalance_date date, snapshot_date date, asset_id string, symbol string, marketcap double, volume_14d double, eligible boolean, first_seen_date date, exclusion_reason string",
    "basket_snapshots": "rebalance_date date, snapshot_date date, asset_id string, symbol string, basket_name string, rank int, weight double, marketcap double, volume_14d double",
    "silver_fact_price": "asset_id string, date date, close double, source string, is_winsorized boolean, is_ffilled boolean",
    "silver_fact_funding": "asset_id string, instrument_id string, exchange string, date date, funding_rate_raw_pct double, source string, is_ffilled boolean, is_capped boolean",
    "silver_fact_marketcap": "asset_id string, date date, market_cap double, source string, is_winsorized boolean",
    "repair_log": "dataset string, symbol string, date string, action string, rule string, old_value double, new_value double, notes string",
    "backtest_results": "date date, r_btc double, r_basket double, r_ls double, cost double, r_ls_net double, equity_curve double",
    "rebalance_turnover": "rebalance_date date, turnover double, entered_count int, exited_count int, num_constituents int",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """The table without rows."""
    return spark.createDataFrame([], TABLES[table])


def read(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(path)
