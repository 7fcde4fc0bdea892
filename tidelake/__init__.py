"""Daily-market analytics on Spark: lake and catalog, curation, universe, windows, features, backtests, gates."""
