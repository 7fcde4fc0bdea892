"""Symbols, instruments, identifiers, categories, and time-valid mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Forms of symbols that data providers use.
QUOTES = ("USDT", "USD")
SUFFIXES = ("-PERP", "PERP", "-USDT", "-USD")
WRAPPED_BASES = ("BTC", "ETH", "SOL", "AVAX", "MATIC", "BNB")
NAME_SUBSTRINGS = ("USD", "EUR", "GBP", "DAI", "BULL", "BEAR", "UP", "DOWN")


def normalize_symbol(c: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Upper case without white space, prefixes and suffixes (each taken off once, in order), then without - / : ."""
    out = F.upper(F.regexp_replace(c, r"\s+", ""))
    for p in prefixes:
        out = F.regexp_replace(out, f"^{p}", "")
    for s in suffixes:
        out = F.regexp_replace(out, f"{s}$", "")
    return F.regexp_replace(out, "[-/:]", "")


def parse_instrument(c: Column) -> Column:
    """Struct of multiplier, base and quote of an instrument symbol such as 1000ABCUSDT."""
    pattern = rf"^(\d*)(.*?)({'|'.join(QUOTES)})?$"
    part = lambda i: F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))
    return F.struct(F.coalesce(part(1).cast("double"), F.lit(1.0)).alias("multiplier"), part(2).alias("base"), part(3).alias("quote"))


def asset_id(symbol: Column, chain: Column, contract: Column) -> Column:
    """CHAIN_address in lower case without 0x, else the symbol in upper case."""
    address = F.regexp_replace(F.lower(F.trim(contract)), "^0x", "")
    return F.when(chain.isNotNull() & (F.trim(contract) != ""), F.concat_ws("_", F.upper(F.trim(chain)), address)).otherwise(F.upper(F.trim(symbol)))


def excluded_by_name(symbol: Column, denied: Sequence[str] = ()) -> Column:
    """Names that say stable, fiat or leveraged; wrapped forms of large coins; a denylist."""
    s = F.upper(symbol)
    return s.rlike("|".join(NAME_SUBSTRINGS)) | s.rlike(f"^W({'|'.join(WRAPPED_BASES)})$") | s.isin(*[d.upper() for d in denied])


def exclusion_set(dim: DataFrame, categories: DataFrame, flags: Sequence[str], category_ids: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """asset_id, category of all assets that are not eligible: by flag, by category, by list."""
    spark = dim.sparkSession
    parts = [dim.where(F.col(f)).select("asset_id", F.lit(f).alias("category")) for f in flags]
    parts.append(categories.where(F.col("category_id").isin(*category_ids)).select("asset_id", F.col("category_id").alias("category")))
    if extra:
        parts.append(spark.createDataFrame([(x, "listed") for x in extra], "asset_id string, category string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def dim_from_symbols(symbols: DataFrame, stables: DataFrame, column: str = "symbol") -> DataFrame:
    """One row a symbol: asset_id, symbol, a placeholder name, is_stable, metadata as JSON."""
    flag = stables.select(F.upper(column).alias("_s")).distinct().withColumn("is_stable", F.lit(True))
    d = symbols.select(F.upper(F.trim(column)).alias("symbol")).where("symbol <> ''").distinct().join(flag, F.col("symbol") == F.col("_s"), "left").drop("_s")
    d = d.withColumn("is_stable", F.coalesce("is_stable", F.lit(False)))
    return d.select(F.lower("symbol").alias("asset_id"), "symbol", F.col("symbol").alias("name"), "is_stable", F.to_json(F.struct("symbol", "is_stable")).alias("metadata_json"))


def match_category(names: DataFrame, categories: DataFrame, gram: int = 3) -> DataFrame:
    """category_name -> category_id: exact, else equal without marks, else one within the other; the best, then smallest id; null without one.

    Three joins by key: names, names without marks, and for what is left a join by one run of characters: the shorter of two names, one of which holds the other,
    starts with a run of `gram` characters that the longer one has somewhere. So each plain name is taken once by its first run and once by all its runs; names shorter than that
    join by their whole selves. Only pairs that share the run are compared."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")
    n = names.select("name").distinct().withColumns({"_l": F.lower("name"), "_p": plain(F.col("name"))})
    c = categories.select("category_id", F.lower("category_name").alias("_cl"), plain(F.col("category_name")).alias("_cp"))
    exact = n.join(c, F.col("_l") == F.col("_cl")).select("name", "category_id", F.lit(0).alias("_score"))
    same = n.join(c, F.col("_p") == F.col("_cp")).select("name", "category_id", F.lit(1).alias("_score"))
    open_ = n.where(F.col("name").isNotNull()).join(exact.unionByName(same).select("name").distinct(), "name", "left_anti")

    def runs(p: str) -> Column:  # every run of 0 to gram characters that a shorter name may start with
        upto = lambda k: F.when(F.length(p) >= k, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - k + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(F.lit("")), *(upto(k) for k in range(1, gram + 1))))

    first = lambda p: F.substring(p, 1, gram)
    within = open_.select("name", "_p", first("_p").alias("_g")).join(c.select("category_id", "_cp", F.explode(runs("_cp")).alias("_g")), "_g").where(F.col("_cp").contains(F.col("_p")))
    holds = open_.select("name", "_p", F.explode(runs("_p")).alias("_g")).join(c.select("category_id", "_cp", first("_cp").alias("_g")), "_g").where(F.col("_p").contains(F.col("_cp")))
    loose = within.select("name", "category_id").unionByName(holds.select("name", "category_id")).withColumn("_score", F.lit(2))
    best = exact.unionByName(same).unionByName(loose).groupBy("name").agg(F.min(F.struct("_score", "category_id"))["category_id"].alias("category_id"))
    return names.select("name").distinct().join(best, "name", "left").select("name", "category_id")


def link_instruments(instruments: DataFrame, dim: DataFrame) -> DataFrame:
    """asset_id of instruments by base symbol, else by id; what stays null is unlinked."""
    by_symbol = dim.select(F.upper("symbol").alias("_s"), F.col("asset_id").alias("_a")).groupBy("_s").agg(F.min("_a").alias("_a"))
    by_id = dim.select(F.upper("asset_id").alias("_i"), F.col("asset_id").alias("_b")).groupBy("_i").agg(F.min("_b").alias("_b"))
    base = F.upper("base_asset_symbol")
    out = instruments.join(by_symbol, base == F.col("_s"), "left").join(by_id, base == F.col("_i"), "left")
    keep = [c for c in instruments.columns if c != "asset_id"]
    return out.select(*keep, F.coalesce("_a", "_b").alias("asset_id"))


def map_with_confidence(provider: DataFrame, dim: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """provider_id -> asset_id with method and confidence: an override, an exact match (1.0), or a fallback (0.8)."""
    d = dim.select(F.col("asset_id").alias("_a"), F.lower("symbol").alias("_s"))
    out = provider.join(d, F.lower("provider_id") == F.col("_s"), "left")
    out = out.withColumns({"asset_id": F.coalesce("_a", F.upper("provider_id")), "mapping_method": F.when(F.col("_a").isNotNull(), "exact").otherwise("fallback"), "confidence": F.when(F.col("_a").isNotNull(), 1.0).otherwise(0.8)}).drop("_a", "_s")
    if overrides is None:
        return out
    o = overrides.select("provider_id", F.col("asset_id").alias("_o"))
    out = out.join(o, "provider_id", "left")
    hit = F.col("_o").isNotNull()
    return out.withColumns({"asset_id": F.coalesce("_o", "asset_id"), "mapping_method": F.when(hit, "manual").otherwise(F.col("mapping_method")), "confidence": F.when(hit, 1.0).otherwise(F.col("confidence"))}).drop("_o")


def map_tickers(venue: DataFrame, panel: DataFrame, ticker: str = "ticker", symbol: str = "symbol") -> tuple[DataFrame, DataFrame]:
    """Matched (ticker, symbol) by normalized name, and the tickers without a match."""
    v = venue.select(ticker).distinct().withColumn("_n", normalize_symbol(F.col(ticker)))
    p = panel.select(symbol).distinct().withColumn("_n", normalize_symbol(F.col(symbol)))
    return v.join(p, "_n").select(ticker, symbol), v.join(p, "_n", "left_anti").select(ticker)


def presence(candidates: DataFrame, venues: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Candidates with a flag for each venue that lists them."""
    out = candidates
    for name, v in venues.items():
        out = out.join(v.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys stand on both sides, on the left and on the right only, and the share of the left that is covered."""
    a = left.select(key).distinct().withColumn("_a", F.lit(True))
    b = right.select(key).distinct().withColumn("_b", F.lit(True))
    x = a.join(b, key, "full")
    on = lambda c: F.col(c).isNotNull()
    return x.agg(F.count_if(on("_a") & on("_b")).alias("both"), F.count_if(on("_a") & ~on("_b")).alias("left_only"), F.count_if(~on("_a") & on("_b")).alias("right_only"), (100.0 * F.count_if(on("_a") & on("_b")) / F.greatest(F.count_if(on("_a")), F.lit(1))).alias("pct"))


def not_unique(mapping: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that map to several values, with these."""
    return mapping.groupBy(key).agg(F.count_distinct(value).alias("n"), F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("values")).where("n > 1")


def join_sanity(left: DataFrame, rights: Mapping[str, DataFrame], key: str, sample: int = 20, seed: int = 42) -> DataFrame:
    """Up to `sample` keys drawn by a hash of key and seed (the same ones however the rows lie), with a flag for each table that has them."""
    drawn = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return presence(left.select(key).distinct().orderBy(drawn, key).limit(sample), rights, key)


def conflicts(dim: DataFrame, prices: DataFrame, size: str, key: str = "asset_id", symbol: str = "symbol", top: int = 20) -> tuple[DataFrame, DataFrame]:
    """The largest assets without a price, and symbols that several assets share."""
    missing = dim.join(prices.select(key).distinct(), key, "left_anti").orderBy(F.desc(size), key).limit(top)
    return missing, dim.groupBy(symbol).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_guardrails(mapping: DataFrame, facts: DataFrame, key: str, least_pct: float = 85.0) -> None:
    """Raises unless enough of the facts' keys are mapped, each to one value."""
    pct = coverage(facts, mapping, key).first()["pct"]
    if pct < least_pct:
        raise ValueError(f"coverage {pct:.1f} % is below {least_pct} %")
    bad = not_unique(mapping, key, "asset_id").limit(5).collect()
    if bad:
        raise ValueError(f"not unique: {[r[0] for r in bad]}")


def perp_listings(payload: DataFrame) -> DataFrame:
    """Perpetual listings from an exchange's JSON text (column payload): symbol, base, onboard_date."""
    symbol = "struct<symbol:string,baseAsset:string,quoteAsset:string,contractType:string,onboardDate:bigint>"
    s = payload.select(F.explode(F.from_json("payload", f"struct<symbols:array<{symbol}>>")["symbols"]).alias("s"))
    s = s.where((F.col("s.contractType") == "PERPETUAL") & (F.col("s.quoteAsset") == "USDT"))
    return s.select(F.col("s.symbol").alias("symbol"), F.col("s.baseAsset").alias("base"), F.to_date(F.timestamp_millis("s.onboardDate")).alias("onboard_date"))


def venue_universe(payload: DataFrame) -> DataFrame:
    """Names and largest leverage of a venue's universe array."""
    u = payload.select(F.explode(F.from_json("payload", "struct<universe:array<struct<name:string,maxLeverage:int,isDelisted:boolean>>>")["universe"]).alias("u"))
    return u.where(~F.coalesce(F.col("u.isDelisted"), F.lit(False))).select(F.col("u.name").alias("ticker"), F.col("u.maxLeverage").alias("max_leverage"))
