"""Landed API payloads to facts: each line parsed once as VARIANT, points exploded, bad lines kept apart.

`landed` has a row a response: kind (one of SHAPES), key (what was asked for: an asset, an exchange), fetched_at (timestamp) and line (the JSON text). `facts(landed, kind)` gives the kind's
fact rows, the newest response winning where several hold the same key; `rejected(landed)` gives the lines that give no
facts, with the reason, so that nothing is lost silently:

* `not json`; `unknown kind`;
* `error: <msg>` where the response has a code other than "0" (`retry` is true for rate limits, false for what no retry mends);
* `no data`: JSON without a usable point, or without the kind's list.

Points without a time or value, or whose values aren't numbers, are no points. Days are UTC.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names that responses use for the two sides of liquidations.
LONG_NAMES = ["aggregated_long_liquidation_usd", "long_liquidation_usd", "longLiquidationUsd"]
SHORT_NAMES = ["aggregated_short_liquidation_usd", "short_liquidation_usd", "shortLiquidationUsd"]

LANDED = "kind string, key string, fetched_at timestamp, line string"


def _get(v: Column | str, path: str, kind: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _day(ms: Column) -> Column:
    return F.to_date(F.timestamp_millis(ms))


def _points(x: DataFrame, path: str) -> DataFrame:
    """A row an element of a list, with its place."""
    return x.select("key", "fetched_at", F.posexplode(_get("v", path, "array<variant>")).alias("at", "p"))


def _newest(x: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the row of the newest response (of equal times the one with the largest values)."""
    values = [c for c in x.columns if c not in (*keys, "fetched_at")]
    best = x.groupBy(*keys).agg(F.max(F.struct("fetched_at", *values)).alias("_b"))
    return best.select(*keys, *(F.col(f"_b.{c}").alias(c) for c in values))


def chart(x: DataFrame) -> DataFrame:
    """{"prices": [[ms, v], ...], "market_caps": ..., "total_volumes": ...}: of several points a day the last."""
    out = None
    for name, metric in (("prices", "close"), ("market_caps", "marketcap"), ("total_volumes", "volume")):
        p = _points(x, f"$.{name}").select(F.col("key").alias("asset_id"), "fetched_at", _get("p", "$[0]", "bigint").alias("ms"), _get("p", "$[1]", "double").alias("value")).where("ms is not null and value is not null")
        p = p.groupBy("asset_id", "fetched_at", _day(F.col("ms")).alias("date")).agg(F.max(F.struct("ms", "value"))["value"].alias("value")).withColumn("metric", F.lit(metric))
        out = p if out is None else out.unionByName(p)
    return _newest(out, ["asset_id", "date", "metric"])


def ohlc(x: DataFrame) -> DataFrame:
    """[[ms, open, high, low, close], ...]: candles within a day are joined."""
    p = _points(x, "$").select(F.col("key").alias("asset_id"), "fetched_at", _get("p", "$[0]", "bigint").alias("ms"), *(_get("p", f"$[{i}]", "double").alias(c) for i, c in enumerate(("open", "high", "low", "close"), 1)))
    p = p.dropna(subset=["ms", "open", "high", "low", "close"])
    day = p.groupBy("asset_id", "fetched_at", _day(F.col("ms")).alias("date"))
    day = day.agg(F.min(F.struct("ms", "open"))["open"].alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max(F.struct("ms", "close"))["close"].alias("close"))
    return _newest(day, ["asset_id", "date"])


def breadth(x: DataFrame) -> DataFrame:
    """{"gainers": [{"id", "symbol", "change"}, ...], "losers": [...]}: rank is the place in the list, the day that of the response."""
    out = None
    for name, category in (("gainers", "gainer"), ("losers", "loser")):
        p = _points(x, f"$.{name}").select(F.to_date("fetched_at").alias("date"), "fetched_at", F.col("key").alias("duration"), F.lit(category).alias("category"), (F.col("at") + 1).alias("rank"), F.upper(_get("p", "$.symbol", "string")).alias("symbol"), _get("p", "$.change", "double").alias("change"))
        out = p if out is None else out.unionByName(p)
    return _newest(out.where("symbol is not null"), ["date", "duration", "category", "rank"])


def listings(x: DataFrame) -> DataFrame:
    """[{"id", "symbol", "name"}, ...]: an id is listed on the day it is first met, under its first name."""
    p = _points(x, "$").select("fetched_at", _get("p", "$.id", "string").alias("listing_id"), F.upper(_get("p", "$.symbol", "string")).alias("symbol"), _get("p", "$.name", "string").alias("name"))
    first = p.where("listing_id is not null").groupBy("listing_id").agg(F.min(F.struct("fetched_at", "symbol", "name")).alias("_f"))
    return first.select("listing_id", F.col("_f.symbol").alias("symbol"), F.col("_f.name").alias("name"), F.to_date("_f.fetched_at").alias("listing_date"))


def exchange_volume(x: DataFrame) -> DataFrame:
    """[[ms, "volume"], ...] of an exchange (key): of several points a day the last."""
    p = _points(x, "$").select(F.col("key").alias("exchange_id"), "fetched_at", _get("p", "$[0]", "bigint").alias("ms"), _get("p", "$[1]", "double").alias("volume")).where("ms is not null and volume is not null")
    p = p.groupBy("exchange_id", "fetched_at", _day(F.col("ms")).alias("date")).agg(F.max(F.struct("ms", "volume"))["volume"].alias("volume"))
    return _newest(p, ["exchange_id", "date"])


def trending(x: DataFrame) -> DataFrame:
    """{"coins": [{"item": {"id", "symbol", "name"}}, ...]}."""
    p = _points(x, "$.coins").select(F.to_date("fetched_at").alias("date"), "fetched_at", (F.col("at") + 1).alias("rank"), _get("p", "$.item.id", "string").alias("item_id"), F.upper(_get("p", "$.item.symbol", "string")).alias("symbol"), _get("p", "$.item.name", "string").alias("name"))
    return _newest(p.where("item_id is not null"), ["date", "rank"])


def categories(x: DataFrame) -> DataFrame:
    """[{"category_id", "name"}, ...]."""
    p = _points(x, "$").select("fetched_at", _get("p", "$.category_id", "string").alias("category_id"), _get("p", "$.name", "string").alias("name"))
    return _newest(p.where("category_id is not null"), ["category_id"])


def _series(x: DataFrame) -> DataFrame:
    p = _points(x, "$.data").select(F.col("key").alias("asset_id"), "fetched_at", "at", _get("p", "$.time", "bigint").alias("ms"), _get("p", "$.close", "double").alias("value"))
    return p.where("ms is not null and value is not null").withColumn("date", _day(F.col("ms")))


def funding(x: DataFrame) -> DataFrame:
    """{"code": "0", "data": [{"time": ms, "close": rate}, ...]}: the mean of a day's rates."""
    return _newest(_series(x).groupBy("asset_id", "fetched_at", "date").agg(F.avg("value").alias("funding_rate")), ["asset_id", "date"])


def open_interest(x: DataFrame) -> DataFrame:
    """As funding; a level, so the day's last point holds (by its place in the response)."""
    return _newest(_series(x).groupBy("asset_id", "fetched_at", "date").agg(F.max(F.struct("at", "value"))["value"].alias("open_interest_usd")), ["asset_id", "date"])


def liquidations(x: DataFrame) -> DataFrame:
    """{"code": "0", "data": [{"time": ms, <long>: usd, <short>: usd}, ...]}: flows, so a day's points are added. Days before an asset's first one with a liquidation are padding."""
    side = lambda names: F.coalesce(*(_get("p", f"$.{n}", "double") for n in names))
    p = _points(x, "$.data").select(F.col("key").alias("asset_id"), "fetched_at", _get("p", "$.time", "bigint").alias("ms"), side(LONG_NAMES).alias("l"), side(SHORT_NAMES).alias("s"))
    p = p.where("ms is not null and (l is not null or s is not null)").groupBy("asset_id", "fetched_at", _day(F.col("ms")).alias("date")).agg(F.coalesce(F.sum("l"), F.lit(0.0)).alias("long_liquidation_usd"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("short_liquidation_usd"))
    day = _newest(p, ["asset_id", "date"])
    real = (F.col("long_liquidation_usd") > 0) | (F.col("short_liquidation_usd") > 0)
    started = F.min(F.when(real, F.col("date"))).over(Window.partitionBy("asset_id"))
    return day.withColumn("_first", started).where("date >= _first").drop("_first")


SHAPES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "chart": chart, "ohlc": ohlc, "breadth": breadth, "listings": listings, "exchange_volume": exchange_volume, "trending": trending, "categories": categories,
    "funding": funding, "open_interest": open_interest, "liquidations": liquidations,
}
#: Where a kind's list of points is, by kind; a response without points there has no data.
_LISTS = {
    "chart": ["$.prices", "$.market_caps", "$.total_volumes"], "ohlc": ["$"], "breadth": ["$.gainers", "$.losers"], "listings": ["$"], "exchange_volume": ["$"], "trending": ["$.coins"], "categories": ["$"],
    "funding": ["$.data"], "open_interest": ["$.data"], "liquidations": ["$.data"],
}
#: A point's fields without which it is none.
_NEEDED = {
    "chart": ["$[0]:bigint", "$[1]:double"], "ohlc": ["$[0]:bigint", *(f"$[{i}]:double" for i in range(1, 5))], "breadth": ["$.symbol:string"], "listings": ["$.id:string"], "exchange_volume": ["$[0]:bigint", "$[1]:double"],
    "trending": ["$.item.id:string"], "categories": ["$.category_id:string"], "funding": ["$.time:bigint", "$.close:double"], "open_interest": ["$.time:bigint", "$.close:double"], "liquidations": ["$.time:bigint"],
}


def _whole(needed: list[str]) -> Callable[[Column], Column]:
    """The point has these fields (path:type), with values of these types."""
    def test(p: Column) -> Column:
        out = F.lit(True)
        for path, kind in (n.split(":") for n in needed):
            out = out & _get(p, path, kind).isNotNull()
        return out

    return test


def parsed(landed: DataFrame) -> DataFrame:
    """landed with v (VARIANT, null where the line is no JSON) and reason (null where there are facts)."""
    x = landed.select("kind", "key", "fetched_at", "line", F.try_parse_json("line").alias("v"))
    code, message = _get("v", "$.code", "string"), F.lower(F.coalesce(_get("v", "$.msg", "string"), F.lit("unknown error")))
    usable = F.lit(False)
    for kind, lists in _LISTS.items():
        some = F.lit(False)
        for path in lists:
            some = some | F.coalesce(F.exists(_get("v", path, "array<variant>"), _whole(_NEEDED[kind])), F.lit(False))
        usable = F.when(F.col("kind") == kind, some).otherwise(usable)
    reason = F.when(~F.col("kind").isin(*SHAPES) | F.col("kind").isNull(), "unknown kind").when(F.col("v").isNull(), "not json")
    reason = reason.when(code.isNotNull() & (code != "0"), F.concat(F.lit("error: "), message)).when(~usable, "no data")
    return x.withColumn("reason", reason)


def facts(landed: DataFrame, kind: str) -> DataFrame:
    return SHAPES[kind](parsed(landed.where(F.col("kind") == kind)).where("reason is null"))


def rejected(landed: DataFrame) -> DataFrame:
    """kind, key, fetched_at, reason, retry, line."""
    x = parsed(landed).where("reason is not null")
    return x.select("kind", "key", "fetched_at", "reason", F.col("reason").rlike("too many requests|rate limit").alias("retry"), "line")
