"""Daily panels in long form (one row for each asset and date) from the tables at hand, and reshaping at the boundary.

Wide frames (a date column and one column an asset) exist only on the way in and out: `to_long` unpivots them, `to_wide` pivots
for output. Everything between works on long rows, where a filter or a column list reaches the parquet scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def summed(rows: Column) -> Column:
    """Sum of an array of (order, value) in that order, nulls left out; null without values. The last bits of a sum of doubles depend on the order of its
    terms, and with it whether two sums are equal: this one doesn't depend on partitions."""
    v = F.filter(F.transform(F.array_sort(rows), lambda x: x["value"]), lambda x: x.isNotNull())
    return F.aggregate(F.slice(v, 2, F.greatest(F.size(v), F.lit(1))), F.get(v, 0), lambda a, x: a + x)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many assets over a short time: asset_id, date, close, volume, marketcap. A day's values are added up in the order of their events."""
    day = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("asset_id"), F.to_date("ts").alias("date"))
    day = day.agg(F.collect_list(F.struct("event_id", "value")).alias("_rows"), F.count("value").alias("_n"), F.count(F.lit(1)).alias("_all"))
    close = F.col("volume") / F.when(F.col("_n") > 0, F.col("_n"))
    return day.withColumn("volume", summed(F.col("_rows"))).select("asset_id", "date", close.alias("close"), "volume", (close * F.col("_all")).alias("marketcap"))


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few assets over a long time (an order priority is an asset)."""
    day = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("asset_id"), F.to_date("o_orderdate").alias("date"))
    return day.agg(F.avg("o_totalprice").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"), F.sum("o_totalprice").alias("marketcap"))


def lineitem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many assets over a long time, with gaps (a supplier is an asset)."""
    day = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset_id"), F.to_date("l_shipdate").alias("date"))
    return day.agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("close"), F.sum("l_extendedprice").alias("volume"), F.sum("l_quantity").alias("marketcap"))


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates with weights by asset, instrument, exchange and day: the funding and open-interest facts."""
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("asset_id"), F.col("l_linenumber").alias("instrument_id"), F.col("l_returnflag").alias("exchange"),
        F.to_date("l_shipdate").alias("date"), (F.col("l_discount") - F.col("l_tax")).alias("rate"), F.col("l_extendedprice").alias("weight"),
    )


def snapshots(spark: SparkSession, sf_dir: str, top: int = 20) -> DataFrame:
    """Monthly baskets: the top assets of the month by turnover, weighted by it. rebalance_date, asset_id, marketcap, rank, weight."""
    month = read(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("rebalance_date"), F.col("l_suppkey").alias("asset_id")).agg(F.sum("l_extendedprice").alias("marketcap"))
    w = Window.partitionBy("rebalance_date")
    ranked = month.withColumn("rank", F.row_number().over(w.orderBy(F.desc("marketcap"), "asset_id"))).where(F.col("rank") <= top)
    return ranked.withColumn("weight", F.col("marketcap") / F.sum("marketcap").over(w))


def to_long(wide: DataFrame, keys: Sequence[str], name: str = "symbol", value: str = "value") -> DataFrame:
    """Unpivots all columns but the keys; rows without a value go. NaN is no value."""
    columns = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(list(keys), columns, name, value)
    return long.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def to_wide(long: DataFrame, date: str, symbol: str, value: str, symbols: Sequence | None = None) -> DataFrame:
    """One column for each symbol. Of several rows for one cell the smallest value is taken, so the result is defined. Given
    symbols, Spark needs no pass over the data to find them."""
    g = long.groupBy(date)
    return (g.pivot(symbol, list(symbols)) if symbols is not None else g.pivot(symbol)).agg(F.min(value))


def _days(df: DataFrame, key: str, date: str, first: Column, last: Column, carry: Sequence[str] = ()) -> DataFrame:
    """Each row with the days that it opens up to the next row's; only its own day keeps its measures. One shuffle, of the sparse rows."""
    day, rest = "_day", [c for c in df.columns if c not in (key, date)]
    grid = df.withColumn(day, F.explode(F.sequence(first, F.greatest(last, F.col(date)))))
    own = F.col(day) == F.col(date)
    return grid.select(key, F.col(day).alias(date), *(F.col(c) if c in carry else F.when(own, F.col(c)).alias(c) for c in rest))


def densify(df: DataFrame, key: str = "asset_id", date: str = "date", carry: Sequence[str] = ()) -> DataFrame:
    """A row for every day between an asset's first and last; measures of added days are null, but for the columns to carry, which repeat those of the row before."""
    following = F.lead(date).over(Window.partitionBy(key).orderBy(date))
    df = df.where(F.col(date).isNotNull()).withColumn("_next", following)
    return _days(df, key, date, F.col(date), F.coalesce(F.date_sub("_next", 1), F.col(date)), carry).drop("_next")


def spans(df: DataFrame, value: str, key: str = "asset_id", date: str = "date") -> DataFrame:
    """The dense grid of an asset cut before each row with a value: key, first and last (days), value, and the values before and after. Gaps are
    filled by arithmetic on these rows, so that no window runs over added days. Days before the first value are a span of their own, without one."""
    w = Window.partitionBy(key).orderBy(date)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.where(F.col(date).isNotNull()).select(key, date, value, F.lag(date).over(w).alias("_prev"), F.max(date).over(whole).alias("_end"))
    d = d.where(F.col(value).isNotNull() | F.col("_prev").isNull())
    last = F.coalesce(F.date_sub(F.lead(date).over(w), 1), F.col("_end"))
    return d.select(key, F.col(date).alias("first"), last.alias("last"), value, F.lag(value).over(w).alias("before"), F.lead(value).over(w).alias("after"))


def opened(s: DataFrame, date: str = "date") -> DataFrame:
    """The days of each span, streamed from it."""
    return s.withColumn(date, F.explode(F.sequence("first", "last")))


def align(df: DataFrame, key: str = "asset_id", date: str = "date") -> DataFrame:
    """A row for every asset and every day between the first and last day of all assets. The calendar is one row of bounds."""
    w = Window.partitionBy(key).orderBy(date)
    df = df.where(F.col(date).isNotNull())
    bounds = df.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    df = df.withColumns({"_prev": F.lag(date).over(w), "_next": F.lead(date).over(w)}).crossJoin(F.broadcast(bounds))
    first = F.when(F.col("_prev").isNull(), F.col("_a")).otherwise(F.col(date))
    return _days(df, key, date, first, F.coalesce(F.date_sub("_next", 1), F.col("_b"))).drop("_prev", "_next", "_a", "_b")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order; the order should end in something unique."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df itself; raises if a key has two rows (reads up to a few offenders only)."""
    bad = duplicates(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys: {[tuple(r) for r in bad]}")
    return df


def trim_leading_zeros(df: DataFrame, measures: Sequence[str], key: str = "asset_id", date: str = "date") -> DataFrame:
    """Drops an asset's rows before the first with some measure above zero; an asset without any goes."""
    live = F.greatest(*(F.coalesce(F.col(m), F.lit(0.0)) for m in measures)) > 0
    first = F.min(F.when(live, F.col(date))).over(Window.partitionBy(key))
    return df.withColumn("_first", first).where(F.col(date) >= F.col("_first")).drop("_first")


def unit_cutover(df: DataFrame, value: str, cutover: str, divisor: float = 100.0, date: str = "date") -> DataFrame:
    """Values from the cutover date on are in another unit: divided."""
    return df.withColumn(value, F.when(F.col(date) >= F.lit(cutover).cast("date"), F.col(value) / divisor).otherwise(F.col(value)))


def melt_two_and_pivot(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Mean, deviation and count of several measures by group, one row a group with columns measure_stat."""
    long = df.unpivot([group], list(measures), "measure", "value")
    wide = long.groupBy(group).pivot("measure", list(measures)).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("count"))
    return wide
