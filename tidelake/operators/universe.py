"""Point-in-time universe: calendars, eligibility with one reason, weights with a cap, baskets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def span(df: DataFrame, date: str = "date") -> DataFrame:
    """One row: the first and last day of a table, a and b."""
    return df.agg(F.min(F.to_date(date)).alias("a"), F.max(F.to_date(date)).alias("b"))


def _between(spark: SparkSession, start: str, end: str) -> DataFrame:
    return spark.range(1).select(F.lit(start).cast("date").alias("a"), F.lit(end).cast("date").alias("b"))


def rebalance_calendar(bounds: DataFrame, day: int = 1, months: int = 1) -> DataFrame:
    """The given day of every month (or of January, April, July, October for months=3) within the bounds, inclusive."""
    d = bounds.where("a is not null").select("a", "b", F.explode(F.sequence(F.trunc("a", "quarter" if months == 3 else "month"), F.col("b"), F.expr(f"interval {months} month"))).alias("m"))
    return d.withColumn("rebalance_date", F.date_add("m", day - 1)).where("rebalance_date between a and b").select("rebalance_date")


def weekly_calendar(bounds: DataFrame, weekday: str = "Thursday") -> DataFrame:
    """The weekday on or after the first day, and every seventh day after it, up to the last; with the next one."""
    first = F.next_day(F.date_sub("a", 1), weekday[:3])
    d = bounds.withColumn("_f", first).where("_f <= b").select(F.explode(F.sequence("_f", F.col("b"), F.expr("interval 7 days"))).alias("decision_date"))
    return d.withColumn("next_date", F.date_add("decision_date", 7))


def rebalance_dates(spark: SparkSession, start: str, end: str, day: int = 1, months: int = 1) -> DataFrame:
    return rebalance_calendar(_between(spark, start, end), day, months)


def weekly_dates(spark: SparkSession, start: str, end: str, weekday: str = "Thursday") -> DataFrame:
    return weekly_calendar(_between(spark, start, end), weekday)


def eligibility(df: DataFrame, rules: Sequence[tuple[str, Column]], legacy_shadow: Sequence[str] = ()) -> DataFrame:
    """df with `eligible` and `exclusion_reason`: the first rule that fails, in order. A rule is (reason, condition that must
    hold; null fails). A rule named in legacy_shadow hides the reasons of all later rules although they still exclude."""
    ok = [(n, F.coalesce(c, F.lit(False))) for n, c in rules]
    reason: Column = F.lit(None).cast("string")
    shadowed = False
    chain = None
    for n, c in ok:
        if not shadowed:
            chain = F.when(~c, n) if chain is None else chain.when(~c, n)
        shadowed = shadowed or n in legacy_shadow
    reason = reason if chain is None else chain
    eligible = reduce(lambda a, b: a & b, [c for _, c in ok], F.lit(True))
    return df.withColumns({"eligible": eligible, "exclusion_reason": reason})


def top_n(df: DataFrame, group: str, by: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order, numbered. Spark keeps only n candidates a task before the shuffle."""
    w = Window.partitionBy(group).orderBy(*by)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def weights(df: DataFrame, group: str, size: str, scheme: str = "cap", cap: float | None = None, rounds: int = 12) -> DataFrame:
    """Weights within each group: by size, by its root, or equal. With a cap, what lies above it goes to the others in
    proportion, round by round. If every weight would stand at the cap the uncapped weights stay."""
    w = Window.partitionBy(group)
    raw = {"cap": F.col(size), "sqrt": F.sqrt(size), "equal": F.lit(1.0)}[scheme]
    df = df.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(w))
    if cap is None:
        return df.drop("_raw")
    df = df.withColumn("_w0", F.col("weight"))
    for _ in range(rounds):
        over = F.col("weight") >= cap
        excess = F.sum(F.when(over, F.col("weight") - cap).otherwise(0.0)).over(w)
        room = F.sum(F.when(~over, F.col("weight")).otherwise(0.0)).over(w)
        df = df.withColumns({"_over": over, "_excess": excess, "_room": room})
        df = df.withColumn("weight", F.when(F.col("_excess") <= 1e-12, F.col("weight")).when(F.col("_over"), cap).when(F.col("_room") > 0, F.col("weight") * (1 + F.col("_excess") / F.col("_room"))).otherwise(F.col("weight")))
    total = F.sum("weight").over(w)
    df = df.withColumn("_total", total).withColumn("weight", F.when(F.abs(F.col("_total") - 1) < 1e-9, F.col("weight")).otherwise(F.col("_w0")))
    return df.drop("_raw", "_w0", "_over", "_excess", "_room", "_total")


def hot_cold(df: DataFrame, group: str, value: str, key: str, most: int = 15) -> DataFrame:
    """The k highest (hot) and k lowest (cold) of each group, k = min(most, half of it)."""
    w = Window.partitionBy(group)
    x = df.where(F.col(value).isNotNull()).withColumns({"_h": F.row_number().over(w.orderBy(F.desc(value), key)), "_c": F.row_number().over(w.orderBy(F.col(value), F.desc(key))), "_n": F.count(F.lit(1)).over(w)})
    k = F.least(F.lit(most), F.floor(F.col("_n") / 2))
    return x.withColumn("side", F.when(F.col("_h") <= k, "hot").when(F.col("_c") <= k, "cold")).where("side is not null").drop("_h", "_c", "_n")


def inverse_volatility(df: DataFrame, key: str, ret: str, least: int = 5) -> DataFrame:
    """Weights in proportion to 1 / deviation of the key's returns; keys with too few returns or none go."""
    s = df.groupBy(key).agg(F.stddev_samp(ret).alias("vol"), F.count(ret).alias("n")).where((F.col("n") >= least) & (F.col("vol") > 0))
    total = s.agg(F.sum(1 / F.col("vol")).alias("_t"))
    return s.crossJoin(F.broadcast(total)).select(key, "vol", (1 / F.col("vol") / F.col("_t")).alias("weight"))


def membership_hash(df: DataFrame, group: str, key: str) -> DataFrame:
    """Sorted members of each group as text, and the first 16 hex digits of its SHA-256."""
    m = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ",")
    return df.groupBy(group).agg(m.alias("members")).withColumn("hash", F.substring(F.sha2("members", 256), 1, 16))


def filter_chain(prices: DataFrame, asof: str, majors: tuple, max_vol: float = 1.0, min_corr: float = 0.3, max_momentum: float = 0.5, min_momentum: float = -0.5, vol_rows: int = 20, corr_rows: int = 60, momentum_rows: int = 7) -> DataFrame:
    """The basket builder's filters for each asset, as of a date: asset_id, n, vol, corr, momentum and reason, the first filter that drops it (null: it stays).

    too_few_rows (fewer than the longest window); volatility (annualised deviation of the last rows' returns); correlation (the larger of both majors', where at least 30 days are
    common and 11 returns known, else not judged); momentum. The last rows of all assets are ranked once; each filter is an aggregate of the same rows."""
    w = Window.partitionBy("asset_id").orderBy(F.desc("date"))
    p = prices.where((F.col("date") <= F.lit(asof).cast("date")) & F.col("close").isNotNull()).select("asset_id", "date", "close", F.row_number().over(w).alias("k"))
    need = max(vol_rows, corr_rows, momentum_rows)
    n = p.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    p = p.where(F.col("k") <= max(need, momentum_rows + 1))
    back = F.col("close") / F.lag("close").over(w) - 1  # from the newer row to the older one, as the volatility is defined
    own = p.withColumn("_b", back).groupBy("asset_id").agg(
        (F.stddev_samp(F.when(F.col("k") <= vol_rows, F.col("_b"))) * math.sqrt(252)).alias("vol"), F.max(F.when(F.col("k") == 1, F.col("close"))).alias("_new"), F.max_by("close", F.when(F.col("k") <= momentum_rows + 1, F.col("k"))).alias("_old"))
    recent = p.where(F.col("k") <= corr_rows)
    both = recent
    for name, major in zip(("_m1", "_m2"), majors, strict=True):
        both = both.join(recent.where(F.col("asset_id") == F.lit(major)).select("date", F.col("close").alias(name)), "date")
    w2 = Window.partitionBy("asset_id").orderBy("date")
    ret = lambda c: F.col(c) / F.lag(c).over(w2) - 1
    both = both.select("asset_id", ret("close").alias("a"), ret("_m1").alias("b"), ret("_m2").alias("c")).groupBy("asset_id")
    both = both.agg(F.count(F.lit(1)).alias("_c"), F.count("a").alias("_r"), F.greatest(F.coalesce(F.abs(F.corr("a", "b")), F.lit(0.0)), F.coalesce(F.abs(F.corr("a", "c")), F.lit(0.0))).alias("corr"))
    x = n.join(own, "asset_id").join(both, "asset_id", "left").withColumn("momentum", F.col("_new") / F.col("_old") - 1)
    x = x.withColumn("corr", F.when((F.col("_c") >= 30) & (F.col("_r") > 10), F.col("corr")))
    reason = F.when(F.col("n") < need, "too_few_rows").when(F.col("vol") > max_vol, "volatility").when(F.col("corr") < min_corr, "correlation")
    return x.select("asset_id", "n", "vol", "corr", "momentum", reason.when((F.col("momentum") > max_momentum) | (F.col("momentum") < min_momentum), "momentum").alias("reason"))
