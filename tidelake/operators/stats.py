"""Aggregates: robust means, weighted means, concentration, performance and tail measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import drawdown, equity, ratio


def _ranked(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Rows with a value, numbered from 1 by rising value within the group, and the group's count."""
    w = Window.partitionBy(*group)
    return df.where(F.col(value).isNotNull()).withColumns({"_k": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})


def trimmed_mean(df: DataFrame, group: Sequence[str], value: str, cut: Column, out: str = "mean") -> DataFrame:
    """Mean after dropping `cut` rows (an expression of _n, the group's count) at each end."""
    return _ranked(df, group, value).where((F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)).groupBy(*group).agg(F.avg(value).alias(out))


def interquartile_mean(df: DataFrame, group: Sequence[str], value: str, out: str = "mean") -> DataFrame:
    return trimmed_mean(df, group, value, F.floor(F.col("_n") / 4), out)


def bucket_trim(n: Column) -> Column:
    """Rows to drop at each end by bucket size."""
    return F.when(n >= 15, 2).when(n >= 9, 1).otherwise(0)


def bucket_curves(prices: DataFrame, members: DataFrame, start: Column, days: int) -> DataFrame:
    """date, bucket, mean, n: the trimmed mean over a bucket's assets of price / price on the start day - 1, on each day up to
    `days` after it. Assets without a price on the start day are left out. prices: asset_id, date, close; members: asset_id, bucket."""
    first = prices.where(F.col("date") == start).select("asset_id", F.col("close").alias("_p0")).where("_p0 <> 0")
    x = prices.where((F.col("date") >= start) & (F.col("date") <= F.date_add(start, days)) & F.col("close").isNotNull())
    x = x.join(first, "asset_id").join(members, "asset_id").withColumn("_r", F.col("close") / F.col("_p0") - 1)
    cut = bucket_trim(F.col("_n"))
    kept = (F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)
    return _ranked(x, ["date", "bucket"], "_r").groupBy("date", "bucket").agg(F.avg(F.when(kept, F.col("_r"))).alias("mean"), F.count(F.lit(1)).alias("n"))


def floor_spread(df: DataFrame, group: Sequence[str], value: str, out: str = "spread") -> DataFrame:
    """x[floor(.75 n)] - x[floor(.25 n)] of the sorted values (from 0); null below four."""
    at = lambda q: F.max(F.when(F.col("_k") - 1 == F.floor(F.col("_n") * q), F.col(value)))
    return _ranked(df, group, value).groupBy(*group).agg(F.when(F.max("_n") >= 4, at(0.75) - at(0.25)).alias(out))


def iqr_nearest(df: DataFrame, group: Sequence[str], value: str, out: str = "iqr") -> DataFrame:
    """Upper less lower quartile by nearest rank."""
    at = lambda q: F.max(F.when(F.col("_k") - 1 == F.floor((F.col("_n") - 1) * q + 0.5), F.col(value)))
    return _ranked(df, group, value).groupBy(*group).agg((at(0.75) - at(0.25)).alias(out))


def weighted_mean(value: str, weight: str) -> Column:
    """Weighted mean of rows with both; the plain mean where the weights add up to nothing."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    w = F.sum(F.when(both, F.col(weight)))
    return F.coalesce(ratio(F.sum(F.when(both, F.col(value) * F.col(weight))), w), F.avg(value))


def cap_weighted(ret: str, cap: str) -> Column:
    """Sum of return x cap over the sum of all caps: a row without a return still counts in the denominator."""
    return ratio(F.sum(F.col(ret) * F.col(cap)), F.sum(cap))


def breadth(ret: str) -> Column:
    """Percent of rows with a positive return; rows without one count as not positive."""
    return F.sum(F.when(F.col(ret) > 0, 1).otherwise(0)) / F.count(F.lit(1)) * 100


def two_level_mean(df: DataFrame, key: str, date: str, value: str, universe: int | None = None, least_pct: float = 60.0) -> DataFrame:
    """Mean over assets of the mean over days of the mean within a day; null below a coverage of the universe."""
    per = df.groupBy(key, date).agg(F.avg(value).alias("_d")).groupBy(key).agg(F.avg("_d").alias("_a"))
    out = per.agg(F.avg("_a").alias("mean"), F.count("_a").alias("n"))
    return out.withColumn("mean", F.when(F.col("n") * 100.0 / universe >= least_pct, F.col("mean"))) if universe else out


def concentration(df: DataFrame, group: str, weight: str, key: str) -> DataFrame:
    """Weight of the five and ten largest, and the Herfindahl index."""
    k = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(weight), key))
    top = lambda n: F.sum(F.when(F.col("_k") <= n, F.col(weight)))
    return df.withColumn("_k", k).groupBy(group).agg(top(5).alias("top5"), top(10).alias("top10"), F.sum(F.col(weight) ** 2).alias("herfindahl"))


def carry(df: DataFrame, key: str, date: str, rate: str, per_year: float = 1095.0) -> DataFrame:
    """Sum, yearly rate, shares of positive, negative and zero, population deviation, share of the ten largest in what is
    positive, and the largest fall of the running sum."""
    w = Window.partitionBy(key)
    run = F.sum(rate).over(w.orderBy(date).rowsBetween(Window.unboundedPreceding, 0))
    x = df.withColumn("_k", F.row_number().over(w.orderBy(F.desc(rate), date))).withColumn("_s", run)
    x = x.withColumn("_dd", F.max("_s").over(w.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s"))
    r = F.col(rate)
    share = lambda c: F.count_if(c) / F.count(F.lit(1))
    positive = F.sum(F.when(r > 0, r))
    return x.groupBy(key).agg(
        F.sum(r).alias("total"), (F.avg(r) * per_year).alias("apr"), share(r > 0).alias("pos"), share(r < 0).alias("neg"), share(r == 0).alias("zero"), F.stddev_pop(r).alias("std"),
        ratio(F.sum(F.when((F.col("_k") <= 10) & (r > 0), r)), positive).alias("top10_share"), F.max("_dd").alias("max_drawdown"),
    )


def performance(df: DataFrame, key: str, date: str, ret: str, per_year: float = 252.0) -> DataFrame:
    """Yearly return and risk ratios of daily returns: cagr, sharpe, sortino, calmar, max_drawdown, hit_rate. The deviation is
    the sample's; that of losses too."""
    w = Window.partitionBy(key).orderBy(date)
    x = df.where(F.col(ret).isNotNull()).withColumn("_e", equity(ret, w)).withColumn("_dd", drawdown("_e", w))
    r = F.col(ret)
    out = x.groupBy(key).agg(
        F.count(r).alias("n"), F.exp(F.sum(F.log1p(r))).alias("_total"), F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_std"), F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.min(F.least("_dd", F.lit(0.0))).alias("max_drawdown"), (F.count_if(r > 0) / F.count(r)).alias("hit_rate"),
    )
    root = F.sqrt(F.lit(per_year))
    out = out.withColumn("cagr", F.pow("_total", per_year / F.col("n")) - 1)
    return out.select(key, "n", "cagr", (ratio(F.col("_mean"), F.col("_std")) * root).alias("sharpe"), (ratio(F.col("_mean"), F.col("_down")) * root).alias("sortino"), ratio(F.col("cagr"), F.abs("max_drawdown")).alias("calmar"), "max_drawdown", "hit_rate")


def tail_risk(df: DataFrame, key: str, ret: str) -> DataFrame:
    """Value at risk and expected shortfall at 95 and 99 percent, and bias-corrected skewness and excess kurtosis."""
    q = df.groupBy(key).agg(F.percentile(ret, F.array(F.lit(0.05), F.lit(0.01))).alias("_q"), F.count(ret).alias("n"), F.skewness(ret).alias("_g1"), F.kurtosis(ret).alias("_g2"))
    x = df.join(q.select(key, "_q"), key).groupBy(key).agg(F.avg(F.when(F.col(ret) <= F.get("_q", 0), F.col(ret))).alias("cvar95"), F.avg(F.when(F.col(ret) <= F.get("_q", 1), F.col(ret))).alias("cvar99"))
    n = F.col("n").cast("double")
    skew = F.col("_g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("_g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return q.join(x, key).select(key, F.get("_q", 0).alias("var95"), F.get("_q", 1).alias("var99"), "cvar95", "cvar99", skew.alias("skew"), kurt.alias("kurtosis"))


def missingness(df: DataFrame, group: str, measures: Sequence[str]) -> DataFrame:
    """Cells, empty cells and their share for each group."""
    empty = sum((F.count(F.lit(1)) - F.count(m) for m in measures), F.lit(0))
    return df.groupBy(group).agg((F.count(F.lit(1)) * len(measures)).alias("cells"), empty.cast("long").alias("empty")).withColumn("share", F.col("empty") / F.col("cells"))


def sparsity(df: DataFrame, key: str, date: str) -> DataFrame:
    """First and last day, days present, and days missing between."""
    g = df.groupBy(key).agg(F.min(date).alias("first"), F.max(date).alias("last"), F.count_distinct(date).alias("n"))
    return g.withColumn("missing", F.datediff("last", "first") + 1 - F.col("n"))


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value and their percentage. The total is one broadcast row."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("_t")))).select(column, "n", (100.0 * F.col("n") / F.col("_t")).alias("pct"))


def label_summary(df: DataFrame, label: str, value: str) -> DataFrame:
    """Of each label: rows with a value, mean, median, deviation, share below zero, and the values compounded. Rows without a label or value don't count."""
    d = df.where(F.col(label).isNotNull() & F.col(value).isNotNull())
    return d.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) < 0).cast("double")).alias("hit_rate"), F.expm1(F.sum(F.log1p(value))).alias("compounded"),
    )
