"""Alignment and evaluation of signals; history upkeep; searches over parameters."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """A join whose right side must be unique on the keys; raises otherwise."""
    from ..sources.panel import require_unique

    return left.join(require_unique(right, keys), list(keys), how)


def align_regimes(regimes: DataFrame, returns: DataFrame, candidates: Sequence[str] = ("r_ls_net", "r_ls", "r"), how: str = "inner") -> DataFrame:
    """date, regime, ret: the first of the candidate return columns that exists."""
    c = next((x for x in candidates if x in returns.columns), None)
    if c is None:
        raise ValueError(f"none of {list(candidates)} in {returns.columns}")
    return regimes.select(F.to_date("date").alias("date"), "regime").join(returns.select(F.to_date("date").alias("date"), F.col(c).alias("ret")), "date", "full" if how == "outer" else how)


def normalize_history(df: DataFrame, date: str = "decision_date", order: str | None = None) -> DataFrame:
    """Dates parsed (rows without one go) and the last row of each date kept, as ISO text. The last is that with the largest `order` (default: the
    order of the rows as they are read), found by partial aggregates, so rows needn't be sorted."""
    d = df.withColumn("_d", F.to_date(F.col(date).cast("string"))).where("_d is not null")
    d = d.withColumn("_o", F.col(order) if order else F.monotonically_increasing_id())
    last = d.groupBy("_d").agg(*(F.max_by(c, "_o").alias(c) for c in df.columns if c != date))
    return last.withColumn(date, F.date_format("_d", "yyyy-MM-dd")).select(*df.columns)


def latest_rows(df: DataFrame, date: str, n: int) -> DataFrame:
    """The newest n rows, in rising order."""
    return df.orderBy(F.desc(date)).limit(n).orderBy(date)


def missing_dates(df: DataFrame, end: Column, key: str = "series", date: str = "date") -> DataFrame:
    """Days between a key's first row and end that it has no row for."""
    days = df.groupBy(key).agg(F.min(date).alias("_a")).select(key, F.explode(F.sequence("_a", end)).alias(date))
    return days.join(df.select(key, date), [key, date], "left_anti")


def z_against_history(df: DataFrame, value: str, key: str = "series", date: str = "date", least: int = 30) -> DataFrame:
    """Distance of each row from the mean of all rows before it, in population deviations; null with too few."""
    frame = W.by(key, date).rowsBetween(Window.unboundedPreceding, -1)
    z = W.ratio(F.col(value) - F.avg(value).over(frame), F.stddev_pop(value).over(frame))
    return df.withColumn("z", F.when(F.count(value).over(frame) >= least, z))


def z_of_day(day: DataFrame, history: DataFrame, values: Sequence[str], date: str = "date", least: int = 30) -> DataFrame:
    """The rows of one day with a z-score for each value (z_<value>) against the history before it: population deviation, null with fewer than least rows. The history's
    moments are one row."""
    first = day.agg(F.min(date)).first()[0]
    past = history.where(F.col(date) < F.lit(first))
    m = past.agg(*(e for v in values for e in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"), F.count(v).alias(f"_n_{v}"))))
    x = day.crossJoin(F.broadcast(m))
    z = {f"z_{v}": F.when(F.col(f"_n_{v}") >= least, W.ratio(F.col(v) - F.col(f"_m_{v}"), F.col(f"_s_{v}"))) for v in values}
    return x.withColumns(z).select(*day.columns, *z)


def window_metrics(df: DataFrame, key: str, date: str, ret: str, first: str, last: str) -> DataFrame:
    """Of the days within an event's window: compounded return, largest fall from the peak (as a difference), deviation, Sharpe
    ratio, peak."""
    d = df.where(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).withColumn("_c", W.equity(ret, W.by(key, date)) - 1)
    d = d.withColumn("_dd", F.col("_c") - F.max("_c").over(W.upto(W.by(key, date))))
    r = F.col(ret)
    return d.groupBy(key).agg(F.expm1(F.sum(F.log1p(r))).alias("total"), F.min("_dd").alias("drawdown"), F.stddev_samp(r).alias("vol"), (W.ratio(F.avg(r), F.stddev_samp(r)) * math.sqrt(365)).alias("sharpe"), F.max("_c").alias("peak"))


def two_date_return(prices: DataFrame, members: DataFrame, first: str, last: str) -> DataFrame:
    """Return of each member between two days; null where one price is missing. members: a column of comma-joined assets."""
    m = members.select(F.explode(F.split("members", ",")).alias("asset_id")).distinct()
    at = lambda d, n: prices.where(F.col("date") == F.lit(d).cast("date")).select(F.col("asset_id").cast("string").alias("asset_id"), F.col("close").alias(n))
    return m.join(at(first, "c0"), "asset_id", "left").join(at(last, "c1"), "asset_id", "left").withColumn("ret", W.ratio(F.col("c1"), F.col("c0")) - 1)


def candidates_or_all(df: DataFrame, good: Column, order: Column, n: int) -> DataFrame:
    """The first n rows that are good, or of all rows if none is."""
    any_good = df.agg(F.coalesce(F.bool_or(good), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(any_good)).where(~F.col("_any") | good).drop("_any").orderBy(order).limit(n)


def manager_summary(eligible: DataFrame, snapshots: DataFrame, top: int, date: str = "rebalance_date") -> DataFrame:
    """Per run: smallest and upper-middle number of eligible assets, and the share of dates with a full basket."""
    e = eligible.groupBy(date).agg(F.count_if("eligible").alias("_e"))
    s = snapshots.groupBy(date).agg(F.count(F.lit(1)).alias("_s"))
    x = e.join(s, date, "left")
    middle = F.get(F.array_sort(F.collect_list("_e")), F.floor(F.count(F.lit(1)) / 2).cast("int"))
    return x.agg(F.count(F.lit(1)).alias("dates"), F.min("_e").alias("min_eligible"), middle.alias("median_eligible"), (100.0 * F.count_if(F.col("_s") >= top) / F.count(F.lit(1))).alias("pct_full"))


def grid_search(df: DataFrame, params: DataFrame, window: str = "window", date: str = "date") -> DataFrame:
    """Sharpe ratio of each parameter set in each test window: long while w1 * x1 + w2 * x2 lies above the threshold, on the next
    day's return. All sets at once, as joins of a small table."""
    x = df.withColumn("_next", F.lead("r").over(Window.partitionBy(window).orderBy(date))).where("_next is not null").crossJoin(F.broadcast(params))
    on = F.col("w1") * F.col("x1") + F.col("w2") * F.col("x2") > F.col("threshold")
    p = F.when(on, F.col("_next")).otherwise(0.0)
    return x.groupBy("set_id", window).agg((W.ratio(F.avg(p), F.stddev_samp(p)) * math.sqrt(252)).alias("sharpe"), F.count(F.lit(1)).alias("n"))


def smoothed_peak(df: DataFrame, key: str, x: str, y: str, frac: float = 0.3) -> DataFrame:
    """Where a locally weighted curve of y over x is highest. A key is one bounded sample of points."""
    from .statistics import lowess

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna().sort_values(x)
        s = lowess(pdf[x].to_numpy(float), pdf[y].to_numpy(float), frac)
        i = int(s.argmax())
        return pd.DataFrame({key: [pdf[key].iloc[0]], "at": [float(pdf[x].iloc[i])], "peak": [float(s[i])]})

    return df.select(key, x, y).groupBy(key).applyInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, at double, peak double")


def full_join(left: DataFrame, right: DataFrame, key: str, coalesced: bool = True) -> DataFrame:
    """Every row of both sides. Without coalescing, the key stays the left side's (null where that has no row) and the right
    side's stands in `<key>_right`, so that nothing is lost but a filter on the key drops rows of the right side only."""
    if coalesced:
        return left.join(right, key, "full")
    r = right.withColumnRenamed(key, f"{key}_right")
    return left.join(r, left[key] == r[f"{key}_right"], "full")


def last_common(panels: Sequence[DataFrame], rows: int, date: str = "date") -> DataFrame:
    """Panels joined on the dates that all have, the last rows of these in rising order."""
    out = panels[0]
    for p in panels[1:]:
        out = out.join(p, date)
    return out.orderBy(F.desc(date)).limit(rows).orderBy(date)
