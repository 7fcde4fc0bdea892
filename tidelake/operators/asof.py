"""As-of joins and point-in-time lookups.

A range join would compare every row with every earlier one of its key. Here both sides are united, and the last right value so
far is carried forward within the key: one shuffle and one sort, whatever the lengths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def backward(left: DataFrame, right: DataFrame, left_time: str, right_time: str, keys: Sequence[str], values: Sequence[str], strict: bool = False) -> DataFrame:
    """left with the values of the last right row of its key at or before its time (before it, if strict). Of right rows with
    one time the one with the largest values is taken."""
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.struct(*values).alias("_v"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"_l_{c}") for c in left.columns))
    x = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_v"].dataType).alias("_v"), *(F.col(c).alias(f"_l_{c}") for c in left.columns)).withColumn("_left", F.lit(True))
    both = x.unionByName(r.withColumn("_left", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return out.select(*(F.col(f"_l_{c}").alias(c) for c in left.columns), *(F.col("_found")[v].alias(v) for v in values))


def latest_per_key(df: DataFrame, keys: Sequence[str], time: str, on_or_before: Column | None = None) -> DataFrame:
    """The latest row of each key (of equal times the one with the largest other columns), by one aggregate with partial
    maxima before the shuffle."""
    if on_or_before is not None:
        df = df.where(F.col(time) <= on_or_before)
    rest = [c for c in df.columns if c not in keys and c != time]
    g = df.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("_r"))
    return g.select(*keys, *(F.col("_r")[c].alias(c) for c in (time, *rest)))


def snapshot_at(snapshots: DataFrame, day: Column, date: str = "rebalance_date") -> DataFrame:
    """The rows of the latest snapshot on or before a day."""
    last = snapshots.where(F.col(date) <= day).agg(F.max(date).alias("_d"))
    return snapshots.join(F.broadcast(last), F.col(date) == F.col("_d")).drop("_d")


def in_validity(df: DataFrame, mapping: DataFrame, key: str, time: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """df with the mapping rows of its key whose validity holds its time; an open end never ends. The join is on the key, so
    the range only filters the few intervals of one key."""
    m = mapping.withColumnRenamed(key, "_k")
    cond = (F.col(key) == F.col("_k")) & (F.col(time) >= F.col(start)) & (F.col(time) <= F.coalesce(F.col(end), F.lit("9999-12-31").cast("date")))
    return df.join(m, cond, "left").drop("_k")


def lookback_mean(dates: DataFrame, series: DataFrame, date: str, time: str, value: str, days: int) -> DataFrame:
    """Mean of the series over the days before each date. Each value is dealt to the days it counts for, then joined by day."""
    s = series.select(F.explode(F.sequence(F.date_add(time, 1), F.date_add(time, days))).alias(date), F.col(value).alias("_v"))
    m = s.groupBy(date).agg(F.avg("_v").alias("mean"))
    return dates.join(m, date, "left")
