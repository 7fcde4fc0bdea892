"""Searches of parameters over walk-forward folds: sets drawn on the executors, all scored at once, chosen on earlier rows only."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def steps(dims: int) -> list[float]:
    """Irrational steps of an additive low-discrepancy sequence in so many dimensions: powers of the root of x^(dims+1) = x + 1."""
    g = 2.0
    for _ in range(60):
        g = (1 + g) ** (1 / (dims + 1))
    return [g ** -(j + 1) % 1 for j in range(dims)]


def drawn_sets(spark: SparkSession, n: int, ranges: Mapping[str, tuple[float, float]], weights: Sequence[str] = (), seed: float = 0.5) -> DataFrame:
    """set_id 0..n-1 and a value in its range for each name: evenly spread however many are drawn. weights: names scaled so that their absolute values add to 1."""
    x = spark.range(n).withColumnRenamed("id", "set_id")
    place = lambda a: (F.lit(seed) + F.col("set_id") * F.lit(a)) - F.floor(F.lit(seed) + F.col("set_id") * F.lit(a))
    x = x.select("set_id", *((F.lit(lo) + place(a) * F.lit(hi - lo)).alias(name) for (name, (lo, hi)), a in zip(ranges.items(), steps(len(ranges)), strict=True)))
    if weights:
        total = sum((F.abs(F.col(w)) for w in weights), F.lit(0.0))
        x = x.withColumn("_t", total).withColumns({w: F.when(F.col("_t") > 0, F.col(w) / F.col("_t")).otherwise(F.col(w)) for w in weights}).drop("_t")
    return x


def _sharpe(n: Column, s: Column, q: Column) -> Column:
    var = (q - s * s / n) / (n - 1)
    return F.when((n > 1) & (var > 1e-18), s / n / F.sqrt(var) * math.sqrt(252))


def purged_search(df: DataFrame, sets: DataFrame, features: Sequence[str], weights: Sequence[str], window: str = "window", date: str = "date", ret: str = "r", purge: int = 5) -> DataFrame:
    """For each test window the set with the best Sharpe ratio on all rows before it, and its ratio inside. A set is long where the weighted features
    lie above `high`, short below `low`, on the next row's return. The last `purge` rows before a test window are left out of its training, as their
    returns reach into it. df: one daily series, so days times sets are added up within tasks and only (set, window) sums are shuffled.

    window, set_id, train (rounded to 6 digits, ties to the smallest set), test, n (rows of the test)."""
    w = Window.partitionBy(window).orderBy(date)
    x = df.withColumns({"_next": F.lead(ret).over(w), "_left": F.count(F.lit(1)).over(Window.partitionBy(window)) - F.row_number().over(w)}).where("_next is not null")
    x = x.join(F.broadcast(sets), F.lit(True))
    signal = sum((F.col(a) * F.col(f) for a, f in zip(weights, features, strict=True)), F.lit(0.0))
    p = F.when(signal > F.col("high"), F.col("_next")).when(signal < F.col("low"), -F.col("_next")).otherwise(0.0)
    late = F.col("_left") <= purge
    x = x.select("set_id", window, p.alias("_p"), late.alias("_late"))
    part = x.groupBy("set_id", window).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_p").alias("s"), F.sum(F.col("_p") * F.col("_p")).alias("q"),
        F.count_if("_late").alias("ln"), F.coalesce(F.sum(F.when(F.col("_late"), F.col("_p"))), F.lit(0.0)).alias("ls"), F.coalesce(F.sum(F.when(F.col("_late"), F.col("_p") * F.col("_p"))), F.lit(0.0)).alias("lq"),
    )
    order = Window.partitionBy("set_id").orderBy(window)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    train = {c: F.sum(c).over(before) - F.lag(f"l{c}").over(order) for c in ("n", "s", "q")}
    part = part.withColumns({f"_{c}": v for c, v in train.items()}).where("_n > 1")
    part = part.select(window, "set_id", F.round(_sharpe(F.col("_n"), F.col("_s"), F.col("_q")), 6).alias("train"), _sharpe(F.col("n"), F.col("s"), F.col("q")).alias("test"), "n")
    best = part.where("train is not null").groupBy(window).agg(F.min(F.struct((-F.col("train")).alias("a"), "set_id", "test", "n")).alias("b"))
    return best.select(window, F.col("b.set_id").alias("set_id"), (-F.col("b.a")).alias("train"), F.col("b.test").alias("test"), F.col("b.n").alias("n"))
