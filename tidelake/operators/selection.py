"""Quantiles and ranks over a whole table without bringing it into one task.

`order_statistics` narrows a bracket around each wanted rank: a pass gathers a bounded quantile sketch of the rows inside the brackets and takes values near
the wanted places as edges, the next pass counts the rows below and at each edge, and what lies between two edges is the new bracket. A sketch's error is 1 / ACCURACY of the bracket, so
a pass leaves about that share of it: three passes for 10^12 rows. When FEW rows are left in a bracket they are fetched; a value with many copies is found by its own
counts. No buffer holds more than the sketches, and the result is exact whatever the distribution.

`ranked` numbers rows by counts of values in range partitions and sums over the partitions before them.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import operator
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import shared

ACCURACY, FEW = 2000, 10_000


def kept(df: DataFrame) -> DataFrame:
    """df written once and read from there. A table that is computed twice may differ in the last bits of its sums, so that a value meets neither its own edge
    nor its own rank. Runs a job."""
    path = shared.folder(df.sparkSession, "rows")
    df.write.mode("append").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def order_statistics(df: DataFrame, value: str, ranks: Sequence[int], few: int = FEW) -> dict[int, float]:
    """Exact values of ranks (0-based, nulls aside), of those that exist. Runs jobs."""
    return _selected(df, value, lambda n: ranks, few)[1]


def _selected(df: DataFrame, value: str, ranks: Callable[[int], Sequence[int]], few: int) -> tuple[int, dict[int, float]]:
    """The number of values, and those at ranks(number)."""
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = x.count()
        open_, found = {r: (None, None, 0, n) for r in ranks(n) if 0 <= r < n}, {}  # rank -> the bracket's bounds (exclusive), rows below it and in it
        while open_:
            brackets = sorted(set(open_.values()), key=lambda b: b[2])
            inside = {b: _inside(b) for b in brackets}
            small = [b for b in brackets if b[3] <= few]
            if small:  # few rows of each, fetched together
                rows = sorted(r["v"] for r in x.where(functools.reduce(operator.or_, (inside[b] for b in small))).collect())
                for b in small:
                    first = bisect.bisect_right(rows, b[0]) if b[0] is not None else 0
                    found |= {r: rows[first + r - b[2]] for r, at in open_.items() if at == b}
            open_ = {r: b for r, b in open_.items() if b[3] > few}
            large = [b for b in brackets if b[3] > few]
            if not large:
                break
            shares = {b: sorted({min(max((r - b[2] + 0.5) / b[3] + d / ACCURACY, 0.0), 1.0) for r, at in open_.items() if at == b for d in (-2, 0, 2)}) for b in large}
            edges = x.agg(*(F.percentile_approx(F.when(inside[b], F.col("v")), shares[b], ACCURACY).alias(f"e{i}") for i, b in enumerate(large))).first()
            edges = sorted({e for row in edges for e in row})
            known = F.array(*map(F.lit, edges))
            place = 2 * F.size(F.filter(known, lambda e: e < F.col("v"))) + F.array_contains(known, F.col("v")).cast("int")  # even between edges, odd at one
            counts = {r["p"]: r["count"] for r in x.groupBy(place.alias("p")).count().collect()}
            sums = list(itertools.accumulate(counts.get(p, 0) for p in range(2 * len(edges) + 1)))
            below, upto = sums[0:-1:2], sums[1::2]
            for r, (lo, hi, start, size) in list(open_.items()):
                end = start + size
                for e, low, high in zip(edges, below, upto, strict=True):
                    if low <= r < high:
                        found[r] = e
                        del open_[r]
                        break
                    if high <= r and high >= start:
                        lo, start = e, high
                    elif low > r and low <= end:
                        hi, end = e, low
                        break
                if r in open_:
                    open_[r] = (lo, hi, start, end - start)
        return n, found
    finally:
        x.unpersist()


def _inside(b: tuple) -> Column:
    lo, hi, *_ = b
    out = F.lit(True)
    if lo is not None:
        out = out & (F.col("v") > lo)
    return out & (F.col("v") < hi) if hi is not None else out


def quantiles(df: DataFrame, value: str, shares: Sequence[float], few: int = FEW) -> list[float | None]:
    """Exact quantiles, linear between the two rows around each; nulls where there are no rows. Runs jobs."""
    n, found = _selected(df, value, lambda n: [r for q in shares for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))], few)
    if not n:
        return [None] * len(shares)
    out = []
    for q in shares:
        at = (n - 1) * q
        lo, hi = math.floor(at), math.ceil(at)
        a, b = found[lo], found[hi]
        out.append(a if lo == hi or a == b else (hi - at) * a + (at - lo) * b)
    return out


def ranked(df: DataFrame, value: str, out: str = "rank", descending: bool = False, average: bool = False) -> DataFrame:
    """df with the rank of each row's value among all rows (ties share the smallest rank, or the average); null has none."""
    spark, v, df = df.sparkSession, F.col("_v"), kept(df)
    order = v.desc() if descending else v.asc()
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    path = shared.folder(spark, "ranks")
    laid = counts.repartitionByRange(order).select("_v", "_n", F.spark_partition_id().alias("_part"))
    laid.write.mode("append").parquet(path)  # bounds of ranges are drawn once
    laid = spark.read.schema(laid.schema).parquet(path)
    parts = laid.groupBy("_part").agg(F.sum("_n").alias("_m"))
    before = parts.select("_part", (F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).alias("_before"))  # a row a partition
    start = F.sum("_n").over(Window.partitionBy("_part").orderBy(order)) - F.col("_n") + F.col("_before")
    place = (start + (F.col("_n") + 1) / 2.0) if average else start + 1
    ranks = laid.join(before, "_part").select("_v", place.alias(out))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")
